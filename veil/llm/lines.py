"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

A line's key is the line without blanks at its ends, A-Z in lower case. Each
task puts the keys of its documents, once a document, into a filter of what it
has seen and, where the filter holds them already, into a second one. Filters
of tasks are united bit by bit: what two of the first filters share belongs to
the second. A key that two documents hold has all its bits in the united second
filter; most others do not, and they never leave their task again.

Only suspected repeats are shuffled, as 128-bit hashes with counts that each
task has added up first, so a line in a third of all documents is a row for each
task. The exact counts say which keys repeat and which document keeps its lines.
Those keys go back to the documents: by broadcast if they are counted to be few,
else those in very many documents by broadcast (they are few by arithmetic) and
the rest by a join with the places where a filter of them finds them.

The filter's size follows the number of lines up to `most_bits`; beyond that
more lines are suspected, and results stay the same.

Cases: a null or empty text is one empty line; each row is a document, rows that
share the largest doc_id all keep their lines, and a null doc_id is below all
others; a key that a document holds several times counts once, and a document
that keeps a key keeps all its lines; texts are read whole, whatever their
length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, staged, texts

BLANK = b" \t\n\v\f\r"
#: Words of 64 bits in a part of a filter, which is what travels.
PART = 1 << 12
#: Bits of a filter: at least, and at most unless a caller says otherwise (32 MB); bits for each line.
LEAST_BITS, MOST_BITS, BITS_A_LINE = 64 * PART, 1 << 28, 8
#: Hashes or counts that a task holds before it passes them on: under 200 MB.
HELD = 1 << 20
#: Repeated keys up to which all of them are broadcast (24 bytes each); documents from which on a key is broadcast anyway.
FEW_KEYS, MANY_DOCS = 1_000_000, 10_000
#: doc_id of a null one.
NO_ID = np.iinfo(np.int64).min


def keys_of(text: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the key of each that has `least` code points or more, else None."""
    lines = text.split(b"\n")
    keys = [k.strip(BLANK) for k in text.translate(LOWER).split(b"\n")]
    return lines, [k if len(k) >= least and (k.isascii() or len(k.decode("utf-8", "replace")) >= least) else None for k in keys]


def hashed(keys: list[bytes]) -> np.ndarray:
    """128 bits for each key, as rows of two longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def own_hashes(text: bytes, least: int) -> np.ndarray:
    return hashed(list({k for k in keys_of(text, least)[1] if k is not None}))


class Filter:
    """A Bloom filter whose keys have four bits each in one word of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word and the bits of each hash."""
        high, low = h[:, 0].view(np.uint64), h[:, 1].view(np.uint64)
        bits = np.zeros(len(h), np.uint64)
        for k in range(4):
            bits |= np.uint64(1) << ((low >> np.uint64(6 * k)) & np.uint64(63))
        return (high % np.uint64(len(self.words))).astype(np.int64), bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        at, bits = self.at(h)
        return self.words[at] & bits == bits

    def add(self, h: np.ndarray) -> None:
        np.bitwise_or.at(self.words, *self.at(h))


def _filters(least: int, words: int, twice: bool):
    """Parts of a task's filters: part, once, again (compressed words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again, small = Filter(np.zeros(words, np.uint64)), Filter(np.zeros(words, np.uint64)), zstandard.ZstdCompressor(level=1)
        held, size = [], 0

        def flush() -> None:
            h = np.concatenate(held)
            if twice:
                _, first, n = np.unique(h[:, 0], return_index=True, return_counts=True)
                new = h[first]
                again.add(new[once.holds(new)])
                several = np.ones(len(h), bool)
                several[first[n == 1]] = False
                again.add(h[several])
            once.add(h)

        for batch in batches:
            for h in _hashes(batch, least):
                held.append(h)
                size += len(h)
                if size > HELD:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        for p in range(0, words, PART):
            a, b = once.words[p : p + PART], again.words[p : p + PART]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([p // PART], pa.int32()), pa.array([small.compress(a.tobytes())]), pa.array([small.compress(b.tobytes())])], ["part", "once", "again"])

    return run


def _hashes(batch: pa.RecordBatch, least: int) -> Iterator[np.ndarray]:
    """Of each text the hashes of its keys; of rows of hashes these themselves."""
    if "text" in batch.schema.names:
        yield from (own_hashes(t, least) for t in texts(batch) if len(t) >= least)
    elif batch.num_rows:
        yield np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], 1)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts that arrive in order, united: what two tasks have seen once is seen twice."""
    plain, small = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    now, once, again = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([small.compress(once.tobytes())]), pa.array([small.compress(again.tobytes())])], ["part", "once", "again"])

    for batch in batches:
        for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "again"))):
            a, b = (np.frombuffer(plain.decompress(x), np.uint64) for x in (a, b))
            if p != now:
                if now is not None:
                    yield done()
                now, once, again = p, a.copy(), b.copy()
            else:
                again |= b | (once & a)
                once |= a
    if now is not None:
        yield done()


def _gathered(parts: DataFrame, words: int, column: str) -> np.ndarray:
    """A filter of at most most_bits bits, on the driver: that bound, not the corpus, sets its size."""
    schema = "part int, once binary, again binary"
    shards = max(1, min(parts.sparkSession.sparkContext.defaultParallelism, words // PART))
    united = parts.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(_united, schema).select("part", column)
    out, plain = np.zeros(words, np.uint64), zstandard.ZstdDecompressor()
    for row in united.collect():
        out[row[0] * PART : row[0] * PART + PART] = np.frombuffer(plain.decompress(bytes(row[1])), np.uint64)
    return out


def filter_words(lines: int, most_bits: int) -> int:
    """Words of a filter for so many lines: a power of two of parts."""
    bits = max(LEAST_BITS, min(most_bits, lines * BITS_A_LINE))
    return max(1, 1 << (bits // 64 - 1).bit_length()) if bits < most_bits else max(1, most_bits // 64)


_COUNTS = "h1 long, h2 long, n long, last long"


def _suspects(words, least: int):
    """Keys that the filter suspects, with the documents of a task that hold them and the largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspected = Filter(words.value)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            ids = np.repeat(np.array([i for _, i in held], np.int64), [len(x) for x, _ in held])
            order = np.lexsort((h[:, 1], h[:, 0]))
            h, ids = h[order], ids[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(1)])
            return pa.RecordBatch.from_arrays([pa.array(h[first, 0]), pa.array(h[first, 1]), pa.array(np.diff(np.r_[first, len(h)])), pa.array(np.maximum.reduceat(ids, first))], ["h1", "h2", "n", "last"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                if len(t) < least:
                    continue
                h = own_hashes(t, least)
                h = h[suspected.holds(h)]
                if len(h):
                    held.append((h, NO_ID if i is None else i))
                    size += len(h)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


class Keepers:
    """Repeated keys with the doc_id that keeps them, in sorted arrays."""

    def __init__(self, rows: pa.Table | None = None):
        h1, h2, last = (rows.column(c).to_numpy() if rows is not None else np.empty(0, np.int64) for c in ("h1", "h2", "last"))
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.last = h1[order], h2[order], last[order]

    def keeps(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and who keeps it."""
        found, who = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        if len(self.h1):
            at = np.searchsorted(self.h1, h[:, 0])
            open_ = np.arange(len(h))
            while len(open_):  # keys of one first half stand side by side: nearly always one
                open_ = open_[at[open_] < len(self.h1)]
                open_ = open_[self.h1[at[open_]] == h[open_, 0]]
                hit = self.h2[at[open_]] == h[open_, 1]
                found[open_[hit]], who[open_[hit]] = True, self.last[at[open_[hit]]]
                open_ = open_[~hit]
                at[open_] += 1
        return found, who


_RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _kept(least: int, known, with_text: bool):
    """What is left of each text; `drops`, where it is a column, has hashes (16 bytes each) of further keys that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = known.value
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            packed = "packed" in batch.schema.names
            raw = [plain.decompress(x) for x in batch.column("packed").to_pylist()] if packed else texts(batch)
            drops = batch.column("drops").to_pylist() if packed else [None] * len(ids)
            n, gone, digests, kept_texts = [], [], [], []
            for i, text, more in zip(ids, raw, drops):
                lines, keys = keys_of(text, least) if len(text) >= least else (text.split(b"\n"), [])
                at = [k for k, x in enumerate(keys) if x is not None]
                n.append(len(lines))
                out = set()
                if at:
                    h = hashed([keys[k] for k in at])
                    found, who = keepers.keeps(h)
                    out = {at[k] for k in np.flatnonzero(found & (who != (NO_ID if i is None else i))).tolist()}
                    if more:
                        known_here = {bytes(x) for x in more}
                        out.update(k for k, x in zip(at, h) if x.tobytes() in known_here)
                kept = b"\n".join([x for k, x in enumerate(lines) if k not in out]) if out else text
                gone.append(len(out))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _places(least: int, words, known):
    """key, h1, h2 of a row's keys that the filter finds and the broadcast ones do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, keepers = Filter(words.value), known.value
        for batch in batches:
            keys, parts = [], []
            for key, t in zip(batch.column("key").to_pylist(), texts(batch)):
                h = own_hashes(t, least)
                h = h[wanted.holds(h)]
                h = h[~keepers.keeps(h)[0]]
                keys.append(np.full(len(h), key, np.int64))
                parts.append(h)
            if keys:
                h = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["key", "h1", "h2"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([small.compress(t) for t in texts(batch)], pa.binary())], ["doc_id", "key", "packed"])


def deduped_lines(docs: DataFrame, least: int = 20, least_docs: int = 3, most_bits: int = MOST_BITS, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and kept_text) of what is left of each document.

    Keys of at least `least` code points that at least `least_docs` documents
    (2 or more) hold lose their lines in all but the largest doc_id of these.
    """
    if least_docs < 2:
        raise ValueError("least_docs must be 2 or more")
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # No line of fewer characters counts, so a text has no more keys than this.
    most = F.least(F.regexp_count("text", F.lit("\n")) + 1, F.floor((F.char_length("text") + 1) / (least + 1)).cast("int"))
    lines = docs.agg(F.sum(most.cast("long"))).first()[0] or 0
    words = filter_words(lines, most_bits)
    parts = docs.select("text").mapInArrow(_filters(least, words, True), "part int, once binary, again binary")
    suspected = sc.broadcast(_gathered(parts, words, "again"))
    counts = docs.mapInArrow(_suspects(suspected, least), _COUNTS)
    repeated = counts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= least_docs)
    repeated = staged(repeated, "repeated")
    schema = _RESULT + (", kept_text string" if with_text else "")
    n = repeated.count()
    if n <= FEW_KEYS:
        known = sc.broadcast(Keepers(repeated.select("h1", "h2", "last").toArrow()))
        return docs.mapInArrow(_kept(least, known, with_text), schema)
    # A key of so many documents costs as many lines of the corpus: there are few.
    limit = max(MANY_DOCS, repeated.agg(F.sum("n")).first()[0] // FEW_KEYS + 1)
    known = sc.broadcast(Keepers(repeated.filter(F.col("n") >= limit).select("h1", "h2", "last").toArrow()))
    rest = repeated.filter(F.col("n") < limit)
    wanted = sc.broadcast(_gathered(rest.select("h1", "h2").mapInArrow(_filters(least, filter_words(n, most_bits), False), "part int, once binary, again binary"), filter_words(n, most_bits), "once"))
    rows = staged(docs.withColumn("key", F.monotonically_increasing_id()), "rows")
    places = rows.select("key", "text").mapInArrow(_places(least, wanted, known), "key long, h1 long, h2 long")
    own = rows.select("key", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("_id"))
    hits = places.join(rest, ["h1", "h2"]).join(own, "key").filter("last <> _id")
    drops = hits.groupBy("key").agg(F.collect_list(F.unhex(F.concat(_little(F.col("h1")), _little(F.col("h2"))))).alias("drops"))
    packed = rows.mapInArrow(_packed, "doc_id long, key long, packed binary")
    return packed.join(drops, "key", "left").select("doc_id", "packed", "drops").mapInArrow(_kept(least, known, with_text), schema)


def _little(x):
    """The 16 hexadecimal digits of a long, lowest byte first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])
