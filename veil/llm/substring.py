"""Substring dedup with difference-cover anchors.

A window of `window` words is repeated if its words also start anywhere else;
every word inside a repeated window is removed. Hashing all windows would move
a row for each word, so anchors are hashed first: shorter windows that start
where position modulo a period lies in a difference cover. Whatever two
positions a long match has, the cover holds a shift of less than a period that
brings both onto the cover, so the match has an anchor in common at that shift.
An anchor that occurs once leaves nothing to look at around it; one that occurs
again is extended to all windows that contain it, and only those are hashed
(96 bits) and compared.

Tasks count what they hold before they send it: an anchor or window that a task
has several times is sent once and marked, so a passage in a third of all
documents costs a row for each task. Of the windows only those that turn out
single are sent back; they are few, and the document's runs of extended windows
less these are the repeated ones.

Cases: a null text has no words; a document of fewer words than a window keeps
them all; documents with equal texts lose everything a window covers; rows are
told apart by doc_id, and if that repeats or is null by a 64-bit hash of it and
the text (equal rows share one and get equal results); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, staged, texts, word_hashes

#: Perfect difference sets by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Anchors or windows that a task holds back to count them: under 100 MB.
HELD = 1 << 21
ONE, KNOWN, SEVERAL = 0, 1, 2  # what a row says: one occurrence; one of several in its task; several in a task, whatever it names


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors a third of the window's words, at least."""
    period = max((v for v in COVERS if window - v + 1 >= max(1, window // 3)), default=1)
    return period, COVERS[period]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        columns["packed"] = pa.array([small.compress(t) for t in texts(batch)], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class Held:
    """Hashes with their places, sent on in rows of which a task has no two with one hash."""

    def __init__(self, tell_known: bool, check: bool):
        self.tell_known, self.check, self.parts, self.size = tell_known, check, [], 0

    def add(self, h: np.ndarray, c: np.ndarray | None, key: int, at: np.ndarray) -> None:
        if len(h):
            self.parts.append((h, c, key, at))
            self.size += len(h)

    def rows(self) -> tuple[np.ndarray, ...] | None:
        """hash, check, key, at, what; rows of one hash need only say so once."""
        if not self.parts:
            return None
        h = np.concatenate([p[0] for p in self.parts])
        c = np.concatenate([p[1] for p in self.parts]) if self.check else np.zeros(len(h), np.uint32)
        key = np.repeat(np.array([p[2] for p in self.parts], np.int64), [len(p[0]) for p in self.parts])
        at = np.concatenate([p[3] for p in self.parts]).astype(np.int32)
        self.parts, self.size = [], 0
        order = np.lexsort((c, h)) if self.check else np.argsort(h)
        h, c, key, at = h[order], c[order], key[order], at[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        several = ~(new & np.r_[new[1:], True])
        what = np.where(several, KNOWN, ONE).astype(np.int8)
        first = np.flatnonzero(several & new)
        known = np.flatnonzero(several) if self.tell_known else np.empty(0, np.int64)
        one = np.flatnonzero(~several)
        take = np.concatenate([one, known, first])
        what = np.concatenate([what[one], what[known], np.full(len(first), SEVERAL, np.int8)])
        h = h[take].copy()
        h[len(one) : len(one) + len(known)] = (key[known].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (at[known].astype(np.uint64) << np.uint64(40))  # these are not compared: anywhere will do
        return h.view(np.int64), c[take].view(np.int32), key[take], at[take], what


_ANCHORS = "h long, key long, at int, what byte"


def _anchors(window: int, seed: int):
    period, cover = cover_for(window)
    width = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, held = Windows(seed), Held(True, False)

        def flush() -> Iterator[pa.RecordBatch]:
            if (rows := held.rows()) is not None:
                h, _, key, at, what = rows
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(at), pa.array(what)], ["h", "key", "at", "what"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), texts(batch)):
                words = text.split()
                if len(words) < window:
                    continue
                last = len(words) - width
                places = np.arange(0, last + 1, period)[:, None] + np.array(cover)
                places = places[places <= last]
                held.add(roll(word_hashes(words), width, places), None, key, places)
                if held.size > HELD:
                    yield from flush()
        yield from flush()

    return run


def _found_again(names: list[str], wanted: str):
    """Of rows sorted by hash (and check): "again" gives places of hashes with more than one occurrence, "single" those with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None

        def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
            what = batch.column("what").to_numpy()
            h = batch.column("h").to_numpy()
            same = np.r_[False, h[1:] == h[:-1]]
            if "c" in names:
                c = batch.column("c").to_numpy()
                same[1:] &= c[1:] == c[:-1]
            again = same | np.r_[same[1:], False]
            if wanted == "again":
                keep = (what == KNOWN) | ((what == ONE) & again)
            else:
                keep = (what == KNOWN) | ((what == ONE) & ~again)
            out = batch.filter(pa.array(keep))
            return out.select([n for n in names if n not in ("h", "c", "what")])

        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            h = batch.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # rows of the last hash may go on
            if cut:
                yield judged(batch.slice(0, cut))
            left = batch.slice(cut)
            if left.num_rows > 4096:  # one hash: two of its rows say what a third would
                first, rest = judged(left.slice(0, left.num_rows - 2)), left.slice(left.num_rows - 2)
                yield first
                left = rest
        if left is not None:
            yield judged(left)

    return run


_WINDOWS = "h long, c int, key long, at int, what byte, runs binary"


def _extended(window: int, seed: int):
    """The windows around each document's repeated anchors: their hashes for comparison, and once their runs (start, end pairs)."""
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, second, held = Windows(seed), Windows(seed ^ 0x2545F4914F6CDD1D), Held(False, True)
        plain = zstandard.ZstdDecompressor()
        names = [n.split()[0] for n in _WINDOWS.split(", ")]

        def flush() -> Iterator[pa.RecordBatch]:
            if (rows := held.rows()) is not None:
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(len(rows[0]), pa.binary())], names)

        for batch in batches:
            keys, runs = [], []
            for key, raw, places in zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist(), batch.column("places")):
                words = plain.decompress(raw).split()
                last = len(words) - window
                if last < 0:
                    continue
                # A window at p has an anchor at p .. p + period - 1.
                places = np.unique(places.values.to_numpy())
                starts, ends = np.maximum(0, places - period + 1), np.minimum(last, places)
                depth = np.zeros(last + 2, np.int32)
                np.add.at(depth, starts[starts <= ends], 1)
                np.add.at(depth, ends[starts <= ends] + 1, -1)
                at = np.flatnonzero(np.cumsum(depth)[: last + 1] > 0)
                if not len(at):
                    continue
                hashes = word_hashes(words)
                held.add(roll(hashes, window, at), (second(hashes, window, at) >> np.uint64(32)).astype(np.uint32), key, at)
                breaks = np.flatnonzero(np.diff(at) > 1)
                keys.append(key)
                runs.append(np.stack([at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + 1], 1).astype("<u4").tobytes())
                if held.size > HELD:
                    yield from flush()
            if keys:
                key = np.array(keys, np.int64)
                zeros = np.zeros(len(keys), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)), pa.array(zeros), pa.array(key), pa.array(np.full(len(keys), -1, np.int32)), pa.array(np.full(len(keys), KNOWN, np.int8)), pa.array(runs, pa.binary())], names)
        yield from flush()

    return run


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _removed(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            n, gone, digests, kept_texts = [], [], [], []
            for raw, runs, singles in zip(batch.column("packed").to_pylist(), batch.column("runs").to_pylist(), batch.column("singles")):
                words = plain.decompress(raw).split()
                keep = words
                if runs:
                    depth = np.zeros(len(words) + 1, np.int32)
                    repeated = np.zeros(len(words), bool)
                    for a, b in np.frombuffer(runs, "<u4").reshape(-1, 2).tolist():
                        repeated[a:b] = True
                    if singles.is_valid and len(singles.values):
                        repeated[singles.values.to_numpy()] = False
                    at = np.flatnonzero(repeated)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + window, -1)
                    keep = list(compress(words, (np.cumsum(depth)[:-1] == 0).tolist()))
                text = b" ".join(keep)
                n.append(len(words))
                gone.append(len(words) - len(keep))
                digests.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def removed_repeats(docs: DataFrame, window: int = 50, seed: int = 0x9FB21C651E98DF25, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of what remains of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unique = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    rows = docs.select("doc_id", "text", (F.col("doc_id") if unique else F.xxhash64("doc_id", "text")).alias("key"))
    anchors = rows.select("key", "text").mapInArrow(_anchors(window, seed), _ANCHORS)
    again = anchors.repartition("h").sortWithinPartitions("h").mapInArrow(_found_again(["h", "key", "at", "what"], "again"), "key long, at int")
    places = again.groupBy("key").agg(F.collect_list("at").alias("places"))
    packed = "key long, packed binary"
    near = rows.select("key", "text").mapInArrow(_packed, packed).join(places, "key").select("key", "packed", "places")
    windows = near.mapInArrow(_extended(window, seed), _WINDOWS)
    singles = windows.repartition("h").sortWithinPartitions("h", "c").mapInArrow(_found_again(["h", "c", "key", "at", "what", "runs"], "single"), "key long, at int, runs binary")
    known = singles.groupBy("key").agg(F.collect_list(F.when(F.col("runs").isNull(), F.col("at"))).alias("singles"), F.max("runs").alias("runs"))
    known = staged(known, "runs")
    last = rows.mapInArrow(_packed, "doc_id long, key long, packed binary").join(known, "key", "left").select("doc_id", "packed", "runs", "singles")
    return last.mapInArrow(_removed(window, with_text), _RESULT + (", kept_text string" if with_text else ""))
