"""Token ids in a byte-aligned binary format.

Ids are replaced by their rank in the corpus's order of frequency, so the
commonest 256 take one byte. Ranks are written in groups of four: one control
byte holds four two-bit lengths less one, and the bytes of the ranks (1 to 4
each, little-endian) lie in a stream of their own. Decoding looks each control
byte up in a 256 x 4 table of lengths, and gathers the bytes with numpy.

Format: a table of blocks in the order (part, block), written by Spark, and a
one-row table with the ids by rank. A block holds consecutive documents in
ascending order of doc_id: its version, the ids before it in its part, how many
of its first documents have no doc_id, the other doc_ids and all lengths
(little-endian 64- and 32-bit integers), and the controls and data of the ids of
all its documents in a row. A part covers a range of rows in that order; part
numbers ascend with it.

Cases: a null text is empty and is its end id alone; documents with equal
doc_ids are neighbours, ordered by their ids' checksum (and may be in several
parts); null doc_ids come first; an empty table writes no blocks; other columns
are ignored; runs of white space or of one letter of any length are taken whole.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_dir, with_offsets

VERSION = 2
#: Ids in a block, about; a block closes after the document that reaches it.
BLOCK_IDS = 1 << 18
#: Documents that a task has in hand at once.
SLICE = 1000
#: Ids in one part, about: 128 MB.
PART_IDS = 1 << 26
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- encoding texts ----------------------------------------------------------

#: What the quick way holds for: these steps before the merges, as the tokenizer's file has them (fixed values).
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters from the ranges for Latin that composing leaves alone and that lower case maps to one letter.
LATIN = "ªµºÀ-ÖØ-öø-įı-ɏ"
_AFTER = r"|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+"
#: Tokens of a lower-case text of ASCII, or of ASCII and those letters, as the tokenizer splits it.
PLAIN_TOKENS, TOKENS = re.compile("[a-z]+" + _AFTER).findall, re.compile(f"[a-z{LATIN}]+" + _AFTER).findall
#: Anything else, or what could begin an added token, leaves a chunk to the library.
ODD = re.compile(rf"[^\t-\r -~{LATIN}]|<\|").search
USUAL = bytes([*range(9, 14), *range(32, 127)])
BLANKS = re.compile(r"[\t-\r ]+").split
#: The byte-level alphabet: printable bytes are themselves.
BYTES = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTES |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in BYTES)}  # the others from 256 on


class Words(dict):
    """Ids (as bytes) of tokens, asked of the library when first seen, and kept in two generations."""

    LIMIT = 200_000  # tokens in each generation, about 70 MB together
    LONGEST = 64  # characters of a token that is kept

    def __init__(self, ids: Callable[[str], Iterable[int]], code: str):
        super().__init__()
        self.ids, self.code = ids, code
        self.older: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        if len(token) > self.LONGEST:
            return array(self.code, self.ids(token)).tobytes()
        found = self.older.get(token) or array(self.code, self.ids(token)).tobytes()
        self[token] = found
        return found

    def turn_over(self) -> None:
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts by the tokenizers library.

    For a tokenizer that only composes, squeezes white space, drops case and
    splits as given above, a text's ids are those of its tokens in order, so
    the library's model is asked once for each distinct token. Text with other
    letters than Latin ones goes to the library a chunk between blanks at a
    time, and for any other tokenizer file whole texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        parts = json.loads(self.tokenizer.to_str())
        split, level = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        self.quick = (
            (parts.get("normalizer") or {}).get("normalizers") == NORMALIZER
            and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and parts["model"]["type"] == "BPE"
            and not parts["model"].get("dropout")
            and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        )
        tokenize = self.tokenizer.model.tokenize
        self.words = Words(lambda t: [x.id for x in tokenize(t if t.isascii() else "".join(map(BYTES.__getitem__, t.encode())))], self.code)
        self.chunks = Words(self._whole, self.code)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        """A text's ids as bytes of the dtype."""
        if not self.quick:
            return array(self.code, self._whole(text)).tobytes()
        get = self.words.__getitem__
        unusual = text.encode().translate(None, USUAL)
        if not unusual and "<|" not in text:
            out = b"".join(map(get, PLAIN_TOKENS(text.lower())))
        elif not ODD(unusual.decode()) and "<|" not in text:
            out = b"".join(map(get, TOKENS(text.lower())))
        else:
            out = b"".join([self.chunks[c] if ODD(c) else b"".join(map(get, TOKENS(c.lower()))) for c in BLANKS(text)])
        self.words.turn_over()
        self.chunks.turn_over()
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_IDS = "doc_id long, n long, crc long, tie long, ids binary, counts binary"


def _encode(path: str, end_id: int):
    """Each document's ids with what orders equal doc_ids, and at the end of a task its counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        counts = np.zeros(max(encode.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        names = [c.split()[0] for c in _IDS.split(", ")]
        end = np.array([end_id], encode.dtype).tobytes()
        tie = TaskContext.get().partitionId() << 40
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            raw = [encode(t or "") + end for t in batch.column("text").to_pylist()]
            counts += np.bincount(np.frombuffer(b"".join(raw), encode.dtype), minlength=len(counts))
            n = pa.array([len(r) // encode.dtype.itemsize for r in raw], pa.int64())
            ties = pa.array(range(tie, tie + len(raw)), pa.int64())
            tie += len(raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(map(zlib.crc32, raw), pa.int64()), ties, pa.array(raw, pa.binary()), pa.nulls(len(raw), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names)

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            one = np.frombuffer(zlib.decompress(raw), np.int64)
            total = one.copy() if total is None else total + one
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])


# --- writing -----------------------------------------------------------------

_BLOCK = "part int, block int, version int, first long, n_null int, doc_ids binary, lengths binary, control binary, data binary"


def _pack(shared, dtype: np.dtype):
    """Blocks of the sorted documents of a part."""

    def closed(part: int, block: int, before: int, rows: list[tuple]) -> pa.RecordBatch:
        known = [r[0] for r in rows if r[0] is not None]
        control, data = encode_ranks(shared.value[np.frombuffer(b"".join([r[2] for r in rows]), dtype)])
        values = [part, block, VERSION, before, len(rows) - len(known), np.array(known, "<i8").tobytes(), np.array([r[1] for r in rows], "<u4").tobytes(), control, data]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                if size >= BLOCK_IDS:
                    yield closed(part, block, before, rows)
                    block, before, rows, size = block + 1, before + size, [], 0
                rows.append(row)
                size += row[1]
        if rows:
            yield closed(part, block, before, rows)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode whole texts with a tokenizer file, append end_id to each, and write blocks and the ids by rank under path."""
    spark = docs.sparkSession
    dtype = encoder(tokenizer).dtype
    # Encoding is the dear part, so ids are kept once; counts come with them, a row for each task.
    ids_path = f"{path}/ids"
    docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_encode(tokenizer, end_id), _IDS).write.option("compression", "zstd").parquet(ids_path)
    rows = spark.read.schema(_IDS).parquet(ids_path)
    counts = rows.filter("counts IS NOT NULL").select("counts").mapInArrow(_sum_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    by_rank = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    total = sum(r["n"] for r in counts)
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame([(VERSION, np.array(by_rank, "<u4").tobytes())], "version int, ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    # Parts are ranges of rows; the place where a row was encoded parts even equal rows.
    parts = max(1, -(-total // PART_IDS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("doc_id", "crc", "n", "tie")
    dealt = rows.filter("ids IS NOT NULL").select(*order, "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "n", "ids").mapInArrow(_pack(spark.sparkContext.broadcast(rank_of), dtype), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


# --- reading -----------------------------------------------------------------


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by_rank = shared.value
        for batch in batches:
            for b in batch.to_pylist():
                lengths = np.frombuffer(b["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                raw = ids_by_rank[decode_ranks(b["control"], b["data"], int(ends[-1]))].tobytes()
                cuts = (4 * ends).tolist()
                ids = [raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts)]
                doc_ids = pa.array([None] * b["n_null"] + np.frombuffer(b["doc_ids"], "<i8").tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(b["start"] + ends - lengths), pa.array(lengths), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of every document in the files."""
    ranks = spark.read.schema("version int, ids binary").parquet(f"{path}/ranks").collect()
    table = np.frombuffer(b"".join(bytes(r["ids"]) for r in ranks), "<u4")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # A part's length: where its last block starts, and that block's ids.
    stops = blocks.select("part", "first", "lengths").mapInArrow(_stops, "part int, stop long").groupBy("part").agg(F.max("stop").alias("stop"))
    bases = with_offsets(stops, "part", 1024, {"base": "stop"}).select("part", "base")
    few = blocks.select("part").distinct().count() <= BROADCAST_ROWS
    placed = blocks.join(F.broadcast(bases) if few else bases, "part").withColumn("start", F.expr("base + first"))
    return placed.select("start", "n_null", "doc_ids", "lengths", "control", "data").mapInArrow(_decode(spark.sparkContext.broadcast(table)), "doc_id long, start long, n_tokens long, ids binary")


def _stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stops = [f + int(np.frombuffer(raw, "<u4").sum()) for f, raw in zip(batch.column("first").to_pylist(), batch.column("lengths").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(stops, pa.int64())], ["part", "stop"])


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids, read the files back, and describe each document: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(docs.sparkSession)}/veil-{uuid.uuid4().hex}/ids"
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
