"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (a
shorter item is one window). A window is the set of its shingles with their
places in it, ordered by rarity in the corpus. A window occurs in a document
only if all of its shingles do, so the prefix that must be joined is its single
rarest shingle. A joined pair fixes where the window would lie; it must fit
into the document (length and position), and then its words are compared.

Windows are broadcast in blocks of about `block` windows and at most about
BLOCK_BYTES of text; each block is one pass over the documents, and with several
blocks what is known so far is staged between them. Windows with a shingle that
no document has are dropped.

Cases: a null or wordless text has no words and no hits; a null or wordless
item has no windows; a null item_id is written as "null"; repeated documents
and items each count, an item_id once; empty tables give no hits or no rows;
other columns are ignored; item_ids of any characters are kept apart, whatever the
number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Windows, staged, texts, whole, word_hashes

#: Runs of a-z, 0-9 and everything outside ASCII are words, after A-Z is lower-cased; all other bytes part them.
WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


#: Text of the windows of a block, about.
BLOCK_BYTES = 64 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch)):
                words = words_of(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item_id", "words"])

    return run


class Block:
    """Distinct windows, the items that have each, and the shingles by which documents meet them."""

    def __init__(self, rows: list[tuple[bytes, list[str]]], shingle: int):
        self.windows = [w.split(b" ") for w, _ in rows]
        self.items = [items for _, items in rows]
        roll = Windows(SEED)
        self.widths = [min(shingle, len(w)) for w in self.windows]
        self.shingles = [roll(word_hashes(w), k) for w, k in zip(self.windows, self.widths)]
        self.by_width: dict[int, np.ndarray] = {k: np.unique(np.concatenate([s for s, x in zip(self.shingles, self.widths) if x == k])) for k in set(self.widths)}
        self.prefix: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle; windows with one that never occurs are left out."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for j, (k, shingles) in enumerate(zip(self.widths, self.shingles)):
            n, place = min((counts.get((k, int(s)), 0), i) for i, s in enumerate(shingles))
            if n:
                chosen.setdefault(k, {}).setdefault(int(shingles[place]), []).append((j, place))
        self.prefix = {k: (np.array(sorted(d), np.uint64), d) for k, d in chosen.items()}
        self.shingles, self.by_width = [], {}

    def hits(self, words: list[bytes], hashes: np.ndarray, roll: Windows) -> Iterator[tuple[int, int]]:
        """(window, start) of every occurrence."""
        for k, (keys, where) in self.prefix.items():
            found = roll(hashes, k)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for p in np.flatnonzero(keys[at] == found).tolist():
                for j, place in where[int(found[p])]:
                    start, w = p - place, self.windows[j]
                    if start >= 0 and start + len(w) <= len(words) and words[start : start + len(w)] == w:
                        yield j, start


SEED = 0x5851F42D4C957F2D


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width, roll = shared.value, Windows(SEED)
        totals = {k: np.zeros(len(keys), np.int64) for k, keys in by_width.items()}
        for batch in batches:
            for text in texts(batch):
                hashes = word_hashes(words_of(text))
                for k, keys in by_width.items():
                    found = roll(hashes, k)
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    np.add.at(totals[k], at[keys[at] == found], 1)
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(by_width[k][at].view(np.int64)), pa.array(n[at])], ["k", "shingle", "n"])

    return run


def _apply(shared, first: bool, last: bool):
    """Add a block's hits to what is known of each document; at the end make it the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, roll = shared.value if shared else None, Windows(SEED)
        for batch in batches:
            n, masks, items = [], [], []
            known = [(b"", ())] * batch.num_rows if first else list(zip(batch.column("_mask").to_pylist(), batch.column("_items").to_pylist()))
            for text, (bits, names) in zip(texts(batch), known):
                words = words_of(text)
                mask = np.zeros(len(words), bool) if first else np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                named = set(names)
                if block and words:
                    for j, start in block.hits(words, word_hashes(words), roll):
                        mask[start : start + len(block.windows[j])] = True
                        named.update(block.items[j])
                n.append(len(words))
                masks.append(mask)
                items.append(sorted(named))
            columns = {c: batch.column(c) for c in batch.schema.names if not c.startswith("_") or c == "_doc"}
            if last:
                columns.pop("text")
                hit = [int(m.sum()) for m in masks]
                columns |= {
                    "n_words": pa.array(n, pa.int64()),
                    "n_hit": pa.array(hit, pa.int64()),
                    "n_items": pa.array(list(map(len, items)), pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    "contaminated": pa.array([h > 0 for h in hit], pa.bool_()),
                }
            else:
                columns |= {"_mask": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block: int = 200_000, carry: str = "") -> DataFrame:
    """doc_id, (carry,) n_words, n_hit, n_items, items_sha256, contaminated, a row for each document."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    windows = staged(items.mapInArrow(_item_windows(window), "item_id string, words binary").distinct(), "windows")
    n, size = windows.agg(F.count("*"), F.sum(F.length("words") + F.length("item_id"))).first()
    blocks = max(-(-n // block), -(-(size or 0) // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("words", "item_id"), F.lit(max(1, blocks)))
    state = docs.select("doc_id", "text", *([carry] if carry else []))
    head, result = list(state.schema), list(StructType.fromDDL(RESULT))
    for b in range(blocks):
        # One block: at most about `block` rows of one window and one item.
        own: dict[bytes, list[str]] = {}
        for row in windows.filter(part == b).collect():
            own.setdefault(bytes(row["words"]), []).append(row["item_id"])
        made = Block(sorted(own.items()), shingle)
        keys = spark.sparkContext.broadcast(made.by_width)
        counted = docs.select("text").mapInArrow(_counts(keys), "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n"))
        made.order({(r["k"], r["shingle"] & (1 << 64) - 1): r["n"] for r in counted.collect()})  # no more rows than the block has shingles
        last = b == blocks - 1
        schema = StructType([f for f in head if not (last and f.name == "text")] + (result if last else list(StructType.fromDDL("_mask binary, _items array<string>"))))
        state = state.mapInArrow(_apply(spark.sparkContext.broadcast(made), b == 0, last), schema)
        if not last:
            state = staged(state, f"block{b}")
    if not blocks:
        state = state.mapInArrow(_apply(None, True, True), StructType([f for f in head if f.name != "text"] + result))
    return state


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with all their columns."""
    full = docs.select("doc_id", "text", whole(docs).alias("_doc"))
    return contamination(full, benchmark, carry="_doc", **options).filter("NOT contaminated").select("_doc.*")
