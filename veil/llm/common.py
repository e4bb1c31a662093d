"""What several operators share: the shared folder, staged tables, words and hashes of words."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Join sides under this many rows of a few longs (under 100 MB in memory) are broadcast; callers count them first.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset in a local session (tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-veil-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor loses no more than its running tasks."""
    path = f"{shared_dir(df.sparkSession)}/veil-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(docs: DataFrame) -> Column:
    """All columns of a table as one, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a batch's texts; b"" for null."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 random-looking bits for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can be used alone."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Windows:
    """Hashes of all windows of a sequence of word hashes: differences of one running sum of weighted words, so a window costs the same whatever its width."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << n.bit_length()
            for name, by in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, by & ((1 << 64) - 1), np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def weights(self, n: int) -> np.ndarray:
        """Of n words."""
        self._grow(n)
        return self.up[:n]

    def __call__(self, hashes: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the windows of that width that start at these positions (default: at all)."""
        n = len(hashes)
        if n < width:
            return np.empty(0, np.uint64)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        at = np.arange(n - width + 1) if at is None else at
        return mixed((sums[at + width] - sums[at]) * self.down[at])


def with_offsets(df: DataFrame, order: str, step: int, sums: dict[str, str]) -> DataFrame:
    """Running sums in the order of a long column, without a window over all rows.

    sums maps each new column to the column that it sums over the rows before.
    Rows of one `order` // step value share a task, and only one row for each
    such value meets in the last window; rows are expected once per `order`.
    """
    spread = df.withColumn("_block", F.floor(F.col(order) / step).cast("long"))
    totals = spread.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.join(totals, "_block")
        .withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
        .drop("_block", *[f"_b_{k}" for k in sums])
    )
