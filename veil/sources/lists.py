"""Lists of values and trees of documents: reading, merging, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redacted_path


def manifest(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """path, length, modificationTime of files under path with the suffix in any case; contents are not read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def names(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a list, trimmed, without blank ones; a missing file is an error."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def exceptions(spark: SparkSession, path: str | None) -> DataFrame:
    """Like names(), in lower case; no path or no file is an empty list."""
    jvm = spark.sparkContext._jvm
    if path:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return names(spark, path).select(F.lower("value").alias("value"))
    return spark.createDataFrame([], "value string")


def with_fallback(docs: DataFrame, primary: str = "text", secondary: str = "alt_text") -> DataFrame:
    """The documents with a second reading where the first is blank."""
    return docs.withColumn(primary, F.when(F.trim(primary) != "", F.col(primary)).otherwise(F.coalesce(secondary, F.lit(""))))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages with text, in order, joined by single blanks. pages: doc_id, page_no, text."""
    rows = pages.filter("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def write_lists(candidates: DataFrame, path: str) -> None:
    """Each kind's distinct values, in order, in a folder of its own; what was there is replaced."""
    _listed(candidates).write.partitionBy("kind").mode("overwrite").parquet(path)


def _listed(candidates: DataFrame) -> DataFrame:
    return candidates.select("kind", "value").dropDuplicates().repartition("kind", F.substring("value", 1, 1)).sortWithinPartitions("kind", "value")


def commit_lists(candidates: DataFrame, path: str) -> int:
    """The same as a version of its own; `current` reads the newest."""
    return commit(_listed(candidates), path, ("kind",))


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """The numbers of a table's versions, and whether each is whole: its writer leaves a mark last."""
    files, p = _filesystem(spark, path)
    if not files.exists(p):
        return []
    found = [f.getPath() for f in files.listStatus(p) if f.isDirectory() and f.getPath().getName().isdigit()]
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted((int(f.getName()), files.exists(mark(f, "_SUCCESS"))) for f in found)


def commit(rows: DataFrame, path: str, partition: tuple[str, ...] = ()) -> int:
    """Write a new version of a table beside the others. Readers see it when it is whole, so a write that is cut off changes nothing, and a version that is being read stays."""
    number = max((n for n, _ in versions(rows.sparkSession, path)), default=0) + 1
    rows.write.partitionBy(*partition).mode("errorifexists").parquet(f"{path}/{number}")
    return number


def current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The newest whole version of a table; an empty one of the schema if there is none."""
    whole = [n for n, ok in versions(spark, path) if ok]
    if not whole:
        if schema is None:
            raise FileNotFoundError(f"no whole version below {path}")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/{whole[-1]}")


def mirrored_path(path: Column, root: str, out: str) -> Column:
    """Where the redacted copy of a file below root lies in a tree of the same shape below out."""
    inside = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.lit(2**31 - 1))).otherwise(F.regexp_extract(path, "[^/]*$", 0))
    return F.concat(F.lit(out.rstrip("/") + "/"), redacted_path(inside))


def merged_lists(existing: DataFrame, new: DataFrame) -> DataFrame:
    """kind, value of both lists, once each."""
    return existing.select("kind", "value").unionByName(new.select("kind", "value")).distinct()


def write_redacted(docs: DataFrame, path: str, root: str = "") -> None:
    """Documents with the paths of their redacted copies, in a tree like the one below root."""
    docs.withColumn("path", mirrored_path(F.col("path"), root, path) if root else redacted_path(F.col("path"))).write.mode("overwrite").parquet(path)
