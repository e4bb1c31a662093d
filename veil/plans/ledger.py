"""A ledger of detections: spans kept in tables bucketed by document, so that what is asked of them later joins and adds up without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spans

#: Buckets of tables that are to be joined with each other. A bucket is a task: choose so many that one takes some hundred MB.
BUCKETS = 64
COLUMNS = ["doc_id", "rule", "start", "stop", "matched"]


def store(found: DataFrame, table: str, path: str, buckets: int = BUCKETS, columns: list[str] = COLUMNS) -> DataFrame:
    """Write rows by document to a table of the catalog whose files lie below path; the table is what is returned. With columns doc_id and spans (what detect.scanned gives) a row is a document with all its spans, and none is sorted by itself."""
    rows = found.select(*columns).repartition(buckets, "doc_id").sortWithinPartitions("doc_id")
    rows.write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", path).mode("overwrite").format("parquet").saveAsTable(table)
    return found.sparkSession.table(table)


def buckets_for(docs: DataFrame, least: int = 8) -> int:
    """Two buckets for each task that reads the documents, so that a bucket grows no faster than a piece of the input."""
    return max(least, 2 * docs.rdd.getNumPartitions())


def _arrays(ledger: DataFrame, name: str) -> DataFrame:
    """doc_id and an array of (rule, start, stop) of its spans, of a ledger of either kind."""
    if "spans" not in ledger.columns:
        return spans.per_document(ledger.select("doc_id", "rule", "start", "stop"), name)
    own = F.arrays_zip("spans.rule", "spans.start", "spans.stop")
    return ledger.select("doc_id", own.alias("_x")).groupBy("doc_id").agg(F.flatten(F.collect_list("_x")).alias(name))


def report(found: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """doc_id, rule, n, masked_chars of a ledger's spans of every rule, less those that overlap one of a ledger of exceptions; characters that several spans of a rule have count once."""
    kept = _arrays(found, "_s")
    if exceptions is not None:
        kept = kept.join(_arrays(exceptions, "_e"), "doc_id", "left")
        kept = kept.select("doc_id", spans.clear_of(F.col("_s"), F.coalesce("_e", F.array().cast(kept.schema["_e"].dataType))).alias("_s"))
    own = lambda r: F.struct(r.alias("rule"), F.filter("_s", lambda x: x["rule"] == r).alias("s"))
    per_rule = kept.select("doc_id", F.explode(F.transform(F.array_distinct(F.transform("_s", lambda x: x["rule"])), own)).alias("_x"))
    return per_rule.select("doc_id", F.col("_x.rule").alias("rule"), F.size("_x.s").cast("bigint").alias("n"), spans.covered(F.col("_x.s")).alias("masked_chars"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, rule, gone, left, new: how many spans of each document and rule a second ledger no longer has, still has, and has besides, by what they matched. Counts of matches are exchanged, not spans."""
    count = lambda d, name: d.groupBy("doc_id", "rule", "matched").agg(F.count("*").alias(name))
    both = count(before, "a").join(count(after, "b"), ["doc_id", "rule", "matched"], "full_outer").fillna(0, ["a", "b"])
    least = F.least("a", "b")
    return both.groupBy("doc_id", "rule").agg(F.sum(F.col("a") - least).alias("gone"), F.sum(least).alias("left"), F.sum(F.col("b") - least).alias("new"))
