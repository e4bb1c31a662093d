"""The whole plan: detect, except, redact, report, and look again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABEL
from ..operators import detect, spans

#: Fields that several rows have are told to all tasks up to this many; where there are more all counts are exchanged.
BROADCAST_FIELDS = 1_000_000


def detections(docs: DataFrame, on: tuple[str, ...] = ("email", "phone", "link"), rules: dict[str, str] | None = None, exceptions: DataFrame | list[str] | dict[str, str] | None = None, names: DataFrame | list[str] | None = None) -> DataFrame:
    """Spans of all rules that are on, once each, less those that overlap an exception's: spans (doc_id, start, stop), or what detect.scanned takes."""
    if isinstance(exceptions, DataFrame) and "start" in exceptions.columns:
        return spans.without(detect.blanket(docs, rules, on, names=names), exceptions)
    return detect.blanket(docs, rules, on, names=names, exceptions=exceptions)


def redact(docs: DataFrame, found: DataFrame, label: str = LABEL) -> DataFrame:
    return spans.redacted(docs, found, label)


def redact_all(docs: DataFrame, label: str = LABEL, **options) -> DataFrame:
    """The documents with every find replaced, in one pass without a shuffle. options: rules, on, names, exceptions of detect.scanned."""
    return detect.scanned(docs, **options).withColumn("text", spans.redacted_text(F.col("text"), F.col("spans"), label)).drop("spans")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_phone, n_link (n_name, if there is a list of names), masked_chars, chars of documents with a find, in one pass without a shuffle."""
    found = detect.scanned(docs, **options).filter("size(spans) > 0")
    count = lambda r: F.size(F.filter("spans", lambda x: x["rule"] == r)).cast("bigint").alias(f"n_{r}")
    kinds = ("email", "phone", "link") + (("name",) if options.get("names") is not None else ())
    return found.select("doc_id", *map(count, kinds), spans.covered(F.col("spans")).alias("masked_chars"), F.char_length("text").cast("bigint").alias("chars"))


def totals(reports: DataFrame) -> DataFrame:
    """One row over all reports: documents with a find, finds of each rule, characters."""
    return reports.agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ("n_email", "n_phone", "n_link", "masked_chars", "chars")])


def leaks(docs: DataFrame, exceptions: DataFrame | list[str] | dict[str, str] | None = None, **options) -> DataFrame:
    """What a second search of all kinds finds in redacted documents; finds that exceptions allow are marked."""
    left = detections(docs, **options)
    if exceptions is None:
        return left.withColumn("excepted", F.lit(False))
    kept = detections(docs, exceptions=exceptions, **options).select("doc_id", "rule", "start", "stop", F.lit(False).alias("_k")).distinct()
    return left.join(kept, ["doc_id", "rule", "start", "stop"], "left").withColumn("excepted", F.col("_k").isNull()).drop("_k")


def survivors(docs: DataFrame, values: DataFrame | list[str], metadata: DataFrame | None = None) -> DataFrame:
    """doc_id, field, value, n: listed values that still stand in redacted texts (field `text`) or in what documents say of themselves, wherever a search for them finds them."""
    rows = docs.select("doc_id", F.lit("text").alias("field"), "text")
    if metadata is not None:
        rows = rows.unionByName(detect.metadata_fields(metadata).select("doc_id", F.col("_field").alias("field"), "text"))
    hits = lambda some: detect.name_counts(some, values, F.col("field")).select("doc_id", "field", F.col("name").alias("value"), "n")
    summed = lambda some: some.groupBy("doc_id", "field", "value").agg(F.sum("n").alias("n"))
    # A row's counts are whole, so only fields that several rows have are added up; there can be as many hits as words.
    again = rows.groupBy("doc_id", "field").count().filter("count > 1").select(F.col("doc_id").alias("_d"), F.col("field").alias("_f"))
    n = again.count()
    if n > BROADCAST_FIELDS:
        return summed(hits(rows))
    if not n:
        return hits(rows)
    shared = F.broadcast(again), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("field").eqNullSafe(F.col("_f"))
    return hits(rows.join(*shared, "left_anti")).unionByName(summed(hits(rows.join(*shared, "left_semi"))))


#: What a redacted document says of itself.
CLEAN = {"title": "Redacted document", "author": "", "subject": "", "creator": "veil", "producer": "veil"}


def clean_metadata(metadata: DataFrame, stamp: str) -> DataFrame:
    """doc_id and properties: constants and the given UTC stamp (yyyyMMddHHmmss) in place of all that was there; no XMP, no attachments; layers stay, for the audit."""
    constants = F.create_map(*[F.lit(x) for kv in {**CLEAN, "creationDate": f"D:{stamp}Z00'00'", "modDate": f"D:{stamp}Z00'00'"}.items() for x in kv])
    return metadata.withColumns({"props": constants, "xmp": F.lit(""), "attachments": F.array().cast("array<string>")})


def layers_audit(metadata: DataFrame) -> DataFrame:
    """doc_id, n_layers of documents with optional layers; they are not changed."""
    return metadata.filter("size(layers) > 0").select("doc_id", F.size("layers").cast("bigint").alias("n_layers"))
