"""Half-open spans of characters: finding, merging, subtracting and redacting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import characters, let, running, up_to
from ..functions.text import LABEL, may_hold, quick


SPAN = "array<struct<start:bigint,stop:bigint,rule:string,matched:string>>"


def found(text: Column, pattern: str | Column, rule: str | Column) -> Column:
    """start, stop, rule, matched of every match in a text, left to right without overlaps, as an array.

    There is no built-in that gives places: the gaps between matches come from
    split(), the matches from regexp_extract_all(), and places are their running
    lengths.
    """
    p = F.lit(quick(pattern)) if isinstance(pattern, str) else pattern
    r = F.lit(rule) if isinstance(rule, str) else rule
    pieces = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))

    def placed(x: Column) -> Column:
        before = running(F.transform(x, lambda y: (F.char_length(y["gap"]) + F.coalesce(F.char_length(y["hit"]), F.lit(0))).cast("bigint")), lambda a, n: a + n)
        spans = F.zip_with(x, before, lambda y, at: F.struct((at + F.char_length(y["gap"])).alias("start"), (at + F.char_length(y["gap"]) + F.char_length(y["hit"])).alias("stop"), r.alias("rule"), y["hit"].alias("matched")))
        return F.filter(spans, lambda y: y["matched"].isNotNull()).cast(SPAN)

    # A text without a mark that every match holds is not searched.
    return F.when(may_hold(text, pattern) & F.regexp_like(text, p), let(pieces, placed)).otherwise(F.array().cast(SPAN))


def locate(docs: DataFrame, pattern: str | Column, rule: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carry..., rule, start, stop, matched of every match, left to right without overlaps."""
    each = docs.select("doc_id", *carry, F.explode(found(F.col(text), pattern, rule)).alias("_x"))
    return each.select("doc_id", *carry, "_x.rule", "_x.start", "_x.stop", "_x.matched")


def united(spans: Column) -> Column:
    """start, stop of the unions of overlapping or touching spans of one text, in order."""

    def joined(s: Column) -> Column:
        return let(
            running(F.transform(s, lambda x: x["stop"]), F.greatest),  # how far the spans before each reach
            lambda reach: let(
                F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] > F.get(reach, i)), i)), lambda i: i.isNotNull()),
                lambda firsts: F.transform(firsts, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(firsts, k + 1), F.size(s))).alias("stop"))),
            ),
        )

    return let(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))), joined)


def covered(spans: Column) -> Column:
    """How many characters of one text spans have, those that several have once: a running total over the spans in order, without their unions."""

    def seen(a: Column, x: Column) -> Column:
        new = F.greatest(x["stop"] - F.greatest(x["start"], a["reach"]), F.lit(0).cast("bigint"))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["reach"], x["stop"]).alias("reach"))

    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach"))
    return F.aggregate(ordered, none, seen, lambda a: a["n"])


def redacted_text(text: Column, spans: Column, label: str = LABEL) -> Column:
    """A text with the characters of every span replaced by the label."""

    def cut(s: Column, c: Column) -> Column:
        end = lambda i: F.coalesce(F.get(s, i)["stop"], F.lit(0)).cast("int")
        kept = F.transform(s, lambda x, i: F.concat(F.array_join(F.slice(c, end(i - 1) + 1, x["start"].cast("int") - end(i - 1)), ""), F.lit(label)))
        return F.concat(F.array_join(kept, ""), F.array_join(F.slice(c, end(F.size(s) - 1) + 1, F.size(c)), ""))

    return F.when(F.size(spans) > 0, let(united(spans), lambda s: let(characters(text), lambda c: cut(s, c)))).otherwise(text)


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, start, stop of the unions of overlapping or touching spans."""
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def clear_of(spans: Column, exceptions: Column) -> Column:
    """The spans of an array, each with a character at least, that overlap no exception of another: exceptions are united, so each span is compared with one of them."""

    def kept(e: Column) -> Column:
        def free(x: Column, ends: Column) -> Column:
            first = F.get(e, up_to(ends, x["start"]))  # the first that ends behind the span's start
            return first.isNull() | (first["start"] >= x["stop"])

        return let(F.transform(e, lambda x: x["stop"]), lambda ends: F.filter(spans, lambda x: free(x, ends)))

    return F.when((F.size(spans) > 0) & (F.size(exceptions) > 0), let(united(exceptions), kept)).otherwise(spans)


def per_document(spans: DataFrame, name: str) -> DataFrame:
    """doc_id and an array of its spans."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct(*spans.columns)).alias(name))


def without(spans: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Spans that overlap no exception of their document: an equi-join of the documents' arrays."""
    no = exceptions.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))
    joined = per_document(spans, "_s").join(per_document(no, "_e"), "doc_id", "left")
    none = F.array().cast(joined.schema["_e"].dataType)
    return joined.select(F.explode(clear_of(F.col("_s"), F.coalesce("_e", none))).alias("_x")).select("_x.*")


def redacted(docs: DataFrame, spans: DataFrame, label: str = LABEL) -> DataFrame:
    """The documents with every span's characters replaced by the label; a document without spans as it is. Rows that share a doc_id share spans."""
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    joined = docs.join(per_doc, "doc_id", "left")
    return joined.withColumn("text", redacted_text(F.col("text"), F.coalesce("_spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")), label)).select(docs.columns)
