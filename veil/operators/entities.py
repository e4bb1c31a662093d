"""Names from entities that a recogniser has found: doc_id, label, start, stop, text, sent, tokens array of (text, pos)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.validate import name_shape, numeric_noise

if TYPE_CHECKING:
    import pandas as pd

#: What a recogniser gives for each entity, besides doc_id.
ENTITY = "label string, start long, stop long, text string, sent string, tokens array<struct<text:string,pos:string>>"


def recognised(docs: DataFrame, ner_fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """The entities that a caller's recogniser finds: it takes frames of doc_id and text and gives frames of doc_id and the columns of ENTITY (tokens: a list of dicts with text and pos), in any order.

    Columns that are missing, or spans that a text cannot have, are errors that
    name the recogniser's fault; further columns are ignored.
    """
    columns = ["doc_id", *[c.split(" ")[0] for c in ENTITY.split(", ")]]

    def checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in ner_fn(frames):
            if missing := [c for c in columns if c not in found.columns]:
                raise ValueError(f"the recogniser gives no {', '.join(missing)}")
            if len(found) and not ((found["start"] >= 0) & (found["start"] <= found["stop"])).all():
                raise ValueError("the recogniser gives a span that ends before it starts")
            yield found[columns]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter("text IS NOT NULL").mapInPandas(checked, f"doc_id {kind}, {ENTITY}")


def _lowered(values: DataFrame) -> DataFrame:
    return values.select(F.lower("value").alias("_s")).distinct()


def whole_names(entities: DataFrame, docs: DataFrame, stop_list: DataFrame, common: DataFrame, function_words: Sequence[str] | None = None) -> DataFrame:
    """doc_id, name, sent: spans of people with a proper noun, not followed by a colon, of a name's shape and on neither list.

    after: the two characters behind each span, if the entities have such a
    column; otherwise they come from the documents, whose texts meet all their
    entities at once.
    """
    people = entities.filter((F.col("label") == "PERSON") & F.exists("tokens", lambda t: t["pos"] == "PROPN"))
    shaped = people.filter(name_shape(F.col("text"), function_words) & ~numeric_noise(F.col("text")))
    if "after" not in entities.columns:
        per_doc = shaped.groupBy("doc_id").agg(F.collect_list(F.struct("text", "sent", "stop")).alias("_es"))
        chars = once(per_doc.join(docs.select("doc_id", F.col("text").alias("_all")), "doc_id"), _c=F.split("_all", ""))
        behind = lambda e: F.array_join(F.slice("_c", e["stop"].cast("int") + 1, F.lit(2)), "")
        shaped = chars.filter("_all IS NOT NULL").select("doc_id", F.explode(F.transform("_es", lambda e: F.struct(e["text"].alias("text"), e["sent"].alias("sent"), behind(e).alias("after")))).alias("_e")).select("doc_id", "_e.*")
    shaped = shaped.filter(~F.ltrim("after").startswith(":"))
    kept = shaped.join(_lowered(stop_list), F.lower("text") == F.col("_s"), "left_anti")
    alone = common.select(F.lower("value").alias("_c")).distinct()
    return kept.join(alone, (F.lower("text") == F.col("_c")) & ~F.contains(F.col("text"), F.lit(" ")), "left_anti").select("doc_id", F.col("text").alias("name"), "sent")


def name_parts(entities: DataFrame, stop_list: DataFrame, function_words: Sequence[str] | None = None) -> DataFrame:
    """doc_id, name, sent: proper nouns inside spans of people that are names by themselves; initials alone are left out."""
    each = entities.filter("label = 'PERSON'").select("doc_id", "sent", F.explode("tokens").alias("t")).filter("t.pos = 'PROPN'").select("doc_id", F.col("t.text").alias("name"), "sent")
    good = each.filter(name_shape(F.col("name"), function_words) & ~numeric_noise(F.col("name")) & ~F.col("name").rlike(r"^[A-Z]\.?$"))
    return good.join(_lowered(stop_list), F.lower("name") == F.col("_s"), "left_anti")


def names(entities: DataFrame, docs: DataFrame, stop_list: DataFrame, common: DataFrame, function_words: Sequence[str] | None = None) -> DataFrame:
    """doc_id, name, sent: whole names and their parts, without initials. Entities that have `after` are read once; a whole name that is one of its own parts is left to that part, whose conditions are laxer."""
    if "after" not in entities.columns:
        whole = whole_names(entities, docs, stop_list, common, function_words)
        return whole.unionByName(name_parts(entities, stop_list, function_words)).filter(~F.col("name").rlike(r"^[A-Z]\.?$"))
    proper = F.array_distinct(F.transform(F.filter("tokens", lambda t: t["pos"] == "PROPN"), lambda t: t["text"]))
    each = once(entities.filter("label = 'PERSON'").select("doc_id", "sent", "text", "after", proper.alias("_p")).filter("size(_p) > 0"), _own=F.coalesce(F.array_contains("_p", F.col("text")) | F.ltrim("after").startswith(":"), F.lit(True)))
    each = each.select("doc_id", "sent", F.when(F.col("_own"), F.lit(-1)).otherwise(F.size("_p")).alias("_n"), F.posexplode(F.when(F.col("_own"), F.col("_p")).otherwise(F.concat("_p", F.array("text")))).alias("_k", "name"))
    good = each.filter(name_shape(F.col("name"), function_words) & ~numeric_noise(F.col("name")) & ~F.col("name").rlike(r"^[A-Z]\.?$"))
    kept = good.join(_lowered(stop_list), F.lower("name") == F.col("_s"), "left_anti")
    # A whole name of one word is none if the word is a common one.
    alone = F.when((F.col("_k") == F.col("_n")) & ~F.contains("name", F.lit(" ")), F.lower("name"))
    return kept.join(common.select(F.lower("value").alias("_c")).distinct(), alone == F.col("_c"), "left_anti").select("doc_id", "name", "sent")


def cleaned_up(names: DataFrame, safe: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Names (doc_id, name, sent) without single letters; initials of a list (value) that are safe though short are names of every document, or without `docs` of every document with another name."""
    kept = names.filter(~F.col("name").rlike(r"^[A-Z]\.?$"))
    if safe is None:
        return kept
    # One row for each document and initial: the list is a person's, and short.
    own = [r["value"] for r in safe.select("value").distinct().limit(1001).collect()]
    if len(own) > 1000:
        raise ValueError("a list of over 1000 safe initials")
    more = (kept if docs is None else docs).select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, own)).cast("array<string>")).alias("name"), F.lit("").alias("sent"))
    return kept.unionByName(more)


def contexts(names: DataFrame, cut: int = 200) -> DataFrame:
    """doc_id, name, context: the first sentence (by text, if several are first) in which a document has the name."""
    return names.groupBy("doc_id", "name").agg(F.min(F.substring("sent", 1, cut)).alias("context"))
