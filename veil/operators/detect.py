"""Detectors over the text plane: each gives spans (doc_id, rule, start, stop, matched)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.text import EMAIL, LINK, PHONE
from . import substrings
from .gazetteer import spans_of_names
from .spans import SPAN, clear_of, found, locate

#: Exception phrases that tasks look for at once; a longer list takes several passes over the values.
MOST_PHRASES = 500_000
RULES = {"email": EMAIL, "phone": PHONE, "link": LINK}


def rules_on(emails: bool = True, phones: bool = True, links: bool = True, automated: bool = True, names: bool = False, boilerplate: bool = False) -> tuple[str, ...]:
    """Which rules a plan runs; without automated detection none. Names and boilerplate are rules of plans that have a list or a layout."""
    return tuple(r for r, on in (("email", emails), ("phone", phones), ("link", links), ("name", names), ("boilerplate", boilerplate)) if on and automated)


def scanned(docs: DataFrame, rules: dict[str, str] | None = None, on: tuple[str, ...] = ("email", "phone", "link"), names: DataFrame | list[str] | None = None, exceptions: DataFrame | list[str] | dict[str, str] | None = None) -> DataFrame:
    """The documents with an array `spans` of every match of the rules that are on: one pass, no shuffle.

    names: a list whose values are found as rule `name`, however they are glued
    to punctuation. exceptions: patterns by rule, or a list of phrases (whole
    words, in any case); a span that overlaps one of theirs is left out.
    """
    rules = rules or RULES
    none = F.array().cast(SPAN)
    if exceptions is not None and "_except" in docs.columns:
        raise ValueError("documents must not have a column _except")
    out = docs.withColumn("spans", F.concat(none, *[found(F.col("text"), rules[r], r) for r in on if r in rules]))
    if isinstance(exceptions, dict):
        # A pattern that is a rule's too is not run again, and none more than once a text.
        own = [r for r, p in exceptions.items() if r in on and rules.get(r) == p]
        out = once(docs, spans=F.concat(none, *[found(F.col("text"), rules[r], r) for r in on if r in rules]))
        out = once(out, _except=F.concat(F.filter("spans", lambda x: x["rule"].isin(own)), *[found(F.col("text"), p, r) for r, p in exceptions.items() if r not in own]))
    if names is not None:
        out = substrings.marked(out, names, "name", "spans", bounds="names")
    if exceptions is None:
        return out
    if isinstance(exceptions, dict):
        return once(out, spans=clear_of(F.col("spans"), F.col("_except"))).drop("_except")
    return substrings.marked(out, exceptions, column="_except", blanks=False, bounds="words").withColumn("spans", clear_of(F.col("spans"), F.col("_except"))).drop("_except")


def blanket(docs: DataFrame, rules: dict[str, str] | None = None, on: tuple[str, ...] = ("email", "phone", "link"), **options) -> DataFrame:
    """Every match of the rules that are on, a row for each."""
    each = scanned(docs, rules, on, **options).select("doc_id", F.explode("spans").alias("_x"))
    return each.select("doc_id", "_x.rule", "_x.start", "_x.stop", "_x.matched")


def listed(docs: DataFrame, values: DataFrame | list[str], rule: str = "listed", bounded: bool = True) -> DataFrame:
    """Every place of a list's names; if bounded, letters or digits must not run on at ends that are such."""
    return substrings.places(docs, values, rule, bounds="names" if bounded else None)


def literal(docs: DataFrame, values: DataFrame | list[str], rule: str = "listed") -> DataFrame:
    """Every place of a list's values as they are, in any case, inside longer strings too."""
    return substrings.places(docs, values, rule, blanks=False)


def curated_or_blanket(docs: DataFrame, values: DataFrame | None, pattern: str, rule: str, bounded: bool = True) -> DataFrame:
    """With a list of values (even an empty one) every place of each, whatever the pattern says of it, and nothing else; without a list all that the pattern finds. bounded: as names; otherwise as they are, anywhere."""
    if values is None:
        return locate(docs, pattern, rule)
    return spans_of_names(docs, values, rule) if bounded else literal(docs, values, rule)


def curated_counts(docs: DataFrame, values: DataFrame | list[str], bounded: bool = True) -> DataFrame:
    """doc_id, value, n, places: how often each text has each of a list's values that it has, and the sum of where they start; in one pass, without a row for each place. bounded: as in curated_or_blanket."""
    return substrings.counted(docs, values, bounds="names") if bounded else substrings.counted(docs, values, blanks=False)


def back_search(docs: DataFrame, pattern: str, rule: str) -> DataFrame:
    """Copies, also inside longer strings, of what a pattern finds in a document: doc_id, value, copies."""
    values = F.array_distinct(F.transform(found(F.col("text"), pattern, rule), lambda x: x["matched"]))
    copies = lambda v: F.floor((F.char_length("text") - F.char_length(F.replace("text", v, F.lit("")))) / F.char_length(v)).cast("bigint")
    each = docs.select("doc_id", F.explode(F.transform(values, lambda v: F.struct(v.alias("value"), copies(v).alias("copies")))).alias("_x"))
    return each.select("doc_id", "_x.value", "_x.copies")


def link_targets(pages: DataFrame, host: str) -> DataFrame:
    """page_id, uri of links whose target holds the host."""
    uris = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("uri"))
    return uris.filter(F.lower("uri").contains(host.lower()))


def name_search(rows: DataFrame, names: DataFrame | list[str], field: str | Column) -> DataFrame:
    """doc_id, name, field, matched, context for every place of searched names, inside longer words too, whatever blanks part their words; in one pass over the rows (doc_id, text)."""
    placed = rows.select("doc_id", "text", (F.lit(field) if isinstance(field, str) else field).alias("field"))
    return substrings.searched(placed, names, carry=("field",)).select("doc_id", F.col("value").alias("name"), "field", "matched", "context")


def name_counts(rows: DataFrame, names: DataFrame | list[str], field: str | Column) -> DataFrame:
    """doc_id, name, field, n: how many places name_search finds in each row, for searches that need no matches or contexts."""
    placed = rows.select("doc_id", "text", (F.lit(field) if isinstance(field, str) else field).alias("field"))
    return substrings.counted(placed, names, carry=("field",)).select("doc_id", F.col("value").alias("name"), "field", "n")


def metadata_fields(metadata: DataFrame) -> DataFrame:
    """doc_id, _field, text: the properties (props map) of documents, and where the table has them their XMP and the names of their attachments."""
    fields = metadata.select("doc_id", F.explode("props").alias("_field", "text"))
    if "xmp" in metadata.columns:
        fields = fields.unionByName(metadata.select("doc_id", F.lit("xmp").alias("_field"), F.col("xmp").alias("text")))
    if "attachments" in metadata.columns:
        fields = fields.unionByName(metadata.select("doc_id", F.lit("attachment").alias("_field"), F.explode("attachments").alias("text")))
    return fields.filter("text IS NOT NULL")


def metadata_search(metadata: DataFrame, names: DataFrame | list[str]) -> DataFrame:
    """The same over what documents say of themselves; field is the property's name, xmp or attachment."""
    return name_search(metadata_fields(metadata), names, F.col("_field"))


def without_exceptions(values: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Values in which no phrase of a list, however long, stands between word boundaries, in any case."""
    own = exceptions.select(F.trim("value").alias("value"))
    marks = substrings.marked(values.withColumn("text", F.col("value")), own, column="_hits", blanks=False, bounds="words", most=MOST_PHRASES)
    return marks.filter("size(_hits) = 0").select(values.columns)
