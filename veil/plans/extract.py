"""From recognised entities and the layout to the names of documents and of the corpus, and what a search for them tells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences
from ..operators import entities as ner
from ..operators import layout


def by_source(
    docs: DataFrame,
    entities: DataFrame,
    words: DataFrame,
    stop_list: DataFrame,
    common: DataFrame,
    safe: DataFrame | None = None,
    function_words: Sequence[str] | None = None,
    label: str = "name",
    header: str = "name",
    things: tuple[str, ...] = (),
    marks: str = ":",
    word: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """doc_id, name, source (ner, table, label), context: all sources of names united, each (document, name, source) once. words, marks, word: as in layout.label_names."""
    found = ner.cleaned_up(ner.names(entities, docs, stop_list, common, function_words), safe)
    recognised = found.select("doc_id", "name", F.substring("sent", 1, 200).alias("context"), F.lit("ner").alias("source"))
    placed = layout.placed_names(words, label, header, things=things, function_words=function_words, marks=marks, word=word).withColumn("context", F.concat_ws(" ", "source", "page_no"))
    united = recognised.select("doc_id", "name", "context", "source").unionByName(placed.select("doc_id", "name", "context", "source"))
    return united.groupBy("doc_id", "name", "source").agg(F.min("context").alias("context"))


def contributions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, name, sources, n: what each document adds: how often its text has the name, once at least, and where it was found."""
    own = names.groupBy("doc_id", "name").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    per_doc = own.groupBy("doc_id").agg(F.collect_list(F.struct("name", "sources")).alias("_names"))
    counted = docs.join(per_doc, "doc_id").select("doc_id", F.explode(F.transform("_names", lambda x: F.struct(x["name"].alias("name"), x["sources"].alias("sources"), occurrences(F.col("text"), x["name"]).alias("n")))).alias("_x"))
    return counted.select("doc_id", "_x.name", "_x.sources", "_x.n")


def corpus_names(added: DataFrame) -> DataFrame:
    """name, docs, n: the distinct names of the corpus."""
    return added.groupBy("name").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


def finds(names: DataFrame, added: DataFrame) -> DataFrame:
    """The names as finds for the candidate table; tables and labels count as tables."""
    source = F.when(F.array_contains("sources", "table") | F.array_contains("sources", "label"), "table").otherwise("ner")
    context = names.groupBy("doc_id", "name").agg(F.min("context").alias("context"))
    return added.join(context, ["doc_id", "name"]).select(F.lit("name").alias("kind"), F.col("name").alias("value"), "context", source.alias("source"), "doc_id", F.lit(0).cast("bigint").alias("start"))


def found_summary(hits: DataFrame) -> DataFrame:
    """name, docs, n: how many documents and places a search (doc_id, name, field, matched, context) found each name in."""
    each = hits.groupBy("name", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("name").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


def found_by_file(hits: DataFrame) -> DataFrame:
    """name, doc_id, text_matches, metadata_matches: a document's matches of a name as arrays of (field, matched, context), in order."""
    match = F.struct("field", "matched", "context")
    of = lambda test: F.array_sort(F.collect_list(F.when(test, match)))
    return hits.groupBy("name", "doc_id").agg(of(F.col("field") == "text").alias("text_matches"), of(F.col("field") != "text").alias("metadata_matches"))
