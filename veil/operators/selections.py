"""What a person has marked: pages, rectangles and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamped
from .spans import locate


def pages_of(specs: DataFrame) -> DataFrame:
    """doc_id, page_no of page lists such as "3,5-7": either end of a range may come first, parts that are no numbers are skipped."""
    part = specs.select("doc_id", F.explode(F.split("spec", ",")).alias("p")).select("doc_id", F.split(F.trim("p"), r"\s*-\s*").alias("e"))
    ends = part.select("doc_id", F.expr("try_cast(e[0] AS INT)").alias("a"), F.expr("try_cast(coalesce(get(e, 1), e[0]) AS INT)").alias("z")).filter("a > 0 AND z > 0")
    return ends.select("doc_id", F.explode(F.sequence(F.least("a", "z"), F.greatest("a", "z"))).alias("page_no")).distinct()


def full_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """A rectangle for each listed page that exists."""
    return pages.join(pages_of(specs), ["doc_id", "page_no"], "left_semi").select("doc_id", "page_no", F.lit("page").alias("rule"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))


def rectangles(selections: DataFrame, pages: DataFrame, least: float = 0.0) -> DataFrame:
    """Rectangles of selections (rects in shares of the page) in points, corners in order, cut at the page's sides; pages that are not there, incomplete rectangles and those with a side shorter than `least` points go."""
    each = selections.select("doc_id", "page_no", F.explode("rects").alias("r")).join(pages.select("doc_id", "page_no", "width", "height"), ["doc_id", "page_no"])
    whole = each.filter("r.x0 IS NOT NULL AND r.y0 IS NOT NULL AND r.x1 IS NOT NULL AND r.y1 IS NOT NULL")
    placed = whole.select(
        "doc_id", "page_no", "width", "height", F.lit("manual").alias("rule"),
        (F.least("r.x0", "r.x1") * F.col("width")).alias("x0"), (F.least("r.y0", "r.y1") * F.col("height")).alias("y0"),
        (F.greatest("r.x0", "r.x1") * F.col("width")).alias("x1"), (F.greatest("r.y0", "r.y1") * F.col("height")).alias("y1"),
    ).withColumns(clamped())
    return placed.filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)).drop("width", "height")


def global_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Spans of each document's own terms (doc_id, term), in any case."""
    own = terms.select("doc_id", F.trim("term").alias("term")).filter("term <> ''").distinct()
    joined = docs.join(own, "doc_id").select("doc_id", "text", "term")
    return locate(joined, F.concat(F.lit(r"(?iu)\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), "term", carry=("term",))
