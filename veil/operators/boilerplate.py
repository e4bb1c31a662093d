"""Headers, footers and signatures: what stands in the same place on most pages, or below a sign-off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import SIDES, near
from ..functions.text import grid, squeezed

HEADER, FOOTER = 40.0, 60.0


def sampled(rows: DataFrame, pages: DataFrame, first: int = 1, last: int = 10) -> DataFrame:
    """Rows on the pages first to last of each document, as far as it has them."""
    spans = pages.groupBy("doc_id").agg(F.max("page_no").alias("_most"))
    return rows.join(spans, "doc_id").filter(F.col("page_no").between(max(1, first), F.least(F.lit(last), F.col("_most")))).drop("_most")


def text_zone(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words that begin in their page's header or end in its footer."""
    placed = words.join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"])
    return placed.filter((F.col("y0") < HEADER) | (F.col("y1") > F.col("height") - FOOTER)).select(words.columns)


def text_template(words: DataFrame, share: float = 0.9, least_pages: int = 2, step: float = 1.0, sample: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, y, text of words that stand at one height on this share of a document's pages, or of those from the first to the last of a sample."""
    words = words if sample is None else sampled(words, words, *sample)
    placed = words.select("doc_id", "page_no", grid(F.col("y0"), step).alias("y"), "text")
    pages = placed.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages")).filter(F.col("pages") >= least_pages)
    often = placed.groupBy("doc_id", "y", "text").agg(F.count_distinct("page_no").alias("on"))
    return often.join(pages, "doc_id").filter(F.col("on") >= share * F.col("pages")).select("doc_id", "y", "text")


def text_match(words: DataFrame, template: DataFrame, step: float = 1.0) -> DataFrame:
    """Words that the template holds."""
    return words.withColumn("y", grid(F.col("y0"), step)).join(template, ["doc_id", "y", "text"], "left_semi").select(words.columns)


def in_zone() -> Column:
    """Whether a rectangle lies within its page's header or footer."""
    return (F.col("y1") <= HEADER) | (F.col("y0") >= F.col("height") - FOOTER)


def rect_template(graphics: DataFrame, pages: DataFrame, share: float = 0.7, sample: tuple[int, int] | None = None) -> DataFrame:
    """doc_id and rectangle of graphics in a header or footer on this share of a document's pages (or of those of a sample), by occurrences. Graphics that have their page's height do not meet the pages for it."""
    if sample is not None:
        graphics, pages = sampled(graphics, pages, *sample), sampled(pages, pages, *sample)
    n = pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("_n"))
    placed = graphics if "height" in graphics.columns else graphics.join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"])
    zone = placed.filter(in_zone())
    keyed = zone.select("doc_id", *[(F.rint(F.col(s) * 10) / 10).alias(s) for s in SIDES])
    return keyed.groupBy("doc_id", *SIDES).count().join(n, "doc_id").filter(F.col("count") >= share * F.col("_n")).select("doc_id", *SIDES)


def rect_match(graphics: DataFrame, template: DataFrame, within: float = 3.0) -> DataFrame:
    """Graphics whose sides are all within a tolerance of a template's; candidates meet in cells of x0."""
    g = graphics.select("*", F.floor(F.col("x0") / within).alias("_cell"))
    t = template.select(F.col("doc_id").alias("_d"), *[F.col(s).alias(f"t_{s}") for s in SIDES], F.explode(F.array(*[F.floor(F.col("x0") / within) + k for k in (-1, 0, 1)])).alias("_c"))
    return g.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("_cell") == F.col("_c")) & near("", "t_", within), "left_semi").select(graphics.columns)


def zone_images(graphics: DataFrame, pages: DataFrame, least: float = 40.0) -> DataFrame:
    """Images centred in a header or footer whose longer side is at least so long."""
    placed = graphics if "height" in graphics.columns else graphics.join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"])
    middle = (F.col("y0") + F.col("y1")) / 2
    return placed.filter(((middle <= HEADER) | (middle >= F.col("height") - FOOTER)) & (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= least)).select(graphics.columns)


def signature_zones(lines: DataFrame, pages: DataFrame, phrases: tuple[str, ...], above: float = 8.0, below: float = 140.0, share: float = 0.3, gap: float = 5.0) -> DataFrame:
    """doc_id, page_no, y0, y1 of full-width zones below lines with one of the phrases (those that close a letter, in lower case); zones that come near are one. lines: doc_id, page_no, text, y0, y1."""
    low = F.lower(squeezed(F.col("text")))
    hit = lines.filter(reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in phrases])).join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"])
    top = F.greatest(F.lit(0.0), F.col("y0") - above)
    zones = hit.select("doc_id", "page_no", top.alias("y0"), F.least(F.col("height"), top + F.least(below + F.col("y1") - F.col("y0"), share * F.col("height"))).alias("y1"))
    order = Window.partitionBy("doc_id", "page_no").orderBy("y0", "y1")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = zones.withColumn("_new", F.when(F.col("y0") <= reach + gap, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(order))
    return islands.groupBy("doc_id", "page_no", "_i").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("_i")
