"""Blocks of text with the boxes of their characters: from places in a text to rectangles on a page.

blocks: doc_id, page_no, block_no, text, lines. A line says where in the text it
starts and stops (the newline between two lines belongs to neither) and where its
characters' edges are: `edges` has one entry more than characters, `y0` and `y1`
their common height. Lines follow each other, so a place is found by halving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running, up_to

LINES = "array<struct<start:bigint,stop:bigint,y0:double,y1:double,x0:array<double>,x1:array<double>>>"
KEY = ["doc_id", "page_no", "block_no"]


def of_characters(chars: DataFrame) -> DataFrame:
    """Blocks of characters (doc_id, page_no, block_no, line_no, char_seq, c, x0, y0, x1, y1); those of a line without a box, such as newlines, are left out."""
    kept = chars.filter("x0 IS NOT NULL AND c <> '\\n'")
    per_line = kept.groupBy(*KEY, "line_no").agg(F.array_sort(F.collect_list(F.struct("char_seq", "c", "x0", "x1"))).alias("cs"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    per_block = per_line.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("line_no", "cs", "y0", "y1"))).alias("ls"))
    text = lambda cs: F.array_join(F.transform(cs, lambda x: x["c"]), "")
    lines = F.transform("ls", lambda x: F.struct(text(x["cs"]).alias("text"), x["y0"].alias("y0"), x["y1"].alias("y1"), F.transform(x["cs"], lambda c: c["x0"]).alias("x0"), F.transform(x["cs"], lambda c: c["x1"]).alias("x1")))
    return per_block.select(*KEY, lines.alias("_ls")).select(*KEY, F.array_join(F.transform("_ls", lambda x: x["text"]), "\n").alias("text"), _placed(F.col("_ls")).alias("lines"))


def pages_of(docs: DataFrame, lines_per_page: int = 50) -> DataFrame:
    """doc_id, page_no, block_no, text: the pages of plain texts, blocks whose lines follow from their text (that of layout.lay_out)."""
    all_lines = docs.select("doc_id", F.split("text", "\n", -1).alias("_l"))
    own = lambda p: F.slice("_l", (p * lines_per_page + 1).cast("int"), F.lit(lines_per_page))
    pages = all_lines.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / lines_per_page)), lambda p: F.array_join(own(p), "\n"))).alias("_p", "text"))
    return pages.select("doc_id", (F.col("_p") + 1).alias("page_no"), F.lit(0).alias("block_no"), "text")


def of_texts(docs: DataFrame, char_width: float = 6.0, leading: float = 12.0, lines_per_page: int = 50) -> DataFrame:
    """A block for each page of plain texts in a fixed-width layout (that of layout.lay_out)."""
    all_lines = docs.select("doc_id", F.split("text", "\n", -1).alias("_l"))
    pages = all_lines.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / lines_per_page)), lambda p: F.struct((p + 1).cast("int").alias("no"), F.slice("_l", (p * lines_per_page + 1).cast("int"), F.lit(lines_per_page)).alias("ls")))).alias("_p"))
    steps = lambda t, k: F.when(F.char_length(t) > 0, F.transform(F.sequence(F.lit(0), F.char_length(t) - 1), lambda i: (i + k) * F.lit(char_width))).otherwise(F.array().cast("array<double>"))
    lines = F.transform("_p.ls", lambda t, i: F.struct(t.alias("text"), (i * F.lit(leading)).alias("y0"), ((i + 1) * F.lit(leading)).alias("y1"), steps(t, 0).alias("x0"), steps(t, 1).alias("x1")))
    return pages.select("doc_id", F.col("_p.no").alias("page_no"), F.lit(0).alias("block_no"), F.array_join("_p.ls", "\n").alias("text"), _placed(lines).alias("lines"))


def _placed(lines: Column) -> Column:
    """Lines (text, y0, y1, x0, x1) with where they start and stop in the text that they make up."""
    sizes = lambda ls: F.transform(ls, lambda x: (F.char_length(x["text"]) + 1).cast("bigint"))
    return let(lines, lambda ls: F.zip_with(ls, running(sizes(ls), lambda a, n: a + n), lambda x, at: F.when(x.isNotNull(), F.struct(at.alias("start"), (at + F.char_length(x["text"])).alias("stop"), x["y0"].alias("y0"), x["y1"].alias("y1"), x["x0"].alias("x0"), x["x1"].alias("x1"))))).cast(LINES)


def fixed(text: Column, leading: float = 12.0) -> Column:
    """The lines of a plain text in a fixed-width layout: where each starts and stops, and its height."""
    sizes = lambda ls: F.transform(ls, lambda t: (F.char_length(t) + 1).cast("bigint"))
    numbered = lambda ls: F.transform(ls, lambda t, i: F.struct(F.char_length(t).alias("n"), (i * F.lit(leading)).alias("y")))
    return let(F.split(text, "\n", -1), lambda ls: F.zip_with(numbered(ls), running(sizes(ls), lambda a, n: a + n), lambda x, at: F.when(x.isNotNull(), F.struct(at.alias("start"), (at + x["n"]).alias("stop"), x["y"].alias("y0"), (x["y"] + leading).alias("y1")))))


def boxes(lines: Column, start: Column, stop: Column, char_width: float | None = None) -> Column:
    """The rectangles of a span, one for each line in which it has characters. char_width: that of lines without edges, as `fixed` gives them."""

    def cut(x: Column) -> Column:
        a, z = F.greatest(x["start"], start) - x["start"], F.least(x["stop"], stop) - x["start"]
        if char_width is not None:
            return F.struct(F.when(z > a, a * F.lit(char_width)).alias("x0"), x["y0"].alias("y0"), (z * F.lit(char_width)).alias("x1"), x["y1"].alias("y1"))
        own = lambda side: F.slice(x[side], (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))
        return F.struct(F.array_min(own("x0")).alias("x0"), x["y0"].alias("y0"), F.array_max(own("x1")).alias("x1"), x["y1"].alias("y1"))

    # Lines from the first that stops behind the span's start to the last that starts before its end.
    def between(ls: Column) -> Column:
        first = up_to(F.transform(ls, lambda x: x["stop"]), start)
        last = up_to(F.transform(ls, lambda x: x["start"]), stop - 1)
        return F.filter(F.transform(F.slice(ls, first + 1, F.greatest(last - first, F.lit(0))), cut), lambda b: b["x0"].isNotNull())

    return let(F.filter(lines, lambda x: x.isNotNull()), between)


def rects(blocks: DataFrame, column: str = "spans", char_width: float = 6.0) -> DataFrame:
    """doc_id, page_no, rule and rectangle of the spans (an array column) of blocks: each span is cut at line ends. Blocks without a column of lines are plain texts in a fixed-width layout. No shuffle."""
    if "lines" in blocks.columns:
        char_width = None
    else:
        blocks = blocks.filter(F.size(column) > 0).withColumn("lines", fixed(F.col("text")))
    each = blocks.select("doc_id", "page_no", "lines", F.explode(column).alias("_x"))
    out = each.select("doc_id", "page_no", F.col("_x.rule").alias("rule"), F.explode(boxes(F.col("lines"), F.col("_x.start"), F.col("_x.stop"), char_width)).alias("_b"))
    return out.select("doc_id", "page_no", "rule", "_b.x0", "_b.y0", "_b.x1", "_b.y1")
