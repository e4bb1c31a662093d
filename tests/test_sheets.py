"""Pages read side by side: their rectangles and the words that are left, as tables of words and rectangles have them."""

import random
import time

import duckdb
from pyspark.sql import functions as F

from veil.operators import blocks, layout, sheets, substrings
from veil.plans import queries, redact_layout

SIDES = ("doc_id", "page_no", "x0", "y0", "x1", "y1")


def texts(spark, n=60):
    draw = random.Random(7)
    some = ["Anna", "Berg", "AnnaBerg", "anna", "berg,", "with", "from", "\U0001f600", "d’Arc", "D'Arc", "a@b.example.org", "555-010-0142", "x", "", "\t"]
    rows = [(k, "".join(draw.choice(some) + draw.choice(" \n" if k % 2 else "  \n ") for _ in range(draw.randrange(0, 300)))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "\n" * 120), (n + 2, "\0Anna\0Berg\0")], "doc_id long, text string")


def placed(rows, column):
    return sorted(map(tuple, rows.select("doc_id", "page_no", F.explode(column).alias("r")).select("doc_id", "page_no", "r.x0", "r.y0", "r.x1", "r.y1").collect()))


def test_pages_have_the_rectangles_and_words_of_the_plan(spark):
    docs, names = texts(spark), ["Anna Berg", "d'Arc", "Berg x"]
    pages = blocks.of_texts(docs)
    want = redact_layout.plan(redact_layout.Layout(pages, pages.select("doc_id", "page_no")), names=names, exceptions=["With", "from x"], on=("email", "phone", "link", "name")).persist()
    left = redact_layout.redacted(layout.lay_out(docs), want).persist()
    got = redact_layout.plain_pages(docs, names=names, exceptions=["With", "from x"]).persist()
    assert want.count() > 300 and placed(got, "rects") == sorted(map(tuple, want.select(*SIDES).collect()))
    assert left.count() > 300 and placed(got, "words") == sorted(map(tuple, left.select(*SIDES).collect()))
    text = got.select("doc_id", "page_no", F.explode("words").alias("w")).select("doc_id", "page_no", "w.text", "w.x0", "w.y0")
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, left.select("doc_id", "page_no", "text", "x0", "y0").collect()))
    assert got.count() == blocks.pages_of(docs).count()


def test_boxes_of_a_list(spark):
    docs, names = texts(spark), ["Anna Berg", "d'Arc", "Berg x"]
    want = blocks.rects(substrings.marked(blocks.of_texts(docs), names, "name", bounds="names")).drop("rule")
    got = sheets.boxed(blocks.pages_of(docs), names, bounds="names")
    assert want.count() > 300 and placed(got, "rects") == sorted(map(tuple, want.select(*SIDES).collect()))


def test_a_line_of_many_names_costs_in_proportion(spark):
    docs = spark.createDataFrame([(1, "anna berg " * 30_000)], "doc_id long, text string")
    began = time.time()
    got = redact_layout.plain_pages(docs, names=["Anna Berg"], exceptions=["berg anna"]).select(F.size("rects"), F.size("words")).collect()
    assert [tuple(r) for r in got] == [(0, 60_000)] and time.time() - began < 30
    got = redact_layout.plain_pages(docs, names=["Anna Berg"]).select(F.size("rects"), F.size("words")).collect()
    assert [tuple(r) for r in got] == [(30_000, 0)] and time.time() - began < 60


def test_a_place_of_two_names_has_one_rectangle(spark, tmp_path):
    """"thth is" and "th this" both stand in "ththis"."""
    rows = [(k, "Thth is. Th this. And ththis\nthere") for k in range(queries.OFTEN)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["name_rects"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE['name_rects']})").fetchall()
    assert len(want) == queries.OFTEN and sorted(map(tuple, got.collect())) == sorted(want)
