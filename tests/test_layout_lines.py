"""Names of labels and tables in plain lines, which are not laid out, against those of their rows of words."""

import random

from pyspark.sql import functions as F

from veil.functions.fold import any_case
from veil.operators import layout


def at(found):
    return sorted(map(tuple, found.collect()))


def test_lines_give_the_names_of_rows(spark):
    rng = random.Random(5)
    parts = ["Name:", "name,", "NAME", "Full Name", "First\tName", "naming:", ":", "Ann", "Élan", "Bo B", "x", "Lee,", "Kim:", "Ng", "  ", "    ", "      ", "Name:\r", "😀 Name", "O'Neil"]
    line = lambda: rng.choice(["", " ", "   "]) + rng.choice([" ", " ", "  ", "   ", "    "]).join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    docs = spark.createDataFrame([(k, "\n".join(line() for _ in range(rng.randint(1, 130)))) for k in range(40)] + [(40, None), (41, ""), (42, "Name: Ada")], "doc_id long, text string")
    lines, rows = layout.lines_of_texts(docs), layout.rows_of_texts(docs)
    for options in ({}, {"marks": ",:"}, {"things": ("full",)}, {"word": lambda w: F.concat(w, F.lit("s"))}):
        for of in (layout.label_names, layout.table_names, layout.placed_names):
            assert at(of(lines, **options)) == at(of(rows, **options)) != []
    assert at(layout.label_names(lines, label="full name")) == at(layout.label_names(rows, label="full name"))


def test_only_lines_with_the_heading_are_laid_out(spark):
    docs = spark.createDataFrame([(1, "Full Name Staff\nAlice Kennedy Chair"), (2, "no heads")], "doc_id long, text string")
    assert [r.doc_id for r in layout.lines_of_texts(docs, "name").collect()] == [1]
    found = layout.table_names(layout.lines_of_texts(docs, "name"))
    assert {r.name for r in found.collect()} >= {"Alice Kennedy"}


def test_any_case_is_that_of_lower(spark):
    words = spark.createDataFrame([(w,) for w in ("KİN", "Kin", "kin", "KIN", "kın", "ſin")], "w string")
    got = words.select(F.col("w").rlike(any_case("ki")) == F.contains(F.lower("w"), F.lit("ki"))).collect()
    assert all(r[0] for r in got)
