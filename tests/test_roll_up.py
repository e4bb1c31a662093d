"""The roll-up of finds: added up by numbers first, and once for all its readers."""

import random

from pyspark.sql import functions as F

from veil.functions.text import NEEDED
from veil.operators import candidates, detect
from veil.plans import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "kind string, value string, context string, source string, doc_id long, start long"


def test_first_sighting_by_place(spark):
    rng = random.Random(6)
    docs, starts = [None, -3, 0, 1, 2, 2**63 - 1, -(2**63)], [None, 0, 1, 7, 2**31, 2**63 - 1]
    rows = [(rng.choice(["name", "email"]), rng.choice(["Ann", "Bo", "x", None]), rng.choice(["ner", "regex", "table"]), rng.choice(docs), rng.choice(starts)) for _ in range(300)]
    rows += [("name", f"only {k}", "ner", rng.choice(docs), rng.choice(starts)) for k in range(50) for _ in range(3)]
    # A place and a source have one context, so that no tie is left open.
    finds = spark.createDataFrame([(k, v, f"{d} {s} {r}", r, d, s) for k, v, r, d, s in rows], SCHEMA)
    placed = candidates.roll_up(finds)
    plain = candidates.roll_up(finds, seed=spark.createDataFrame([], "kind string, value string, context string, source string, count long, confirmed boolean"))
    at = lambda d: sorted(map(repr, d.collect()))
    assert at(placed) == at(plain) and placed.schema == plain.schema
    named = finds.withColumn("doc_id", F.lpad(F.abs(F.col("doc_id") % 100).cast("string"), 2, "0"))  # places that are no numbers
    assert candidates.roll_up(named).count() == placed.count()


def test_finds_are_not_sorted_and_read_once(spark):
    found = candidates._placed_finds(queries.finds(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in found and "SortAggregate" not in found and "Sort [" not in found
    for name in ("review", "review_positions", "confidence"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "Relation [doc_id" not in plan  # documents are read below the table that is kept, and nowhere else


def test_texts_without_the_mark_of_a_rule_are_not_searched(spark):
    docs = spark.createDataFrame([(1, "to a@b.example.com, c@d.example.org"), (2, "a at b.example.com " * 50), (3, None), (4, "@")], "doc_id long, text string")
    found = detect.blanket(docs, on=("email",))
    assert sorted((r.doc_id, r.start, r.matched) for r in found.collect()) == [(1, 3, "a@b.example.com"), (1, 20, "c@d.example.org")]
    assert "Contains(text" in found._jdf.queryExecution().optimizedPlan().toString()
    assert all(mark in pattern for pattern, mark in NEEDED.items())
