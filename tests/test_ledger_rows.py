"""Ledgers with a row for each document, and characters that spans have."""

import random

from pyspark.sql import functions as F

from veil.functions.text import PLAIN, TYPESET
from veil.operators import detect, spans, substrings
from veil.plans import ledger, redact

DOCS = "doc_id long, text string"


def test_ledgers_with_a_row_for_each_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail a{i}@b.example.com and c@d.example.com or 020 7946 00{i:02d}") for i in range(20)] + [(20, "none"), (21, None), (3, "mail")], DOCS)
    rows = ["doc_id", "spans"]
    try:
        found = ledger.store(detect.scanned(docs, names=["mail", "mail a3"]).filter("size(spans) > 0"), "rows_found", f"file://{tmp_path}/a", 4, rows)
        safe = ledger.store(detect.scanned(docs, on=(), names=["c@d.example.com"]).filter("size(spans) > 0"), "rows_safe", f"file://{tmp_path}/b", 4, rows)
        report = ledger.report(found, safe)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        got = {(r.doc_id, r.rule): (r.n, r.masked_chars) for r in report.collect()}
        assert len(got) == 60 and got[3, "name"] == (3, 7) and got[4, "name"] == (1, 4) and got[4, "email"] == (1, 16) and got[4, "phone"] == (1, 13)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("rows_found", "rows_safe"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_buckets_grow_with_the_input(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "repeat('a ', 50) AS text").repartition(20).write.parquet(f"file://{tmp_path}/docs")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        assert ledger.buckets_for(spark.range(1)) == 8
        assert ledger.buckets_for(spark.read.parquet(f"file://{tmp_path}/docs")) >= 20
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_exception_that_is_a_rule_is_looked_for_once(spark):
    docs = spark.createDataFrame([(1, "www.b.example/0207946001 and 020 7946 0018 x9"), (2, "none"), (3, None)], DOCS)
    rules = {"link": r"www\.\S+", "phone": r"\d[\d ]{8,}\d"}
    same, other = ({"link": r"www\.\S+"}, {"link": r"www\.\S+", "x": "x9"})
    got = {k: [(x.rule, x.matched) for x in detect.scanned(docs, rules, ("link", "phone"), exceptions=e, names=["x9", "and"]).first().spans] for k, e in (("same", same), ("other", other))}
    assert got["same"] == [("phone", "020 7946 0018"), ("name", "and"), ("name", "x9")] and got["other"] == [("phone", "020 7946 0018"), ("name", "and")]
    assert [(x.rule, x.matched) for x in detect.scanned(docs, rules, ("phone",), exceptions=same).first().spans] == [("phone", "020 7946 0018")]
    plan = redact.report(docs, rules=rules, on=("link", "phone"), exceptions=same)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 2, plan


def test_characters_that_spans_have(spark):
    draw = random.Random(7)
    rows = [(i, [(a, a + draw.randrange(6)) for a in (draw.randrange(60) for _ in range(n))]) for i, n in enumerate([0, 1, 2, 5, 20, 60] * 5)]
    df = spark.createDataFrame(rows, "i int, s array<struct<start:bigint,stop:bigint>>").select("i", spans.covered(F.col("s")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: len({k for a, z in s for k in range(a, z)}) for i, s in rows}


def test_typeset_marks_are_plain():
    text = "".join(TYPESET) + "O’Neil — “x” 😀\0é"
    assert substrings._plain(text) == text.translate(str.maketrans(TYPESET, PLAIN)) and substrings._plain("é") == "é"
