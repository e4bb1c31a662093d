"""Listed values that are left: counts of rows are whole, and those of fields that several rows have are added up."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veil.functions import text as t
from veil.operators.spans import found
from veil.plans import redact

DOCS = [(1, "Jane Doe, jane doe"), (2, "Jane\nDoe"), (2, "JaneDoe Ann Lee"), (None, "Ann Lee"), (None, "ann lee"), (3, None), (4, "Jane Doe")]
META = [(1, {"author": "Jane Doe", "text": "Jane Doe"}), (2, {"author": "x"}), (4, {"author": "Ann Lee"}), (4, {"author": "Ann Lee", "title": None})]


def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(META, "doc_id long, props map<string,string>")


@pytest.mark.parametrize("most", [0, 1, 1_000_000])
def test_fields_of_several_rows(spark, monkeypatch, most):
    monkeypatch.setattr(redact, "BROADCAST_FIELDS", most)
    docs, meta = tables(spark)
    want = {(1, "text", "Jane Doe", 3), (1, "author", "Jane Doe", 1), (2, "text", "Jane Doe", 2), (2, "text", "Ann Lee", 1), (None, "text", "Ann Lee", 2), (4, "text", "Jane Doe", 1), (4, "author", "Ann Lee", 2)}
    got = [tuple(r) for r in redact.survivors(docs, ["Jane Doe", "Ann Lee"], meta).collect()]
    assert set(got) == want and len(got) == len(want)


def test_hits_are_not_exchanged(spark):
    docs, meta = tables(spark)
    own = docs.filter("doc_id in (1, 4)"), meta.filter("doc_id = 2")
    out = redact.survivors(own[0], ["Jane Doe"], own[1])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "text", "Jane Doe", 2), (4, "text", "Jane Doe", 1)]


def test_texts_are_searched_only_for_what_they_can_hold(spark):
    draw, link = random.Random(5), t.link_to("example.com")
    some = ["+353", "1", "555", "0142", "(02)", "-", ".", " ", "a@b.example.com", "www.example.com/x", "exampleXcom", "x", "＋", "٣", "12345678"]
    rows = [(k, "".join(draw.choice(some) for _ in range(draw.randrange(12)))) for k in range(400)] + [(400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    patterns = (t.EMAIL, t.PHONE, link)
    got = {r.doc_id: r for r in docs.select("doc_id", t.masked(F.col("text"), patterns).alias("m"), found(F.col("text"), t.PHONE, "phone").alias("p")).collect()}
    for k, text in rows:
        if text is None:
            assert got[k].m is None and not got[k].p
            continue
        assert [(s.start, s.stop) for s in got[k].p] == [m.span() for m in re.finditer(t.PHONE, text, re.ASCII)]
        for p in patterns:
            text = re.sub(p, t.LABEL, text, flags=re.ASCII)
        assert got[k].m == text
    plan = docs.select(t.masked(F.col("text"), patterns))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("contains(") + plan.count("Contains(") >= 2
