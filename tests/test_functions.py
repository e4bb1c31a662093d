import re

import pytest
from pyspark.sql import functions as F

from veil.functions import text as t
from veil.functions.validate import kind_of, name_shape, numeric_noise, phone_shape
from veil.operators import detect, gazetteer, spans


def column(spark, values, make):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", make(F.col("v")).alias("x")).collect()
    return {r.v: r.x for r in rows}


REJECTED = ["and disinfection practices play a critical", "commercial use.", "nationalhospitalconfirmedthatthelackof", "develo", "programs,", "weights)", "Assistant25", "Date:", "CF20191266", ""]
ACCEPTED = ["Adrian Fenwick", "Alice Kennedy", "Harker", "O'Toole", "John Doe", "J.", "J. L.", "Radcliffe", "Jean-Claude", "Benedetti", "Smith Jr."]


def test_name_shapes(spark):
    assert column(spark, REJECTED + ACCEPTED, name_shape) == {v: False for v in REJECTED} | {v: True for v in ACCEPTED}


def test_noise_and_kinds(spark):
    assert column(spark, ["12", "A1", "Date:", "Anne-Marie", "J.T."], numeric_noise) == {"12": True, "A1": True, "Date:": True, "Anne-Marie": False, "J.T.": False}
    assert column(spark, ["2021-1778", "+353 1 555 0142", "123456789012345", "1234567890123456", "1234567", "12 345 67"], phone_shape) == {"2021-1778": False, "+353 1 555 0142": True, "123456789012345": True, "1234567890123456": False, "1234567": False, "12 345 67": True}
    assert column(spark, ["a.b@example.com", "555-010-0142", "Jane Roe"], kind_of) == {"a.b@example.com": "email", "555-010-0142": "phone", "Jane Roe": "name"}


@pytest.mark.parametrize(
    "name,text,found",
    [
        ("Elena", "Contact Name:Elena Vasquez, Head of Research", "Elena"),
        ("Priya", "priya.nandakumar@example.com", "priya"),
        ("E.V.", "Reviewed by E.V. Vasquez", "E.V."),
        ("Del", "Delivery of goods", None),
        ("Croix", "Marcus Delacroix", None),
        ("O'Whitmore", "Mary O’Whitmore", "O'Whitmore"),
        ("Priya Nandakumar", "Priya  Nandakumar", "Priya  Nandakumar"),
        ("Priya Nandakumar", "Priya\nNandakumar", "Priya\nNandakumar"),
    ],
)
def test_listed_names(spark, name, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.matched for r in detect.listed(docs, [name]).collect()] == ([found] if found else [])


def test_spans(spark):
    text = "é a@b.example.com, call 555-010-0142 😀 a@b.example.com"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none")], "doc_id long, text string")
    found = detect.blanket(docs)
    assert all(text[r.start : r.stop] == r.matched for r in found.collect()) and found.count() == 3
    clean = {r.doc_id: r.text for r in spans.redacted(docs, found).collect()}
    assert clean == {1: "é REDACTED, call REDACTED 😀 REDACTED", 2: None, 3: "", 4: "none"}
    assert detect.blanket(spans.redacted(docs, found)).count() == 0  # nothing left, and masking again changes nothing
    overlapping = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (1, 6, 8), (1, 10, 12)], "doc_id long, start long, stop long")
    assert sorted(map(tuple, spans.merged(overlapping).collect())) == [(1, 0, 8), (1, 10, 12)]
    exceptions = spark.createDataFrame([(1, 7, 11)], "doc_id long, start long, stop long")
    assert sorted((r.start, r.stop) for r in spans.without(overlapping, exceptions).collect()) == [(0, 4), (2, 6)]


def test_curated_and_blanket(spark):
    docs = spark.createDataFrame([(1, "a@b.example.com c@d.example.com")], "doc_id long, text string")
    nothing = spark.createDataFrame([], "value string")
    one = spark.createDataFrame([("A@B.example.com",)], "value string")
    assert detect.curated_or_blanket(docs, None, t.EMAIL, "email").count() == 2
    assert detect.curated_or_blanket(docs, nothing, t.EMAIL, "email").count() == 0
    assert [r.matched for r in detect.curated_or_blanket(docs, one, t.EMAIL, "email").collect()] == ["a@b.example.com"]


def test_gazetteers(spark):
    docs = spark.createDataFrame([(1, "Name:Elena (JaneDoe) met Jane  Doe, Delacroix"), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([("Elena",), ("Jane Doe",), ("Croix",)], "value string")
    assert sorted(r.name for r in gazetteer.runs(docs, names).collect()) == ["Elena", "Jane Doe", "Jane Doe"]
    assert gazetteer.single(docs, names).count() == 0
    assert [r.name for r in gazetteer.ngrams(docs, names).collect()] == ["Jane Doe"]


def test_names_of_any_length(spark):
    docs = spark.createDataFrame([(1, "(José Núñez) met JürgenMüller, Jean-Claude O'Neil and J. R. R. Tolkien; Anna Maria von der Heide came")], "doc_id long, text string")
    listed = ["José Núñez", "Jürgen Müller", "Jean-Claude O'Neil", "J. R. R. Tolkien", "Anna Maria von der Heide"]
    names = spark.createDataFrame([(n,) for n in listed], "value string")
    assert sorted(r.name for r in gazetteer.runs(docs, names).collect()) == sorted(listed)
    assert [(r.n, r.name) for r in gazetteer.ngrams(docs, names).collect() if r.n > 2] == [(5, "Anna Maria von der Heide")]
    none = spark.createDataFrame([], "value string")
    assert gazetteer.runs(docs, none).count() == gazetteer.ngrams(docs, none).count() == 0


def test_snippets_and_paths(spark):
    df = spark.createDataFrame([("x" * 50 + " \n mid " + "y" * 60, "in/A.PDF")], "text string, path string")
    r = df.select(t.snippet(F.col("text"), F.lit(53), F.lit(56), 5).alias("s"), t.redacted_path(F.col("path")).alias("p"), t.occurrences(F.col("text"), F.lit("yy")).alias("n")).first()
    assert re.sub(r"\s+", " ", r.s) == r.s and "mid" in r.s and r.p == "in/A_REDACTED.PDF" and r.n == 30
