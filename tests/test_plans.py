import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veil.functions import geometry, text as t
from veil.functions.arrays import running
from veil.operators import candidates, detect, entities, gate, gazetteer, layout, spans
from veil.plans import extract, redact, redact_layout
from veil.sources import lists

DOCS = "doc_id long, text string"
BOX = "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double"


def values(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "value string")


def test_running_sums_and_maxima(spark):
    data = [[], [5], list(range(200)), [3, -1, 7] * 100]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, v array<long>")
    for r in df.select("i", running(F.col("v"), lambda a, x: a + x).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect():
        own = data[r.i]
        assert r.s == [sum(own[:k]) for k in range(len(own) + 1)]
        assert r.m == [max([0, *own[:k]]) for k in range(len(own) + 1)]


@given(st.lists(st.text(st.sampled_from(list("ab@.c-_+ %1\n")), max_size=25), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_quick_patterns_find_the_same(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = sorted((r.doc_id, r.start, r.stop) for r in detect.blanket(docs, on=("email",)).collect())
    assert got == sorted((i, *m.span()) for i, x in enumerate(texts) for m in re.finditer(t.EMAIL, x))
    plain = r"[\w.+-]+@[\w-]+\.[\w.-]+"
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(gate.ADDRESS), F.lit(0))).alias("v"))
    assert sorted(map(tuple, found.collect())) == sorted((i, v) for i, x in enumerate(texts) for v in re.findall(plain, x))


def test_spans_in_rows(spark):
    data = [(1, "mail a@b.example.com, b@c.example.com 020 7946 0018"), (2, "none"), (3, None), (4, "😀 a@b.example.com")]
    docs = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: r.text for r in redact.redact_all(docs).collect()}
    assert got == {1: "mail REDACTED, REDACTED REDACTED", 2: "none", 3: None, 4: "😀 REDACTED"}
    assert [(r.doc_id, r.n_email, r.n_phone, r.masked_chars) for r in redact.report(docs).orderBy("doc_id").collect()] == [(1, 2, 1, 43), (4, 1, 0, 15)]
    assert redact.totals(redact.report(docs)).first().n_email == 3
    assert detect.rules_on(phones=False) == ("email", "link") and detect.rules_on(automated=False) == ()
    some = spark.createDataFrame([(1, [(5, 9), (0, 3), (9, 12), (2, 4), (20, 21)])], "i int, s array<struct<start:bigint,stop:bigint>>")
    assert [tuple(x) for x in some.select(spans.united(F.col("s")).alias("u")).first().u] == [(0, 4), (5, 12), (20, 21)]
    assert redact.leaks(redact.redact_all(docs)).count() == 0 and redact.leaks(docs).count() == 4


@pytest.mark.parametrize("kind", ["x", "a.", "0123456789abcdef", "a@", "1 ", " ", "\n"])
def test_a_megabyte_of_one_thing(spark, kind):
    docs = spark.createDataFrame([(1, kind * ((1 << 20) // len(kind)))], DOCS)
    start = time.monotonic()
    redact.report(docs).collect()
    redact.redact_all(docs).select(F.md5("text")).collect()
    detect.back_search(docs, t.EMAIL, "email").collect()
    gate.content(docs.select("doc_id", F.col("text").alias("line"))).collect()
    assert layout.lay_out(docs).count() == (len(docs.first().text.split()) if kind != "\n" else 0)
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("text,found", [
    ("Jane Doe, JaneDoe and jane\n doe", ["jane doe", "janedoe", "jane\n doe"]), ("Jane Doeson; Ja ne Doe; xJane Doe", []), ("O’Neil's", ["o'neil"]), ("(a@b.example.com)", ["a@b.example.com"]), ("", []),
])
def test_places_of_long_lists(spark, text, found):
    docs = spark.createDataFrame([(1, text), (2, None)], DOCS)
    got = gazetteer.spans_of_names(docs, values(spark, "Jane Doe", "O'Neil", "a@b.example.com", "a b c d e f")).orderBy("start").collect()
    assert [r.matched for r in got] == found
    assert all(text[r.start : r.stop].lower().replace("’", "'") == r.matched for r in got)


def test_curated_lists_find_what_no_pattern_does(spark):
    docs = spark.createDataFrame([(1, "write to user-at-home or c@d.example.com")], DOCS)
    assert [r.matched for r in detect.curated_or_blanket(docs, values(spark, "user-at-home"), t.EMAIL, "email").collect()] == ["user-at-home"]


def test_exceptions_in_values(spark, monkeypatch):
    v = values(spark, "The Annual Report", "Annualised", "Mr Report", "a.b(c)")
    for most in (200, 0):
        monkeypatch.setattr(detect, "MOST_PHRASES", most)
        assert sorted(r.value for r in detect.without_exceptions(v, values(spark, "annual", "B(", " ")).collect()) == ["Annualised", "Mr Report"]
        assert detect.without_exceptions(v, values(spark)).count() == 4


def test_what_survives(spark):
    docs = spark.createDataFrame([(1, "REDACTED met JaneDoe"), (2, "clean")], DOCS)
    meta = spark.createDataFrame([(2, {"author": "Jane Doe", "title": None})], "doc_id long, props map<string,string>")
    assert sorted(map(tuple, redact.survivors(docs, values(spark, "Jane Doe"), meta).collect())) == [(1, "text", "Jane Doe", 1), (2, "author", "Jane Doe", 1)]


def test_search_over_texts_and_properties(spark):
    docs = spark.createDataFrame([(1, "Jane  Doe and jane doe"), (2, "nobody")], DOCS)
    meta = spark.createDataFrame([(1, {"author": "by Jane Doe"}), (2, {"title": "x"})], "doc_id long, props map<string,string>")
    hits = detect.name_search(docs, ["Jane Doe", "Nobody else"], "text").unionByName(detect.metadata_search(meta, ["Jane Doe"]))
    assert [tuple(r) for r in extract.found_summary(hits).collect()] == [("Jane Doe", 1, 3)]
    row = extract.found_by_file(hits).first()
    assert [m.matched for m in row.text_matches] == ["jane doe", "Jane  Doe"] or [m.matched for m in row.text_matches] == ["Jane  Doe", "jane doe"]
    assert [(m.field, m.context) for m in row.metadata_matches] == [("author", "by Jane Doe")]


def test_redaction_on_the_layout(spark):
    rects = spark.createDataFrame([(1, 1, 0.0, 0.0, 480.0, 600.0), (1, 2, 10.0, 10.0, 50.0, 22.0), (1, 2, 10.0, 10.0, 50.0, 22.0), (1, 2, 100.0, 100.0, 104.0, 104.0), (1, 2, 300.0, 50.0, 300.0, 50.0)], BOX)
    exceptions = spark.createDataFrame([(1, 1, 5.0, 5.0, 9.0, 9.0), (1, 3, 0.0, 0.0, 9.0, 9.0)], BOX)
    kept = redact_layout.without_exceptions(rects, exceptions)
    assert {r.page_no for r in kept.collect()} == {2}  # a full page goes too
    assert sorted((r.x0, r.x1, r.y1, r.label) for r in redact_layout.applied(kept).collect()) == [(10.0, 50.0, 22.0, "REDACTED"), (100.0, 104.0, 104.0, ""), (300.0, 301.0, 51.0, "")]
    words = spark.createDataFrame([(1, 2, 20.0, 12.0, 40.0, 20.0), (1, 2, 50.0, 10.0, 60.0, 22.0), (1, 1, 20.0, 12.0, 40.0, 20.0)], BOX)
    assert sorted((r.page_no, r.x0) for r in redact_layout.redacted(words, kept).collect()) == [(1, 20.0), (2, 50.0)]
    assert [tuple(r) for r in redact_layout.totals(kept).collect()] == [(1, 2, 3)]


def test_a_rectangle_for_each_line(spark):
    schema = "doc_id long, page_no int, line_no int, word_no int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double"
    words = spark.createDataFrame([(1, 1, 0, 0, 0, "by", 0.0, 0.0, 12.0, 12.0), (1, 1, 0, 1, 1, "Jane", 18.0, 0.0, 42.0, 12.0), (1, 1, 1, 0, 2, "Doe", 0.0, 12.0, 18.0, 24.0)], schema)
    found = spark.createDataFrame([(1, 1, 1, 2, "name")], "doc_id long, page_no int, word_seq int, n int, rule string")
    got = redact_layout.rect_of_words(words, found)
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got.collect()) == [(0.0, 12.0, 18.0, 24.0), (18.0, 0.0, 42.0, 12.0)]


def test_names_of_all_sources(spark):
    schema = "doc_id long, label string, start int, stop int, text string, sent string, tokens array<struct<text:string,pos:string>>"
    people = [(1, "PERSON", 0, 10, "Adam Moran", "Adam Moran spoke.", [("Adam", "PROPN"), ("Moran", "PROPN")]), (1, "PERSON", 20, 21, "J", "J", [("J", "PROPN")]), (2, "ORG", 0, 3, "Acme", "Acme", [("Acme", "PROPN")])]
    docs = spark.createDataFrame([(1, "Adam Moran spoke. Moran left."), (2, "Name: Eve Stone")], DOCS)
    words = spark.createDataFrame([(2, 1, 0, k, w, 50.0 + 40 * k, 10.0, 80.0 + 40 * k, 22.0) for k, w in enumerate(["Name:", "Eve", "Stone"])] + [(2, 1, i, k, w, x, y, x + 40, y + 12) for i, y, row in ((3, 60.0, [(50.0, "Name"), (250.0, "Role")]), (4, 90.0, [(50.0, "Ada"), (250.0, "Lead")])) for k, (x, w) in enumerate(row)], "doc_id long, page_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    names = extract.by_source(docs, spark.createDataFrame(people, schema), words, values(spark, "stop"), values(spark, "track"), safe=values(spark, "J. R."))
    assert sorted((r.doc_id, r.name, r.source) for r in names.collect()) == [(1, "Adam", "ner"), (1, "Adam Moran", "ner"), (1, "J. R.", "ner"), (1, "Moran", "ner"), (2, "Ada", "table"), (2, "Eve Stone", "label")]
    added = extract.contributions(docs, names)
    assert {(r.name, r.n) for r in added.collect()} >= {("Moran", 2), ("Adam Moran", 1), ("Ada", 1)}
    assert {(r.name, r.docs, r.n) for r in extract.corpus_names(added).collect()} >= {("Moran", 1, 2)}
    assert {(r.value, r.source) for r in extract.finds(names, added).collect()} >= {("Moran", "ner"), ("Ada", "table"), ("Eve Stone", "table")}


def test_rectangles_and_lists(spark, tmp_path):
    df = spark.createDataFrame([(-5.0, 10.0, 700.0, 20.0, 600.0, 800.0)], "x0 double, y0 double, x1 double, y1 double, width double, height double")
    r = df.withColumns(geometry.clamped()).withColumns(geometry.shares()).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (0.0, 0.0125, 1.0, 0.025)
    pair = spark.createDataFrame([(0.0, 0.0, 9.0, 9.0, 1.0, 1.0, 9.0, 5.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    assert [tuple(x) for x in pair.select(geometry.contains("a", "b"), geometry.contains("b", "a")).collect()] == [(True, False)]
    c = spark.createDataFrame([("name", "Ada"), ("name", "Ada"), ("email", "a@b.c")], "kind string, value string")
    lists.write_lists(c, f"file://{tmp_path}/l")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/l").select("kind", "value").collect())) == [("email", "a@b.c"), ("name", "Ada")]
    assert lists.merged_lists(c, c).count() == 2
    files = spark.createDataFrame([("in/a/b.pdf",), ("else/c",)], "path string")
    assert [x[0] for x in files.select(lists.mirrored_path(F.col("path"), "in/", "out")).collect()] == ["out/a/b_REDACTED.pdf", "out/c"]
    assert [r.value for r in candidates.first_removed(candidates.cleaned_list(values(spark, "Ada", "x1", "the")), 1).collect()] == ["the"]
    assert sorted(r.name for r in entities.cleaned_up(spark.createDataFrame([(1, "J", ""), (1, "Ada", "")], "doc_id long, name string, sent string")).collect()) == ["Ada"]
