"""Places in texts that survive folding, lists of any length, boxes of characters, rectangles that meet."""

import random
import re
import time
from collections import Counter
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veil.functions import fold
from veil.functions.arrays import up_to
from veil.operators import blocks, detect, gazetteer, spans, substrings
from veil.operators.substrings import Finder
from veil.plans import redact, redact_layout

DOCS = "doc_id long, text string"
BOX = "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double"


def values(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "value string")


def test_folding_keeps_places_in_all_of_unicode(spark):
    known = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    rows = ["".join(known[k : k + 997]) for k in range(0, len(known), 997)]
    table = fold.table(False)
    for r in spark.createDataFrame(list(enumerate(rows)), DOCS).select("text", fold.folded(F.col("text")).alias("f")).collect():
        assert len(r.f) == len(r.text)
        assert r.f == "".join(map(chr, fold.looked_up(table, fold.codes_of(r.text))))


def test_redaction_after_characters_with_longer_lower_case(spark):
    text = "İ İ Anna Berg here, ΑΝΝΑΣ and annas"
    docs = spark.createDataFrame([(1, text)], DOCS)
    found = gazetteer.spans_of_names(docs, values(spark, "Anna Berg"))
    assert [(r.start, r.stop) for r in found.collect()] == [(4, 13)]
    assert spans.redacted(docs, found).first().text == "İ İ REDACTED here, ΑΝΝΑΣ and annas"
    assert redact.redact_all(docs, names=["ANNA BERG", "αννας"]).first().text == "İ İ REDACTED here, REDACTED and annas"


def plain_places(text, listed, blanks, bounds):
    out = []
    for v in listed:
        own = v.strip()
        middle = (r"\s*" if blanks else "").join(map(re.escape, own.split() if blanks else [own]))
        if bounds == "names":
            middle = ("(?<![0-9A-Za-z])" if own[0].isalnum() else "") + middle + ("(?![0-9A-Za-z])" if own[-1].isalnum() else "")
        elif bounds == "words":
            middle = rf"\b{middle}\b"
        out += [(m.start(), m.end(), v) for m in re.finditer(middle, text, re.I)]
    return sorted(out)


@given(st.lists(st.text("abAB. \nİé1", min_size=1, max_size=8).filter(str.strip), max_size=8, unique=True), st.text("abAB. \nİé1", max_size=60), st.booleans(), st.sampled_from([None, "names", "words"]), st.booleans())
@settings(max_examples=400, deadline=None)
def test_a_list_finds_what_a_pattern_for_each_value_finds(listed, text, blanks, bounds, sampled):
    finder = Finder(listed, blanks, bounds, [text] if sampled else [])
    assert sorted((a, z, finder.values[v]) for a, z, v in finder.places(text)) == plain_places(text, listed, blanks, bounds)


def test_search_inside_words(spark):
    docs = spark.createDataFrame([(1, "MrJaneDoe signed. xJane Doe. Ja ne Doe"), (2, None), (3, "")], DOCS)
    assert [r.matched for r in detect.name_search(docs, ["Jane Doe"], "text").collect()] == ["JaneDoe", "Jane Doe"]
    assert [tuple(r) for r in redact.survivors(docs, values(spark, "Jane Doe")).collect()] == [(1, "text", "Jane Doe", 2)]
    assert detect.name_search(docs, [], "text").count() == detect.name_search(docs, values(spark), "text").count() == 0
    assert sorted(r.matched for r in detect.literal(docs, values(spark, "e d", "NED")).collect()) == ["e D", "e D", "neD", "ned"]
    meta = spark.createDataFrame([(1, {"a": None, "b": "x jane doe"}, "<x>JaneDoe</x>", ["jane  doe.txt", None])], "doc_id long, props map<string,string>, xmp string, attachments array<string>")
    assert sorted(r.field for r in detect.metadata_search(meta, ["Jane Doe"]).collect()) == ["attachment", "b", "xmp"]


def test_lists_in_several_tables_and_long_lists(spark):
    rnd = random.Random(3)
    listed = sorted({"".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 12))) for _ in range(300)})
    texts = ["".join(rnd.choice("abcdefghij   ") for _ in range(200)) + rnd.choice(listed) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    want = sorted((i, *x) for i, text in enumerate(texts) for x in plain_places(text, listed, True, None))
    for most in (10_000, 70):
        got = substrings.places(docs, values(spark, *listed), most=most)
        assert sorted((r.doc_id, r.start, r.stop, r.rule) for r in got.collect()) == want


def test_time_grows_far_slower_than_the_list():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(5, 14)))
    text = " ".join(word() for _ in range(20_000))
    took = {}
    for n in (100, 100_000):
        finder = Finder(sorted({word() for _ in range(n)}), True, None)
        began = time.monotonic()
        for _ in range(3):
            finder.places(text)
        took[n] = time.monotonic() - began
    assert took[100_000] < 20 * took[100]


@pytest.mark.parametrize("text", ["a" * 300_000, "ab " * 100_000, "x" + "İ" * 300_000])
def test_a_long_text_of_one_thing(text):
    began = time.monotonic()
    finder = Finder(["a", "aa", "ab", "ab ab ab", "İİ", "b" * 5000, "a" * 5000], True, None)
    assert finder.places(text) and time.monotonic() - began < 60


def test_exceptions_mean_one_thing_whatever_the_list(spark):
    v = values(spark, "a--b", "a - b", "The Report", "reports")
    few = [(p,) for p in ("--", "REPORT")]
    many = few + [(f"phrase {k}",) for k in range(300)]
    for phrases in (few, many):
        assert sorted(r.value for r in detect.without_exceptions(v, spark.createDataFrame(phrases, "value string")).collect()) == ["a - b", "reports"]


def test_exceptions_in_the_row(spark):
    text = "mail a@b.example.com or c@d.example.com, 020 7946 0018 and Anna Berg"
    docs = spark.createDataFrame([(1, text), (2, None)], DOCS)
    assert redact.redact_all(docs, exceptions=["b.example", "7946"], names=["Anna Berg"]).first().text == "mail a@b.example.com or REDACTED, 020 7946 0018 and REDACTED"
    r = redact.report(docs, exceptions=["b.example", "7946"], names=values(spark, "Anna Berg")).first()
    assert (r.n_email, r.n_phone, r.n_name, r.masked_chars) == (1, 0, 1, 15 + 9)
    assert redact.detections(docs, exceptions={"link": r"\d+"}).count() == 2
    plan = redact.report(docs, exceptions={"link": r"\d+"})._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert sorted((x.matched, x.excepted) for x in redact.leaks(docs, exceptions=["b.example"]).collect()) == [("020 7946 0018", False), ("a@b.example.com", True), ("c@d.example.com", False)]
    assert detect.rules_on(names=True, boilerplate=True) == ("email", "phone", "link", "name", "boilerplate")


def span_lists(least):
    return st.lists(st.tuples(st.integers(0, 30), st.integers(least, 5)), max_size=12)


@given(st.lists(st.tuples(span_lists(1), span_lists(0)), min_size=1, max_size=20))
@settings(max_examples=10, deadline=None, phases=[Phase.generate])
def test_sweep_of_spans(spark, data):
    pair = "array<struct<start:bigint,stop:bigint>>"
    rows = [(i, [(a, a + n) for a, n in s], [(a, a + n) for a, n in e]) for i, (s, e) in enumerate(data)]
    df = spark.createDataFrame(rows, f"i int, s {pair}, e {pair}")
    for r in df.select("i", "s", "e", spans.clear_of(F.col("s"), F.col("e")).alias("x")).collect():
        assert [tuple(x) for x in r.x] == [tuple(x) for x in r.s if not any(x.start < y.stop and y.start < x.stop for y in r.e)]


def test_halving(spark):
    df = spark.createDataFrame([([], 3), ([3], 3), ([1, 3, 3, 9], 3), ([4, 5], 3), (list(range(1000)), 711)], "a array<long>, v long")
    assert [r[0] for r in df.select(up_to(F.col("a"), F.col("v"))).collect()] == [0, 1, 3, 0, 712]


def test_boxes_of_spans(spark):
    line = lambda no, y, cs: [(1, 1, 0, no, k, c, None if c == "\n" else 10.0 + 7 * k, None if c == "\n" else y, None if c == "\n" else 17.0 + 7 * k, None if c == "\n" else y + 9) for k, c in enumerate(cs)]
    chars = spark.createDataFrame(line(0, 20.0, "by Jane\n") + line(1, 40.0, "Doe") + line(2, 60.0, "x"), "doc_id long, page_no int, block_no int, line_no int, char_seq int, c string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    block = blocks.of_characters(chars)
    assert block.first().text == "by Jane\nDoe\nx"
    got = blocks.rects(substrings.marked(block, ["jane doe", "x"], "name", bounds="names"))
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got.collect()) == [(10.0, 40.0, 31.0, 49.0), (10.0, 60.0, 17.0, 69.0), (31.0, 20.0, 59.0, 29.0)]
    texts = spark.createDataFrame([(1, "\n\nAnna\n\n Berg"), (2, None), (3, "")], DOCS)
    got = blocks.rects(substrings.marked(blocks.of_texts(texts, lines_per_page=10), ["Anna Berg"], "name", bounds="names"))
    assert sorted((r.page_no, r.x0, r.y0, r.x1) for r in got.collect()) == [(1, 0.0, 24.0, 24.0), (1, 0.0, 48.0, 30.0)]


def test_rectangles_that_meet(spark):
    rnd = random.Random(5)
    box = lambda sizes: (p := rnd.randint(1, 3), x := rnd.uniform(-50, 900), y := rnd.uniform(-50, 900), x + rnd.choice(sizes), y + rnd.choice(sizes))
    rows = [box([0.0, 5.0, 48.0, 96.0, 300.0]) for _ in range(300)] + [(1, 0.0, 0.0, 48.0, 48.0), (1, 0.0, 0.0, 48.0, 48.0), (2, -1e12, -1e12, 1e12, 1e12)]
    rects = [box([3.0, 48.0, 200.0, 1000.0]) for _ in range(25)] + [(1, 48.0, 0.0, 60.0, 48.0), (9, 0.0, 0.0, 9.0, 9.0)]
    a, b = (spark.createDataFrame([(1, *x) for x in data], BOX) for data in (rows, rects))
    meet = lambda x, y: x[0] == y[0] and x[1] < y[3] and y[1] < x[3] and x[2] < y[4] and y[2] < x[4] and x[1] < x[3] and x[2] < x[4]
    want = sorted((1, *x) for x in rows if not any(meet(x, y) for y in rects))
    assert sorted(map(tuple, redact_layout.redacted(a, b).collect())) == want


def test_a_crowded_page(spark):
    n = 100_000
    words = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), ((F.col("id") % 400) * 12.0).alias("x0"), (F.floor(F.col("id") / 400) * 14.0).alias("y0")).withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 10})
    rects = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), ((F.col("id") % 100) * 48.0).alias("x0"), (F.floor(F.col("id") / 100) * 35.0).alias("y0")).withColumns({"x1": F.col("x0") + 5, "y1": F.col("y0") + 5})
    began = time.monotonic()
    left = redact_layout.redacted(words, rects).count()
    assert 0 < n - left <= 40_000 and time.monotonic() - began < 60


def test_counts_are_those_of_the_places_and_a_task_holds_few(spark, monkeypatch):
    """Texts that are searched side by side keep their own places, and no place reaches into the next text."""
    listed = ["ab", "a", "ab ab", "xy", "x\0y", "abcdef gh"]
    texts = ["ab aba", "b", None, "", "ABCDEFGH x", "y xy", "a" * 70] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for options in ({}, {"bounds": "names"}, {"blanks": False}):
        rows = substrings.places(docs, listed, **options).collect()
        want = Counter((r.doc_id, r.rule) for r in rows)
        assert want == Counter({(i, v): n for i, t in enumerate(texts) if t for v, n in Counter(x[2] for x in plain_places(t, listed, options.get("blanks", True), options.get("bounds"))).items()})
        got = substrings.counted(docs, listed, **options).collect()
        assert {(r.doc_id, r.value): r.n for r in got} == want and len(got) == len(want)
        assert all(r.places == sum(x.start for x in rows if (x.doc_id, x.rule) == (r.doc_id, r.value)) for r in got)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(substrings, "HELD", 50)
    monkeypatch.setattr(substrings, "SEARCHED", 20)
    held = list(substrings._held(iter([batch]), Finder(listed, True, None)))
    assert len(held) > 5 and sum(b.num_rows for b, _ in held) == len(texts) and max(sum(len(p[2]) for p in parts) for _, parts in held) < 200


def test_plain_pages_have_the_boxes_of_their_characters(spark):
    docs = spark.createDataFrame([(1, "Anna\nBerg x Anna Berg\n\nAnna" + "\nq" * 9 + " Anna Berg"), (2, ""), (3, None)], "doc_id long, text string")
    mine, whole = (blocks.rects(substrings.marked(b, ["Anna Berg"], "name", bounds="names")) for b in (blocks.pages_of(docs, 10), blocks.of_texts(docs, lines_per_page=10)))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, whole.collect())) and mine.count() == 4
