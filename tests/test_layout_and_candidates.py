import duckdb
import pytest
from pyspark.sql import functions as F

from veil.operators import boilerplate, candidates, entities, gate, layout, selections
from veil.plans import queries, redact
from veil.sources import lists
from veil.streaming.stream import candidate_stream, mask_stream

WORDS = "doc_id long, page_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"


def page(spark, rows):
    """Words of (y, [(x, text), ...]) rows, 6 points a character."""
    out = [(1, 1, i, k, w, float(x + 6 * sum(len(v) + 1 for v in ws[:k])), float(y), float(x + 6 * (sum(len(v) + 1 for v in ws[:k]) + len(w))), y + 12.0) for i, (y, cells) in enumerate(rows) for x, cell in cells for ws in [cell.split()] for k, w in enumerate(ws)]
    return spark.createDataFrame(out, WORDS)


def test_table_names(spark):
    found = layout.table_names(page(spark, [(60, [(50, "Name"), (250, "Role"), (400, "Institution")]), (90, [(50, "Alice Kennedy"), (250, "Lead")]), (120, [(50, "Adrian Fenwick"), (250, "Chair")])]))
    assert sorted(r.name for r in found.collect()) == ["Adrian Fenwick", "Alice Kennedy"]
    assert layout.table_names(page(spark, [(60, [(50, "Funding Body Name"), (250, "Year")]), (90, [(50, "Alice Kennedy"), (250, "Lead")])]), things=("funding", "body")).count() == 0
    assert [r.name for r in layout.table_names(page(spark, [(60, [(50, "#"), (120, "Full Name"), (350, "Affiliation")]), (90, [(50, "1"), (120, "Fiona Novak"), (350, "Lab")])])).collect()] == ["Fiona Novak"]


def test_label_names(spark):
    found = layout.label_names(page(spark, [(60, [(50, "Lead Applicant Name: Mark Whitfield Institution Name: Springfield Institute")])]))
    assert "Mark Whitfield" in [r.name for r in found.collect()]


def test_split_emails(spark):
    found = layout.split_emails(page(spark, [(60, [(50, "write to alex@ mail .example.com, or bob@mail.example.com")])]))
    assert {r.email for r in found.collect()} >= {"alex@mail.example.com", "bob@mail.example.com"}


@pytest.mark.parametrize("on,kept", [(9, True), (8, False)])
def test_text_templates(spark, on, kept):
    rows = [(1, p, 0, 0, "HEADER" if p <= on else f"other{p}", 0.0, 10.0, 36.0, 22.0) for p in range(1, 11)]
    words = spark.createDataFrame(rows, WORDS)
    assert [r.text for r in boilerplate.text_template(words).collect()] == (["HEADER"] if kept else [])
    assert boilerplate.text_template(words.filter("page_no = 1")).count() == 0


def test_signature_zones(spark):
    lines = spark.createDataFrame([(1, 1, "Kind  regards,", 100.0, 112.0), (1, 1, "sincerely", 200.0, 212.0), (1, 2, "hello", 10.0, 22.0), (1, 1, "yours faithfully", 700.0, 712.0)], "doc_id long, page_no int, text string, y0 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 800.0), (1, 2, 800.0)], "doc_id long, page_no int, height double")
    assert sorted((r.y0, r.y1) for r in boilerplate.signature_zones(lines, pages, ("regards", "sincerely", "faithfully")).collect()) == [(92.0, 344.0), (692.0, 800.0)]


def test_rect_templates(spark):
    pages = spark.createDataFrame([(1, p, 800.0) for p in range(1, 5)], "doc_id long, page_no int, height double")
    g = spark.createDataFrame([(1, p, 10.0, 5.0, 60.0, 30.0) for p in range(1, 4)] + [(1, 4, 11.5, 6.0, 61.0, 31.0), (1, 4, 10.0, 300.0, 60.0, 330.0)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    template = boilerplate.rect_template(g, pages)
    assert template.count() == 1 and boilerplate.rect_match(g, template).count() == 4 and boilerplate.zone_images(g, pages).count() == 4


def cands(spark, rows):
    return spark.createDataFrame(rows, "kind string, value string, context string, source string, count long, confirmed boolean")


def test_scores(spark):
    c = cands(
        spark,
        [("email", "a@b.example.com", "", "regex", 1, False), ("phone", "2021-1778", "", "regex", 1, False), ("phone", "+353 1 555 0142", "", "regex", 1, False), ("name", "Adrian Fenwick", "", "table", 1, False),
         ("name", "Adrian", "", "ner", 1, False), ("name", "Scott", "", "ner", 2, False), ("name", "Jane Roe", "", "ner", 9, False), ("name", "Kim", "", "manual", 1, False)],
    )
    common = spark.createDataFrame([("scott",)], "value string")
    got = {r.value: (r.score, r.tier) for r in candidates.annotated(c, common).collect()}
    assert got == {"a@b.example.com": (4, "High"), "2021-1778": (0, "Low"), "+353 1 555 0142": (3, "Medium"), "Adrian Fenwick": (6, "High"), "Adrian": (-1, "High"), "Scott": (-3, "Low"), "Jane Roe": (5, "High"), "Kim": (0, "High")}
    assert candidates.Weights().changed(email="7", table="x", nope=3) == candidates.Weights(email=7)


def test_curation(spark):
    finds = spark.createDataFrame([("name", "Ann", "late", "ner", 2, 5), ("name", "Ann", "early", "ner", 1, 9), ("name", "Ann", "t", "table", 3, 0), ("email", "x@y.example", "e", "regex", 1, 1)], "kind string, value string, context string, source string, doc_id long, start long")
    rolled = candidates.roll_up(finds, seed=cands(spark, [("email", "x@y.example", "seed", "saved", 2, False)]))
    assert {r.value: (r.context, r.source, r["count"], r.confirmed) for r in rolled.collect()} == {"Ann": ("early", "table", 3, False), "x@y.example": ("seed", "saved", 3, True)}
    kept = candidates.keep(rolled, rolled.filter("kind = 'name'"))
    assert [(r.value, r.confirmed) for r in kept.collect()] == [("Ann", True)]
    assert sorted((r.value, r.change) for r in candidates.difference(kept, rolled.filter("kind = 'email'")).collect()) == [("Ann", "add"), ("x@y.example", "remove")]
    grown = candidates.promote(kept, rolled, rolled)
    assert {r.value: r.source for r in grown.collect()} == {"Ann": "table", "x@y.example": "manual"}
    added = candidates.add_values(rolled, spark.createDataFrame([(" Ann ",), ("555-010-0142",), ("",)], "value string"))
    assert sorted((r.kind, r.value) for r in added.collect()) == [("email", "x@y.example"), ("name", "Ann"), ("phone", "555-010-0142")]


def test_entities(spark):
    schema = "doc_id long, label string, start int, stop int, text string, sent string, tokens array<struct<text:string,pos:string>>"
    person = lambda t, s=0: (1, "PERSON", s, s + len(t), t, f"About {t}.", [(w, "PROPN") for w in t.split()])
    ents = spark.createDataFrame([person("Adam Brennan"), person("Track"), person("Lead Applicant Name", 20), person("Prof Hale"), (1, "ORG", 0, 3, "Acme", "", [])], schema)
    docs = spark.createDataFrame([(1, "x" * 39 + " : more")], "doc_id long, text string")
    listed = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert sorted(r.name for r in entities.whole_names(ents, docs, listed("nothing"), listed("track")).collect()) == ["Adam Brennan", "Prof Hale"]
    assert "Prof" not in {r.name for r in entities.name_parts(ents, listed("prof")).collect()}


def test_page_lists(spark):
    specs = spark.createDataFrame([(1, "3,5-7, 10"), (2, "7-5"), (3, "x,2-")], "doc_id long, spec string")
    got = {}
    for r in selections.pages_of(specs).collect():
        got.setdefault(r.doc_id, set()).add(r.page_no)
    assert got == {1: {3, 5, 6, 7, 10}, 2: {5, 6, 7}}


def test_terms_are_literal(spark):
    docs = spark.createDataFrame([(1, r"a.c abc A.C \E x")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "a.c"), (1, r"\E"), (1, " ")], "doc_id long, term string")
    assert sorted(r.matched for r in selections.global_terms(docs, terms).collect()) == ["A.C", "\\E", "a.c"]


def test_gate_sees_every_document(spark, tmp_path):
    texts = [(i, f"plain line\nwrite to user{i}@real.example.org\ncall 020 7946 00{i:02d}") for i in range(10, 14)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["gate_masked"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.rule) for r in found} == {(i, rule) for i, _ in texts for rule in ("email", "phone")}


def test_gate(spark):
    now = spark.createDataFrame([(1, "old a@real.example.org\nnew b@real.example.org. and c@example.com\n+353 1 555 0142 or 020 7946 0018")], "doc_id long, text string")
    before = spark.createDataFrame([(1, "old a@real.example.org")], "doc_id long, text string")
    assert sorted((r.rule, r.value) for r in gate.content(gate.new_lines(now, before)).collect()) == [("email", "b@real.example.org"), ("phone", "020 7946 0018")]


@pytest.mark.parametrize("name", ["gate_content", "gate_masked"])
def test_gate_of_numbers_side_by_side_equals_its_sql(spark, tmp_path, name):
    rows = [(1, "head\na 4387393285946913 +1 (438) 555-5817 by"), (2, "head\n12345678+12345678, 020 7946 0018;+44 20 7946 0018\r"), (3, "head\n12345678:12345678\t(020 7946 0018")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path)).select("doc_id", "rule", "value").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT doc_id, rule, value FROM ({queries.ORACLE[name]})").fetchall()) and (1, "phone", "1 (438) 555-5817") in map(tuple, got)


def test_report_and_leaks(spark):
    docs = spark.createDataFrame([(1, "a@b.example.com 555-010-0142"), (2, "none")], "doc_id long, text string")
    found = redact.detections(docs)
    assert [tuple(r) for r in redact.report(docs).select("doc_id", "n_email", "n_phone", "n_link", "masked_chars", "chars").collect()] == [(1, 1, 1, 0, 27, 28)]
    assert redact.leaks(redact.redact(docs, found)).count() == 0


def test_lists_and_streams(spark, tmp_path):
    (tmp_path / "names.txt").write_text("  Ann \n\nBob\n")
    assert [r.value for r in lists.names(spark, f"file://{tmp_path}/names.txt").collect()] == ["Ann", "Bob"]
    assert lists.exceptions(spark, f"file://{tmp_path}/missing.txt").count() == lists.exceptions(spark, None).count() == 0
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.PdF").write_text("x")
    (tmp_path / "tree" / "b.txt").write_text("x")
    assert [r.path.split("/")[-1] for r in lists.manifest(spark, f"file://{tmp_path}/tree").collect()] == ["a.PdF"]
    docs = spark.createDataFrame([(1, "to a@b.example.com")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        mask_stream(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["to REDACTED"]
    finds = spark.createDataFrame([("name", "Ann", "c", "ner", 1, 0)], "kind string, value string, context string, source string, doc_id long, start long")
    for k in range(2):
        finds.write.mode("append").parquet(f"{tmp_path}/finds")
        stream = spark.readStream.schema(finds.schema).parquet(f"{tmp_path}/finds")
        candidate_stream(stream, f"{tmp_path}/cands", f"{tmp_path}/cstate").awaitTermination()
    assert [r["count"] for r in spark.read.parquet(f"{tmp_path}/cands/1").collect()] == [2]


def test_joined_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, None)], "doc_id long, page_no int, text string")
    assert [tuple(r) for r in lists.joined_pages(pages).collect()] == [(1, "a b")]


def test_rows_of_texts_give_the_names_of_words(spark):
    text = "Role Name: Mark Whitfield Adviser: x\nplain words only\n\nFull Name Staff\nAlice Kennedy Chair\n" + "x  y\n" * 30 + "Diane Reyes Name: Else\n" + "filler\n" * 40 + "Ward Name\n  Priya Shah"
    docs = spark.createDataFrame([(1, text), (2, "no names here"), (3, None), (4, "é Name: Élan Ana")], "doc_id long, text string")
    words = layout.lay_out(docs)
    like, under = (lambda x: x.rlike("Name:")), (lambda x: F.contains(F.lower(x), F.lit("name")))
    rows = layout.rows_of_texts(docs, like, under)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    at = lambda d: sorted(map(tuple, d.collect()))
    for of in (layout.label_names, layout.table_names, layout.placed_names):
        assert at(of(rows)) == at(of(words)) == at(of(layout.rows_of_texts(docs)))
    assert {("Mark", "label"), ("Else", "label"), ("Priya Shah", "table")} <= {(r.name, r.source) for r in layout.placed_names(rows).collect()}
    assert {r.name for r in layout.table_names(rows).collect()} >= {"Alice Kennedy"}


def test_characters_behind_entities(spark):
    token = [("Ada", "PROPN")]
    text = "é: Ada: Ada : Ada x" + " Ada" * 3
    starts = [k for k in range(len(text)) if text.startswith("Ada", k)]
    ents = spark.createDataFrame([(1, "PERSON", k, k + 3, "Ada", f"s{n}", token) for n, k in enumerate(starts)], f"doc_id long, {entities.ENTITY}")
    docs, none = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "value string")
    found = entities.whole_names(ents, docs, none, none, [])
    assert sorted(r.sent for r in found.collect()) == ["s2", "s3", "s4", "s5"]
    own = ents.withColumn("after", F.lit("xy"))
    assert entities.whole_names(own, docs.limit(0), none, none, []).count() == 6  # no look at the documents


def test_lay_out_of_pages_that_hold_a_mark(spark):
    text = "ada@ example.org\n" + "plain words\n" * 60 + "bob @example.org"
    docs = spark.createDataFrame([(1, text), (2, "none here\n" * 120), (3, None)], "doc_id long, text string")
    words, held = layout.lay_out(docs), layout.lay_out(docs, holding="@")
    at = lambda d: sorted(map(tuple, d.collect()))
    assert held.count() == 50 * 2 + 2 * 12 and set(at(held)) <= set(at(words))
    assert at(layout.split_emails(held)) == at(layout.split_emails(words)) != []


def test_graphics_with_heights_do_not_meet_the_pages(spark):
    pages = spark.createDataFrame([(1, p, 600.0) for p in (1, 2, 3)] + [(2, 1, 600.0)], "doc_id long, page_no int, height double")
    boxes = [(1, p, 10.0, 5.0, 60.0, 20.0) for p in (1, 2, 3)] + [(1, 1, 10.0, 300.0, 60.0, 320.0), (2, 1, 7.0, 560.0, 70.0, 580.0)]
    g = spark.createDataFrame(boxes, "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    high = g.withColumn("height", F.lit(600.0))
    at = lambda d: sorted(map(tuple, d.collect()))
    template = boilerplate.rect_template(high, pages)
    assert at(template) == at(boilerplate.rect_template(g, pages)) == [(1, 10.0, 5.0, 60.0, 20.0), (2, 7.0, 560.0, 70.0, 580.0)]
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(template) == 1 and joins(boilerplate.zone_images(high, pages)) == 0
    assert at(boilerplate.zone_images(high, pages).drop("height")) == at(boilerplate.zone_images(g, pages))
