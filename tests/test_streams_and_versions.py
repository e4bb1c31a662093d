"""Streams with lists and keyed state, versions, ledgers, recognisers, orders, the gate, sample pages."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veil.functions.text import natural_key
from veil.operators import boilerplate, candidates, entities, gate
from veil.plans import ledger, queries, redact
from veil.sources import lists
from veil.streaming.stream import candidate_stream, candidates_now, compact, redact_stream

DOCS = "doc_id long, text string"
FINDS = "kind string, value string, context string, source string, doc_id long, start long"


def values(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "value string")


def test_versions_count_when_they_are_whole(spark, tmp_path):
    path = f"file://{tmp_path}/list"
    with pytest.raises(FileNotFoundError):
        lists.current(spark, path)
    assert lists.current(spark, path, "value string").count() == 0
    assert lists.commit(values(spark, "a"), path) == 1 and lists.commit(values(spark, "b"), path) == 2
    reader = lists.current(spark, path)
    (tmp_path / "list" / "3").mkdir()  # a writer that was killed
    (tmp_path / "list" / "3" / "part-0.parquet").write_bytes(b"half")
    assert [r.value for r in lists.current(spark, path).collect()] == ["b"]
    assert lists.commit(values(spark, "c"), path) == 4
    assert [r.value for r in lists.current(spark, path).collect()] == ["c"] and [r.value for r in reader.collect()] == ["b"]

    failing = values(spark, "d").select(F.raise_error(F.lit("broken")).cast("string").alias("value"))
    with pytest.raises(Exception, match="broken"):
        lists.commit(failing, path)
    assert [r.value for r in lists.current(spark, path).collect()] == ["c"]
    found = spark.createDataFrame([("name", "Ada"), ("email", "a@b.c"), ("name", "Ada")], "kind string, value string")
    lists.commit_lists(found, f"{path}s")
    assert sorted(map(tuple, lists.current(spark, f"{path}s").select("kind", "value").collect())) == [("email", "a@b.c"), ("name", "Ada")]


def test_mirrored_tree(spark, tmp_path):
    docs = spark.createDataFrame([(1, "clean", "in/a/b.pdf"), (2, "clean too", "else/c.PDF")], DOCS + ", path string")
    lists.write_redacted(docs, f"file://{tmp_path}/out", root="in")
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.path.removeprefix(f"file://{tmp_path}/"), r.text) for r in got) == [("out/a/b_REDACTED.pdf", "clean"), ("out/c_REDACTED.PDF", "clean too")]


def test_stream_with_a_versioned_list(spark, tmp_path):
    source, sink, state, names = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state", "names"))

    def run(*docs):
        spark.createDataFrame(docs, DOCS).write.mode("append").parquet(source)
        redact_stream(spark.readStream.schema(DOCS).parquet(source), sink, state, names=names, on=("email",)).awaitTermination()
        return {r.doc_id: r.text for r in spark.read.parquet(sink).collect()}

    assert run((1, "Anna Berg a@b.example.com")) == {1: "Anna Berg REDACTED"}  # no list yet
    lists.commit(values(spark, "Anna Berg"), names)
    assert run((2, "AnnaBerg here")) == {1: "Anna Berg REDACTED", 2: "REDACTED here"}
    lists.commit(values(spark, "Bob"), names)
    assert run((3, "Anna Berg and Bob"))[3] == "Anna Berg and REDACTED"


def test_candidates_with_keyed_state(spark, tmp_path):
    source, path, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))

    def run(*finds):
        spark.createDataFrame(finds, FINDS).repartition(1).write.mode("append").parquet(source)
        candidate_stream(spark.readStream.schema(FINDS).parquet(source), path, state).awaitTermination()
        return {r.value: (r["count"], r.context, r.source) for r in candidates_now(spark, path).collect()}

    run(("name", "Ann", "late", "ner", 5, 0), ("name", "Bob", "b", "ner", 1, 0))
    assert run(("name", "Ann", "early", "table", 2, 0)) == {"Ann": (2, "early", "table"), "Bob": (1, "b", "ner")}
    assert [r.value for r in spark.read.parquet(f"{path}/1").collect()] == ["Ann"]  # what the batch has changed, no more
    now = run(("name", "Cy", "c", "ner", 9, 0))
    compact(spark, path)
    assert {r.value: (r["count"], r.context, r.source) for r in candidates_now(spark, path).collect()} == now
    last = spark.read.parquet(f"{path}/2")
    again = last.collect()
    spark.createDataFrame(again, last.schema).write.mode("overwrite").parquet(f"{path}/2")  # a batch that is run again
    assert {r.value: (r["count"], r.context, r.source) for r in candidates_now(spark, path).collect()} == now
    assert run(("name", "Cy", "c", "ner", 8, 0))["Cy"] == (2, "c", "ner")


def test_ledgers_join_without_an_exchange(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail a{i}@b.example.com and c@d.example.com or 020 7946 00{i:02d}") for i in range(20)], DOCS)
    found = ledger.store(redact.detections(docs, names=["mail"]), "ledger_found", f"file://{tmp_path}/a", buckets=4)
    safe = ledger.store(redact.detections(docs, on=(), names=["c@d.example.com"]), "ledger_safe", f"file://{tmp_path}/b", buckets=4)
    report = ledger.report(found, safe)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert {(r.doc_id, r.rule, r.n) for r in report.collect()} == {(i, rule, 1) for i in range(20) for rule in ("email", "phone", "name")}
        after = ledger.store(redact.detections(redact.redact_all(docs, on=("email",))), "ledger_after", f"file://{tmp_path}/c", buckets=4)
        change = ledger.changes(found, after)
        assert {(r.rule, r.gone, r.left, r.new) for r in change.collect()} == {("email", 2, 0, 0), ("phone", 0, 1, 0), ("name", 1, 0, 0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("ledger_found", "ledger_safe", "ledger_after"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def capitals(frames):
    for f in frames:
        rows = [(i, "PERSON", m.start(), m.end(), m.group(), t, [{"text": w, "pos": "PROPN"} for w in m.group().split()]) for i, t in zip(f.doc_id, f.text) for m in re.finditer("[A-Z][a-z]+ [A-Z][a-z]+", t)]
        yield pd.DataFrame(rows, columns=["doc_id", "label", "start", "stop", "text", "sent", "tokens"]).assign(more=1)


def test_a_recogniser_of_the_callers_own(spark):
    docs = spark.createDataFrame([(1, "Adam Moran spoke."), (2, "with Eve Stone: yes"), (3, None)], DOCS)
    found = entities.recognised(docs, capitals)
    none = values(spark)
    whole = entities.whole_names(found, docs, none, none)
    assert [tuple(r)[:2] for r in whole.collect()] == [(1, "Adam Moran")]  # a label follows the other
    parts = entities.name_parts(found, values(spark, "stone"))
    clean = entities.cleaned_up(whole.unionByName(parts.select(whole.columns)))
    assert sorted((r.doc_id, r.name, r.context) for r in entities.contexts(clean).collect()) == [(1, "Adam", "Adam Moran spoke."), (1, "Adam Moran", "Adam Moran spoke."), (1, "Moran", "Adam Moran spoke."), (2, "Eve", "with Eve Stone: yes")]
    with pytest.raises(Exception, match="gives no sent"):
        entities.recognised(docs, lambda frames: (f.drop(columns="sent") for f in capitals(frames))).collect()
    with pytest.raises(Exception, match="ends before it starts"):
        entities.recognised(docs, lambda frames: (f.assign(stop=-1) for f in capitals(frames))).collect()


def test_digits_sort_by_value(spark):
    v = ["Item 10", "item 9", "Item 009b", "Item", "2", "10", "a2b10", "a2b9", ""]
    df = values(spark, *v)
    assert [r.value for r in df.orderBy(natural_key(F.col("value")), "value").collect()] == ["", "2", "10", "a2b9", "a2b10", "Item", "item 9", "Item 009b", "Item 10"]
    rows = spark.createDataFrame([("name", x, "High" if k % 3 else "Low") for k, x in enumerate(v * 1)] + [("email", "z@y", "Medium")], "kind string, value string, tier string")
    got = candidates.positions(rows).orderBy("position").collect()
    want = rows.orderBy(*candidates.review_order()).collect()
    assert [r.position for r in got] == list(range(1, len(v) + 2)) and [r.value for r in got] == [r.value for r in want]


def test_gate_is_as_strict_as_it_says(spark):
    lines = spark.createDataFrame([(1, "12345678 or 2021-17789 or 020 7946 0018"), (1, "+353 1 555 0142 and +353 1 555 0xxx"), (1, "a12345678 1234567@x 12.34.56.78.90 123 4567x"), (1, "12345, 1234567890123456")], "doc_id long, line string")
    got = sorted(r.value for r in gate.content(lines).collect() if r.rule == "phone")
    plain = re.compile(r"(?<![\w@.])(\+?[\d][\d\-. ()xX]{6,}[\dxX])(?![\w@.])")
    want = sorted({v for r in lines.collect() for m in plain.finditer(r.line) for v in [m.group(1).strip()] if 7 <= len(re.sub(r"\D", "", v)) <= 15 and not re.match(r"^\+353 1 555 0(\d{3}|[xX]{3})$", v)})
    assert got == want and {"12345678", "2021-17789", "020 7946 0018"} <= set(got)


def test_templates_of_sample_pages(spark):
    words = spark.createDataFrame([(1, p, 0, 0, "HEADER" if p <= 3 else f"x{p}", 0.0, 10.0, 36.0, 22.0) for p in range(1, 9)], "doc_id long, page_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert boilerplate.text_template(words).count() == 0
    assert [r.text for r in boilerplate.text_template(words, sample=(1, 3)).collect()] == ["HEADER"]
    assert boilerplate.text_template(words, sample=(8, 99)).count() == 0  # one page is no sample
    graphics = words.filter("text = 'HEADER'").select("doc_id", "page_no", "x0", "y0", "x1", "y1")
    pages = words.select("doc_id", "page_no").withColumn("height", F.lit(800.0))
    assert boilerplate.rect_template(graphics, pages).count() == 0 and boilerplate.rect_template(graphics, pages, sample=(0, 4)).count() == 1


def test_finds_are_dealt_out_as_the_input_is(spark, tmp_path, monkeypatch):
    """The files of a stream of finds grow in number, not in size, with the input, and are taken in two batches."""
    monkeypatch.setattr(queries, "shared_folder", lambda *_: f"{tmp_path}/out")
    docs = spark.createDataFrame([(i, f"Anna Berg a{i}@b.example.org") for i in range(60)], "doc_id long, text string")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = queries.QUERIES["candidate_batches"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in got) == 120 and len(spark.read.parquet(f"{tmp_path}/out/finds").inputFiles()) > 4
