import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from veil.llm import pieces

from . import brute
from .cases import frame, prose, rows
import random

BENCH = [(7, "a passage of the benchmark that nobody should train on because it is kept for tests")]


def kept_copies(data):
    """Rows that stay, by links between rows."""
    by_row = brute.components([(k, t) for k, (_, t) in enumerate(sorted(data, key=lambda x: (x[0] is None, x[0] or 0)))], 5, 80, 100)
    ordered = sorted(data, key=lambda x: (x[0] is None, x[0] or 0))
    return [ordered[k] for k, _, c in by_row if k == c]


def test_near_copies_by_row(spark, tmp_path):
    rnd = random.Random(9)
    a, b, c = (prose(rnd, 80) for _ in range(3))
    data = [(1, a), (1, a), (5, a + " z"), (5, b), (None, b), (None, c), (None, c), (6, None), (6, ""), (7, "one"), (7, "one"), (8, a.upper())]
    frame(spark, data).withColumn("x.y", F.lit(1)).withColumn("_doc", F.lit(2)).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(kept_copies(data), key=str)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (6, None), (6, ""), (7, "one")], key=str)


def test_every_stage_takes_odd_tables(spark, tmp_path):
    """Repeated and null doc_ids, columns with odd names, and no rows at all."""
    rnd = random.Random(10)
    long = [prose(rnd, 90) + f" n{i}" for i in range(4)]
    data = [(1, long[0]), (1, long[1]), (None, long[2]), (None, long[3] + ' token = "0123456789abcdef0123456789abcdef"'), (2, None), (3, "")]
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = frame(spark, data).withColumn("x.y", F.lit(1)).withColumn("a`b", F.lit("s")).withColumn("_text", F.lit(2.5))
    odd.write.parquet(f"{tmp_path}/0")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns, name
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 1], name
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0 and nothing.columns == out.columns, name
        out.write.parquet(f"{tmp_path}/{k + 1}")


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    extra = [(600 + i, prose(rnd, 90) + f" number {i}") for i in range(20)]
    extra += [(700, extra[0][1] + " " + BENCH[0][1]), (701, extra[1][1] + ' token = "0123456789abcdef0123456789abcdef"'), (702, extra[2][1] + " end"), (703, "x " * 80)]
    data = rows() + extra
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), data
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            assert {r.doc_id for r in out.collect()} <= {r[0] for r in brute.quality(left) if not r[-1]}
            left = [(r.doc_id, r.text) for r in out.collect()]
            assert 600 in dict(left) and 703 not in dict(left)
        elif k == 1:
            left = kept_copies(left)
        elif k == 2:
            left = [(r[0], dict(left)[r[0]]) for r in brute.contamination(left, BENCH) if not r[-1]]
        elif k == 3:
            texts = {r.doc_id: r.text for r in out.collect()}
            assert texts.keys() == dict(left).keys()
            assert all(texts[i] == t for i, t in left if i != 701) and (701 not in texts or "0123456789abcdef" not in texts[701])
            left = list(texts.items())
        if k < 4:
            assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(left), name
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
    model = pieces.Model(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 1)
    import numpy as np

    assert {r.doc_id: model.decode(np.frombuffer(r.ids, "<u4")) for r in out.collect()} == dict(left)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == dict(left).keys()
