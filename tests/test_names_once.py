"""Names of entities that tell what comes behind them, in one pass."""

import random
import re

from pyspark.sql import functions as F

from veil.functions.validate import name_shape, numeric_noise
from veil.operators import entities
from veil.plans import queries

SF = "/root/testdata/sf0.001"


def test_names_are_whole_names_and_parts(spark):
    rng = random.Random(3)
    words = ["Ada", "Prof", "Track", "The", "J", "J.", "von", "O'Neil", "Élan", "A1", "Lee,", "Kim:"]
    rows = []
    for k in range(400):
        own = [rng.choice(words) for _ in range(rng.randint(1, 3))]
        tokens = [(w, rng.choice(["PROPN", "PROPN", "NOUN"])) for w in own] + ([("Neil", "PROPN")] if rng.random() < 0.2 else [])
        rows.append((k % 9, rng.choice(["PERSON"] * 4 + ["ORG"]), " ".join(own), f"s{k}", tokens, rng.choice([" x", " :", ":x", "", None])))
    ents = spark.createDataFrame(rows, "doc_id long, label string, text string, sent string, tokens array<struct<text:string,pos:string>>, after string")
    listed = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    docs, stop, common = listed().selectExpr("1L AS doc_id", "value AS text"), listed("prof", "ada ada"), listed("track", "kim")
    got = entities.names(ents, docs, stop, common, ["the"])
    want = entities.cleaned_up(entities.whole_names(ents, docs, stop, common, ["the"]).unionByName(entities.name_parts(ents, stop, ["the"])))
    at = lambda d: sorted(map(tuple, d.distinct().collect()))
    assert at(got) == at(want) != []
    assert any(" " in r.name for r in got.collect()) and got.count() < want.count()  # what is a whole name and its own part is one row


def test_texts_are_read_for_sentences_once(spark):
    plan = queries.QUERIES["name_sources"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"documents|Relation \[doc_id", plan)) == 2  # once for sentences, once for pages


def plain_shape(v, known):
    v = v.strip(" ")
    words = re.split(r"[ \t\n\x0b\f\r]+", v)
    bare = [re.sub(r"""^[.,;:()'"]+|[.,;:()'"]+\Z""", "", w) for w in words]
    good = all(b and not re.search("[0-9]", b) and b.lower() not in known and (re.fullmatch("[A-Z]{1,4}", b) or re.fullmatch("[A-Z][A-Za-z'-]*", b)) for b in bare)
    ends = not re.search(r"[,;():]\Z", v) and (not v.endswith(".") or len(words[-1]) <= 4)
    return bool(v and good and ends and len(words) <= 4 and len(v) <= 40 and (len(words) > 1 or len(v) <= 22))


def test_shapes_of_plain_names(spark):
    rng = random.Random(4)
    parts = ["Ada", "ada", "The", "tHE", "A", "ABCDE", "O'Neil", "Ann's'", "St.", "Al-Hadi", "Élan", "A1", "Lee,", "x" * 9, "B" + "b" * 20, "C" + "c" * 21, "D" + "d" * 22]
    values = sorted({rng.choice(["", "", " "]) + rng.choice([" ", " ", " ", "  ", "\t"]).join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "", ":", " "]) for _ in range(1500)} | {"", " "})
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", name_shape(F.col("v"), ["the"]).alias("shape"), numeric_noise(F.col("v")).alias("noise")).collect()
    assert [r.shape for r in rows] == [plain_shape(r.v, {"the"}) for r in rows] and any(r.shape for r in rows)
    assert [r.noise for r in rows] == [not re.search("[^\\W\\d_]", r.v) or bool(re.search("[0-9]", r.v)) or bool(re.search(":\\s*\\Z", r.v)) for r in rows]
