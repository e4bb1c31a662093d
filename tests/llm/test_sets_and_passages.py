from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veil.llm import decontaminate, jaccard, substring
from veil.llm.components import components

from . import brute
from .cases import awkward, empty, frame, rows

AWKWARD = rows() + [(None, "no id at all " * 20), (3, "one"), (4, "another text under a used id"), rows()[12]]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=25, unique_by=lambda s: tuple(sorted(s))), st.sampled_from([(9, 10), (8, 10), (1, 2)]))
@settings(max_examples=150, deadline=None)
def test_trie_connects_what_is_similar(sets, t):
    t = Fraction(*t)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert jaccard.connect([np.array(sorted(s), np.uint64) for s in sets], t) == [find(i) for i in range(len(sets))]


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=50, deadline=None)
def test_signatures_never_exceed_the_difference(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard.bits_apart(jaccard.signature(x), jaccard.signature(y)) <= len(a ^ b)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_components_of_documents(spark, k, num, den):
    assert as_rows(jaccard.jaccard_components(frame(spark), k, (num, den))) == brute.components(rows(), k, num, den)


def test_components_with_every_limit_reached(spark, monkeypatch):
    """Runs and chains in place of pairs, and groups over several blocks."""
    near = [(100 + i, " ".join(f"w{j}" if (i * 7 + j) % 97 else f"x{i}" for j in range(120))) for i in range(40)]
    data = rows() + near
    got = as_rows(jaccard.jaccard_components(frame(spark, data), 3, (90, 100), most_ids=500))
    assert got == brute.components(data, 3, 90, 100)
    for name, value in (("COMMON", 2), ("MOST_MEETING", 3), ("FEW", 2), ("HELD", 200)):
        monkeypatch.setattr(jaccard, name, value)
    assert as_rows(jaccard.jaccard_components(frame(spark, data), 3, (90, 100), most_ids=500)) == got


def test_components_of_awkward_and_empty_tables(spark):
    got = as_rows(jaccard.jaccard_components(awkward(spark), 3, (90, 100)))
    assert got == brute.components(AWKWARD, 3, 90, 100)
    assert jaccard.jaccard_components(empty(spark), 3, (90, 100)).count() == 0


def test_stars_find_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (60, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()))
    assert got == {i: 0 for i in range(1, 31)} | {50: 40}


ITEMS = [(1, "the passage that is to be found here has more than ten words of its own"), (2, "short item"), (3, "one"), (None, "no id item words"), (5, None), (6, ""), (2, "short item")]


def test_contamination(spark):
    data = AWKWARD + [(200, "x " + ITEMS[0][1].upper() + " y"), (201, ITEMS[0][1][8:70]), (202, "a short, item! short\nitem")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, data)
    expected = brute.contamination(data, ITEMS)
    assert as_rows(decontaminate.contamination(docs, items)) == expected
    assert as_rows(decontaminate.contamination(docs, items, block=3)) == expected  # several blocks
    # Item names of any kind are the same whatever the number of blocks.
    named = spark.createDataFrame([("", ITEMS[0][1]), ("two\nlines", ITEMS[0][1]), ("two", ITEMS[1][1]), (None, ITEMS[3][1])], "item_id string, text string")
    one = as_rows(decontaminate.contamination(docs, named))
    assert max(r[3] for r in one) == 2 and one == brute.contamination(data, [tuple(r) for r in named.collect()])
    assert all(as_rows(decontaminate.contamination(docs, named, block=n)) == one for n in (1, 3))
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(r[0]) for r in expected if not r[5])
    assert decontaminate.contamination(empty(spark), items).count() == 0
    assert {r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {False}


@pytest.mark.parametrize("width", [5, 12, 35])
def test_repeats(spark, width, monkeypatch):
    expected = brute.repeats(AWKWARD, width)
    assert as_rows(substring.removed_repeats(awkward(spark), width)) == expected
    monkeypatch.setattr(substring, "HELD", 50)
    assert as_rows(substring.removed_repeats(awkward(spark), width)) == expected
    assert as_rows(substring.removed_repeats(frame(spark), width)) == brute.repeats(rows(), width)


def test_repeats_of_an_empty_table_and_kept_texts(spark):
    assert substring.removed_repeats(empty(spark), 5).count() == 0
    got = {r.doc_id: r.kept_text for r in substring.removed_repeats(frame(spark, [(1, "a b c d e f"), (2, "x b c d e y")]), 4, with_text=True).collect()}
    assert got == {1: "a f", 2: "x y"}


@pytest.mark.parametrize("period", substring.COVERS)
def test_covers_hold_every_difference(period):
    assert {(a - b) % period for a in substring.COVERS[period] for b in substring.COVERS[period]} == set(range(period))
