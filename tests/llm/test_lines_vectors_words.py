"""Line dedup, whitening and spelling variants against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veil.llm import lines, variants, whitening

from . import brute
from .cases import awkward, empty, frame, rows

AWKWARD = rows() + [(None, "no id at all " * 20), (3, "one"), (4, "another text under a used id"), rows()[12]]


def as_rows(df, columns=None):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


# --- lines ----------------------------------------------------------------------


def many_lines(seed=3):
    rnd = random.Random(seed)
    pool = [f"  A line of Many words {k} " + rnd.choice(["é", "", "漢字", "\t"]) for k in range(25)] + ["nineteen characters", "exactly 20 charactersX"[:20], "short", "", " " * 40, "İ" * 20, "é" * 19]
    data = [(i, "\n".join(rnd.choice([x, x.upper(), x + "\r", x.strip()]) for x in rnd.choices(pool, k=rnd.randint(0, 9)))) for i in range(60)]
    return data + [(100, None), (101, ""), (102, "\n"), (None, pool[0]), (None, pool[3]), (7, pool[1]), (7, pool[1]), (103, (pool[2] + "\n") * 2000)]


@pytest.mark.parametrize("few", [True, False])
def test_lines(spark, monkeypatch, few):
    data = many_lines() + rows()
    if not few:
        monkeypatch.setattr(lines, "FEW_KEYS", 3)
        monkeypatch.setattr(lines, "MANY_DOCS", 12)
    assert as_rows(lines.deduped_lines(frame(spark, data))) == brute.lines(data)


def test_lines_of_filters_that_are_too_small(spark):
    """A full filter suspects every line; results stay."""
    data = many_lines(9)
    assert as_rows(lines.deduped_lines(frame(spark, data), most_bits=64)) == brute.lines(data)
    assert as_rows(lines.deduped_lines(frame(spark, data), least=5, least_docs=2)) == brute.lines(data, 5, 2)


def test_lines_of_odd_tables(spark, monkeypatch):
    assert as_rows(lines.deduped_lines(awkward(spark))) == brute.lines(AWKWARD)
    assert lines.deduped_lines(empty(spark)).collect() == []
    monkeypatch.setattr(lines, "HELD", 3)
    kept = lines.deduped_lines(awkward(spark), with_text=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in kept)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in kept if r.doc_id is not None) == sorted(r for r in brute.lines(AWKWARD) if r[0] is not None)


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    f = lines.Filter(np.zeros(1 << 10, np.uint64))
    f.add(h)
    assert f.holds(h).all() and lines.Filter(np.zeros(1 << 10, np.uint64)).holds(h).sum() == 0
    wide = lines.Filter(np.zeros(1 << 12, np.uint64))
    wide.add(h)
    assert wide.holds(rng.integers(-(2**63), 2**63 - 1, (5000, 2))).mean() < 0.01


def test_a_third_of_all_rows_hold_one_line(spark):
    data = [(i, ("One line that a third of all rows hold\n" if i % 3 == 0 else "") + f"and a line of number {i} alone") for i in range(900)]
    assert as_rows(lines.deduped_lines(frame(spark, data).repartition(7))) == brute.lines(data)


# --- vectors --------------------------------------------------------------------


def plain_whitening(data, components=16):
    """Eigenvectors by numpy; sums and deviations by Python's whole numbers."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in data if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in good]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    good = [(i, x) for i, x in good if len(x) == d]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [s / n for s in sums]
    off = np.array([[a - m for a, m in zip(x, mean)] for x in fit])
    v = off.T @ off / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, d, int((e > 1e-9 * e[0]).sum()))
    out = []
    for i, x in good:
        w = np.array([a - m for a, m in zip(x, mean)]) @ u[:, :k] / np.sqrt(e[:k])
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), w, e[:k] / e.sum()))
    return out


def vectors(spark, data):
    return spark.createDataFrame([(i, v, "x", [1]) for i, v in data], "vec_id long, embedding array<float>, n string, x array<int>").repartition(3)


def vector_data(d=20, n=150, seed=5):
    rng = np.random.default_rng(seed)
    scale = np.logspace(1, 0, d)
    data = [(i, [float(np.float32(c)) for c in rng.normal(3, 1, d) * scale]) for i in range(n)]
    return data + [(1000 + i, data[7][1]) for i in range(80)]


ODD = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 18), (2003, [float("nan")] * 20), (2004, [float("inf")] * 20), (2005, [1.0] * 3)]


@pytest.mark.parametrize("d", [20, 5, 1])
def test_whitening(spark, d):
    data = vector_data(d) + [(None, vector_data(d)[3][1]), (4, vector_data(d)[9][1])] + ODD
    got = {}
    for r in whitening.whitened(vectors(spark, data)).collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    want = plain_whitening(data)
    assert sorted(map(str, {(i, dev) for i, _, dev, _, _ in want})) == sorted(map(str, got))
    signs = None
    for i, n, dev, w, explained in want:
        rs = sorted(got[i, dev], key=lambda r: r.component)
        k = len(w)
        rs = rs[:: len(rs) // k] if len(rs) > k else rs  # equal rows
        assert [r.component for r in rs] == list(range(1, k + 1)) and {r.n for r in rs} == {n} and rs[0].identity_error < 1e-9
        mine = np.array([r.whitened for r in rs])
        signs = np.sign(mine * w) if signs is None else signs
        assert np.allclose(mine * signs, w, rtol=1e-6, atol=1e-6) and np.allclose([r.explained for r in rs], explained, rtol=1e-9)


def test_whitening_of_few_vectors_and_of_none(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), *ODD])).collect() == []
    data = [(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0]), (3, [1.0, 7.0, 5.0])]
    got = whitening.whitened(vectors(spark, data)).collect()
    assert len(got) == 6 and max(r.component for r in got) == 2 and all(abs(r.identity_error) < 1e-9 for r in got)
    huge = whitening.whitened(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 9.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in huge)


@given(st.integers(1, 12), st.integers(1, 30), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_factor_and_rotations(d, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.logspace(0, -rng.integers(0, 5), d)
    a = x.T @ x
    g = whitening.pivoted_cholesky(a)
    values, axes = whitening.jacobi(g)
    assert np.allclose(g @ g.T, a, atol=1e-12 * a.max())
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], rtol=1e-8, atol=1e-12 * values.max(initial=0))
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-10)


# --- words ----------------------------------------------------------------------


def near_by_index(words):
    """All pairs, found from both sides of an index."""
    found = set()
    for mirrored in (False, True):
        names = sorted(w[::-1] if mirrored else w for w in words)
        index = variants.Index([variants._codes(w) for w in names])
        halves = np.array([len(w) - len(w) // 2 if mirrored else len(w) // 2 for w in names])
        q, v = variants.near_words(index, [variants._codes(w) for w in names], halves)
        pairs = [(names[a], names[b]) for a, b in zip(q, v)]
        assert len(pairs) == len(set(pairs))
        found |= {(a[::-1], b[::-1]) if mirrored else (a, b) for a, b in pairs}
    return found


@given(st.sets(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_index_finds_what_is_one_apart(words):
    assert near_by_index(words) == {(a, b) for a in words for b in words if brute.one_apart(a, b)}


@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_one_apart(a, b):
    assert variants.one_apart(a, b) == brute.one_apart(a, b)


def word_counts(seed=1):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(7, 12))) for _ in range(60)]
    n = {}
    for w in base:
        n[w] = rnd.choice([2, 5, 300, 40_000])
        for _ in range(6):
            k = rnd.randrange(len(w))
            v = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcz") + w[k:], w[:k] + rnd.choice("abcÿ") + w[k + 1 :]])
            if len(v) >= 7:
                n.setdefault(v, rnd.choice([2, 3, 20, 30, 300]))
    return n


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("block", [variants.BLOCK, 50, 7])
def test_forms(spark, block):
    """Also with halves that many words share, whose words are dealt to blocks in pairs of parts."""
    n = word_counts() | {"shared" + "abcdefgh"[k % 8] + "abcdefgh"[k // 8] + "x" * (k % 3): 2 + k for k in range(64)}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert as_rows(variants.rooted(variants.forms(words, block=block)), COLUMNS) == brute.groups(n)


def test_forms_of_long_words(spark):
    rnd = random.Random(2)
    n = word_counts(4)
    for size in (variants.LONGEST - 1, variants.LONGEST, variants.LONGEST + 1, 700):
        w = "".join(rnd.choice("abc") for _ in range(size))
        n |= {w: 1000, w[:9] + w[10:]: 50, w[:-1]: 30, w + "b": 20, w[:100] + "z" + w[101:]: 3, w[:100] + "aab" + w[103:]: 4, w[:100] + "abb" + w[103:]: 5, "a" * size: 9, "a" * (size // 2) + "b" + "a" * (size - size // 2 - 1): 7}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert as_rows(variants.rooted(variants.forms(words)), COLUMNS) == brute.groups(n)


def test_variants_of_documents(spark, monkeypatch):
    rnd = random.Random(8)
    names = [w for w in word_counts(6) if len(w) < 12]
    data = rows() + [(200 + i, " ".join(rnd.choice([w, w.upper(), w.title() + "1"]) for w in rnd.choices(names[:40], k=60)) + " ×÷éÉàAaa ÿstraßes") for i in range(120)]
    data += [(None, "Nullable nullable NULLABLE nullaable"), (3, "nullable nullabe")] + data[40:60]
    monkeypatch.setattr(variants, "HELD", 50)
    assert as_rows(variants.grouped(frame(spark, data)), COLUMNS) == brute.variants(data, zlib.crc32)
    assert as_rows(variants.grouped(awkward(spark)), COLUMNS) == brute.variants(AWKWARD, zlib.crc32)
    assert variants.grouped(empty(spark)).collect() == []
    assert any(r[1] is not None for r in brute.variants(data, zlib.crc32))


def test_a_very_long_word(spark):
    data = [(i, "x" * 200_000 + " " + "ab" * 30_000) for i in range(3)] + [(4, "x" * 199_999), (5, "x" * 199_999)]
    got = {(len(r.word), r.word[0]): (r.n, r.n_near) for r in variants.grouped(frame(spark, data)).collect()}
    want = {}
    for w, n in ((w, n) for w, n in brute.Counter(variants.shortened(w, i) for i, t in data for w in t.split()).items() if n >= 2):
        want[len(w), w[0]] = n
    assert {k: v[0] for k, v in got.items()} == want
