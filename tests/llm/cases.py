"""Small tables with the cases that every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

WORDS = "the of and to in is was that for with on as by at from this".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "a", "er", "ing", str(rnd.randint(0, 99))]) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """(doc_id, text) with copies, near copies, passages, blanks of all kinds and a long text."""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.choice([3, 12, 60, 150])) for _ in range(12)]
    passage = prose(rnd, 45)
    out = [None, "", " \t\n", "one", "two words", "é É ß 漢字 ▁ 😀 ́", "a" * 5000, prose(rnd, 4000)]
    out += base + base[:4] + [base[5]] * 6
    for t in base:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(t.upper() + "\n" + passage + " tail")
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, data=None):
    """documents with the given table's columns, and ones whose names operators use inside."""
    data = rows() if data is None else data
    full = [(i, t, "en", "s", len(t) if t is not None else None, 1, "k", [1]) for i, t in data]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, runs array<int>"
    return spark.createDataFrame(full, schema).repartition(3)


def awkward(spark):
    """The same with a null doc_id and repeated rows."""
    data = rows()
    return frame(spark, data + [(None, "no id at all " * 20), (3, "one"), (4, "another text under a used id"), data[12]])


def empty(spark):
    return frame(spark, []).limit(0)
