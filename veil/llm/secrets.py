"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: an AND
of ORs of three-letter strings one of which every match must hold. One pass
over the texts writes the postings of the trigrams that occur in any query;
intersecting postings gives each document the rules that can match in it, and
only those rules are run over its text. Rules without mandatory trigrams are
run over every text. DataFrame functions only.

Cases: a null text counts as empty; documents that share a doc_id (null too)
share candidates, which can only add verification, and each keeps its own row
and spans; an empty table gives no rows; other columns are ignored; texts of a
million blanks, letters, marks or matches take time in proportion.
"""

from __future__ import annotations

import re._parser as regex_tree
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import characters, let, running
from .common import BROADCAST_ROWS, staged, whole


@dataclass(frozen=True)
class Rule:
    """kind: the name in spans; pattern: for Java, RE2 and Python alike; a match counts if its group has at_least characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


#: The three base rules, then further credential formats by their public prefixes. Only classes are
#: repeated, never groups (Java would recurse), and none from many starts over one unbounded run (a token's header has
#: 1000 characters at most), so a text of any length takes time in proportion.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


# --- Boolean trigram queries -------------------------------------------------

#: A query is a set of clauses, all of which must hold; a clause is a set of alternatives; an alternative is a set of trigrams, all present.
Query = frozenset

#: A set of exact strings larger than this is closed into a clause and a new one is begun.
MOST_STRINGS = 64
#: Trigrams kept of an alternative, spread over its string: fewer ask for less, so a query stays a necessary condition.
MOST_TRIGRAMS = 4


def _clause(strings: set[str]) -> Query:
    """What a text that has one of these strings must satisfy; nothing if one is shorter than a trigram."""
    if any(len(s) < 3 for s in strings):
        return Query()
    whole = {s: [s[i : i + 3] for i in range(len(s) - 2)] for s in strings}
    least = [s for s in strings if not any(t in s for t in strings if t != s)]  # a longer string asks for what a shorter one within it asks
    return Query([frozenset(frozenset(whole[s][:: -(-len(whole[s]) // MOST_TRIGRAMS)]) for s in least)])


def _chars(items) -> set[str] | None:
    """The lower-cased characters of a class, None if there are many."""
    found: set[str] = set()
    for op, value in items:
        if op is regex_tree.LITERAL:
            found.add(chr(value).lower())
        elif op is regex_tree.RANGE and value[1] - value[0] < 4:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _read(nodes) -> tuple[set[str] | None, Query]:
    """The exact strings that nodes match, None if not a small set, and the query of a match."""
    exact: set[str] = {""}
    whole, query = True, Query()

    def close() -> None:
        nonlocal exact, whole, query
        query, exact, whole = query | _clause(exact), {""}, False

    for op, value in nodes:
        inner: set[str] | None = None
        if op is regex_tree.LITERAL:
            inner = {chr(value).lower()}
        elif op is regex_tree.IN:
            inner = _chars(value)
        elif op is regex_tree.SUBPATTERN:
            inner, more = _read(value[-1])
            query |= more
        elif op is regex_tree.BRANCH:
            parts = [_read(x) for x in value[1]]
            if all(strings is not None for strings, _ in parts):
                inner = set().union(*(strings for strings, _ in parts))
            elif all(more for _, more in parts):  # any branch's first clause will do
                query |= Query([frozenset().union(*(next(iter(more)) for _, more in parts))])
        elif op in (regex_tree.MAX_REPEAT, regex_tree.MIN_REPEAT):
            low, high, body = value
            strings, more = _read(body)
            if low:
                query |= more
            if high == 1 and strings is not None:
                inner = strings | {""}
            elif low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
                inner = {"".join(x) for x in product(strings, repeat=low)}
        elif op is regex_tree.AT:
            inner = {""}
        if inner is None:
            close()
            continue
        if len(exact) * len(inner) > MOST_STRINGS:
            close()
        exact = {a + b for a in exact for b in inner}
    if not whole:
        return None, query | _clause(exact)
    return exact, query


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, in lower case; empty if it has no mandatory trigrams."""
    exact, query = _read(regex_tree.parse(pattern))
    return query | (_clause(exact) if exact is not None else Query())


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})


# --- index and candidates ----------------------------------------------------


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """gram (its place in trigrams(rules)), doc_id: a row for each trigram of a query that a text holds, ordered by gram within files."""
    grams = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("g")) for k, g in enumerate(trigrams(rules))])
    low = docs.select("doc_id", F.lower("text").alias("_low")).filter("_low IS NOT NULL")
    held = low.select("doc_id", F.explode(F.filter(grams, lambda x: F.contains(F.col("_low"), x["g"]))).alias("x"))
    return held.select(F.col("x.k").alias("gram"), "doc_id").sortWithinPartitions("gram")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules (bit k: rule k's query holds), for documents with any such rule."""
    place = {g: k for k, g in enumerate(trigrams(rules))}
    words = len(place) // 62 + 1
    sets = index.groupBy("doc_id").agg(
        *[F.bit_or(F.when((F.col("gram") >= 62 * i) & (F.col("gram") < 62 * (i + 1)), F.expr(f"shiftleft(1L, gram - {62 * i})")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{i}") for i in range(words)]
    )

    def has(option: frozenset) -> Column:
        masks = [sum(1 << (place[g] - 62 * i) for g in option if place[g] // 62 == i) for i in range(words)]
        return reduce(Column.__and__, [F.col(f"m{i}").bitwiseAND(F.lit(m)) == m for i, m in enumerate(masks) if m])

    bits = F.lit(0).cast("bigint")
    for k, r in enumerate(rules):
        if query := trigram_query(r.pattern):
            holds = reduce(Column.__and__, [reduce(Column.__or__, [has(o) for o in clause]) for clause in query])
            bits = bits.bitwiseOR(F.when(holds, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return sets.select("doc_id", bits.alias("rules")).filter("rules <> 0")


# --- verification ------------------------------------------------------------

_SPAN = "array<struct<start:bigint,kind:int,span:string>>"


def _spans(text: Column, k: int, rule: Rule) -> Column:
    """Spans of the matches that count. What lies between matches comes from split(), so a match starts after all text before it."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = hits if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    matches = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value")),
        lambda x: F.struct(F.char_length(x["gap"]).cast("bigint").alias("gap"), F.char_length(x["hit"]).cast("bigint").alias("hit"), F.char_length(x["value"]).alias("value")),
    )

    def placed(found: Column) -> Column:
        # The text after the last match has no hit.
        before = running(F.transform(found, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))), lambda a, x: a + x)
        spans = F.zip_with(found, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(k).alias("kind"), F.concat_ws(":", F.lit(rule.kind), at + x["gap"], at + x["gap"] + x["hit"]).alias("span"), (x["value"] >= rule.at_least).alias("ok")))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["kind"], x["span"])).cast(_SPAN)

    return F.when(F.size(hits) > 0, let(matches, placed)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carry..., found: per rule an array of its spans (in the order of rules), a row for each document."""
    index = staged(postings(docs, rules), "postings")
    some = staged(candidates(index, rules), "candidates")
    small = some.count() <= BROADCAST_ROWS
    kept = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), *carry)
    joined = kept.join(F.broadcast(some) if small else some, kept["doc_id"].eqNullSafe(some["doc_id"]), "left").select(kept["doc_id"], "_text", *carry, F.coalesce("rules", F.lit(0)).alias("_rules"))
    none = F.array().cast(_SPAN)
    spans = [
        F.when(F.col("_rules").bitwiseAND(F.lit(1 << k)) != 0, _spans(F.col("_text"), k, r)).otherwise(none) if trigram_query(r.pattern) else _spans(F.col("_text"), k, r)
        for k, r in enumerate(rules)
    ]
    return joined.select("doc_id", *carry, F.array(*spans).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: x["span"]), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns for each document."""
    order = [r.kind for r in rules]
    of = lambda kind: F.get(F.col("found"), order.index(kind))
    return scan(docs, rules).select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.concat(*[of(k) for k in BASE])), 256).alias("base_sha256"),
        _joined(F.flatten("found")).alias("spans"),
    )


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret's characters replaced by [secret], in all their columns but n_chars unchanged."""
    found = scan(docs.select("doc_id", "text", whole(docs).alias("_doc")), rules, carry=("_doc",))
    text = F.col("_doc.text")
    spans = F.transform(F.array_sort(F.flatten("found")), lambda x: F.struct(x["start"].alias("start"), F.get(F.split(x["span"], ":"), 2).cast("bigint").alias("stop")))

    # What stays: the text between the furthest end so far and each span's start, and what follows them all. Spans that begin inside earlier ones only push the end on.
    def cut(spans: Column, characters: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["stop"]), F.greatest)
        stretch = lambda a, b: F.array_join(F.slice(characters, a.cast("int") + 1, (b - a).cast("int")), "")
        parts = F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda x, at: F.when(x["start"] >= at, F.concat(stretch(at, x["start"]), F.lit("[secret]"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), stretch(F.element_at(ends, -1), F.size(characters)))

    clean = F.when(F.size(F.flatten("found")) == 0, text).otherwise(let(spans, lambda s: let(characters(text), lambda c: cut(s, c))))
    columns = [clean.alias("text") if c == "text" else F.char_length(clean).cast("bigint").alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in docs.columns]
    return found.select(*columns)
