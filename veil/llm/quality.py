"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps one bit for
each rule that failed, and the measurements; policies (named, versioned sets of
rules) and ablations are bitwise expressions over the ledger and never touch a
text again. DataFrame functions only.

Cases: a null text counts as empty and fails few_words; documents with equal
doc_ids or texts each get their own row; an empty table gives an empty ledger;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Bit k of fail_bits is set when the k-th rule fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "long_words": "n_words > 0 AND word_chars > 25 * n_words",
    "short_words": "n_words > 0 AND 2 * word_chars < 3 * n_words",
}
BASE = ("few_words", "repeated_words")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A version of what is kept: documents that fail none of these rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = (
    Policy("base", 1, BASE),
    Policy("default", 1, (*BASE, "many_symbols")),
    Policy("default", 2, tuple(RULES)),
)
DEFAULT = POLICIES[-1]


def _repeat_words(words: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that the document has twice or more.

    Windows are compared by 64-bit hashes within their document. Only documents
    in which two hashes agree sort them; neighbours in that order are equal.
    """
    w = F.col("_words")
    hashes = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    h = F.col("_hashes")
    pairs = F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    )
    s = F.col("_sorted")
    same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return (
        words.withColumn("_hashes", hashes)
        .withColumn("_sorted", pairs)
        .withColumn("n_repeat_words", F.when(F.size(s) == 0, F.lit(0).cast("bigint")).otherwise(covered))
        .drop("_hashes", "_sorted")
    )


def ledger(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry..., the measurements (long) and fail_bits (long), a row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select(
        *carry,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("_words"),
        F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    measured = _repeat_words(words).select(
        *carry,
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def kept(policy: Policy = DEFAULT) -> Column:
    """True for rows of a ledger that the policy keeps."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def verdicts(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """A ledger with one boolean column kept_<name>_v<version> for each policy."""
    return rows.withColumns({f"kept_{p.name}_v{p.version}": kept(p) for p in policies})


def ablation(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """What each rule of a policy rejects: rule, n_failed, n_only (rejected by it alone, so kept without it).

    Counts come from the ledger's distinct bit patterns, of which there are at
    most 2 ** len(RULES), so one pass serves every rule.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("bigint").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document, and fail_bits of the ledger."""
    base = Policy("base", 1, BASE)
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept(base)).alias("base_failed"), kept(DEFAULT).alias("kept"), "fail_bits"
    )


def accepted(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    # The rows come out of a generator: a filter would be pushed below the measurements, and copy them into itself many times over.
    full = docs.select("text", whole(docs).alias("_doc"))
    own = ledger(full, carry=("_doc",)).select(F.explode_outer(F.when(kept(policy), F.array("_doc"))).alias("_doc"))
    return own.filter("_doc IS NOT NULL").select("_doc.*")
