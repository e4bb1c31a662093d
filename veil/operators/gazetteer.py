"""Matching large name lists by equi-joins: a list of any length costs a hash join, not a pattern for each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import folded
from ..functions.text import cleaned, normalised
from . import substrings


#: Runs of ASCII letters or digits, and single other marks.
RUNS = r"[0-9a-z]+|[^\s0-9a-z]"


#: Names of a list up to which it is broadcast, after it is counted: some tens of MB. Longer lists are joined by a shuffle.
BROADCAST_NAMES = 200_000


#: Runs that are put side by side for every place of a text; longer names are looked for where they can begin.
SIDE_BY_SIDE = 8


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names


def lengths(names: DataFrame, each: Column) -> list[int]:
    """The numbers that `each` (an array) gives over a list: a small set, however long the list is."""
    return sorted(r["n"] for r in names.select(F.explode(each).alias("n")).distinct().collect())


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, i, token: the cleaned tokens between blanks, blank ones too (they part neighbours)."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"[ \t\n\r]+")).alias("i", "_t")).select("doc_id", "i", cleaned(F.col("_t")).alias("token"))


def single(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, i, name: tokens that are one-word names."""
    keys = names.select(F.lower("value").alias("token"), F.col("value").alias("name")).filter("NOT contains(token, ' ')").dropDuplicates(["token"])
    return tokens(docs).filter("token <> ''").join(_small(keys), "token").select("doc_id", "i", "name")


def ngrams(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, i, n, name: n neighbouring tokens (2 or more, as many as names of the list have) that make up a name.

    A token goes on with those after it only if a name begins with it.
    """
    keys = names.select(F.lower("value").alias("gram"), F.col("value").alias("name")).filter("contains(gram, ' ')").dropDuplicates(["gram"])
    counts = lengths(keys, F.array(F.size(F.split("gram", " "))))
    if not counts:
        return docs.select("doc_id", F.lit(1).alias("i"), F.lit(1).alias("n"), F.lit("").alias("name")).limit(0)
    lists = docs.select("doc_id", F.transform(F.split("text", r"[ \t\n\r]+"), cleaned).alias("_ts"))
    each = lists.select("doc_id", F.posexplode(F.transform("_ts", lambda t, i: F.struct(t.alias("t"), F.slice("_ts", i + 1, F.lit(counts[-1])).alias("ts")))).alias("i", "_x"))
    first = keys.select(F.substring_index("gram", " ", 1).alias("_first")).distinct()
    begun = each.join(_small(first), F.col("_x.t") == F.col("_first"), "left_semi")
    grams = begun.select("doc_id", "i", F.explode(F.array(*map(F.lit, counts)).cast("array<int>")).alias("n"), "_x.ts").filter("size(ts) >= n")
    solid = grams.select("doc_id", "i", "n", F.slice("ts", F.lit(1), F.col("n")).alias("_g")).filter(~F.array_contains("_g", ""))
    return solid.select("doc_id", "i", "n", F.array_join("_g", " ").alias("gram")).join(_small(keys), "gram").select("doc_id", "i", "n", "name")


def runs(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, i, m, name: names by runs of letters and digits, however they are glued to punctuation.

    A text (in ASCII punctuation) is cut into runs of ASCII letters or digits and
    single other marks; m neighbouring ones joined without blanks are looked up
    among names without blanks, for every m that a name of the list has, with
    its blanks or without, and 1 to 4. A bounded name starts and ends at the ends
    of runs, so none is lost. A name of many runs is looked for only where it can
    begin, so it costs nothing elsewhere.
    """
    cut = lambda v: F.regexp_extract_all(folded(v), F.lit(RUNS), F.lit(0))
    size = lambda v: F.size(cut(v))
    plain = names.select("value", normalised(F.col("value")).alias("_v"))
    glued = F.regexp_replace("_v", r"\s+", "")
    counts = sorted({1, 2, 3, 4}.union(lengths(plain.filter(size(glued) > 0), F.sequence(size(glued), size(F.col("_v"))))))
    keys = plain.select(folded(glued).alias("key"), F.col("value").alias("name")).filter("key <> ''").dropDuplicates(["key"])
    lists = docs.select("doc_id", cut(normalised(F.col("text"))).alias("_r")).filter("size(_r) > 0")
    short, long = [m for m in counts if m <= SIDE_BY_SIDE], [m for m in counts if m > SIDE_BY_SIDE]
    # A run and the few after it side by side: copies of the array, each a place further on.
    ahead = F.arrays_zip(*[F.slice("_r", F.lit(k + 1), F.size("_r")).alias(f"r{k}") if k else F.col("_r").alias("r0") for k in range(short[-1])])
    each = lists.select("doc_id", F.posexplode(ahead).alias("i", "_x"))
    joined = lambda m: F.concat(*[F.col(f"_x.r{k}") for k in range(m)])
    keyed = each.select("doc_id", "i", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), joined(m).alias("key")) for m in short])).alias("_g")).filter("_g.key IS NOT NULL").select("doc_id", "i", "_g.*")
    found = keyed.join(_small(keys), "key").select("doc_id", "i", "m", "name")
    if not long:
        return found
    # Names of more runs: only where a run stands that one of them begins with, or that begins its first.
    few = keys.filter(size(F.col("name")) > SIDE_BY_SIDE)
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("_f"))), lambda n: F.substring("_f", F.lit(1), n))
    first = few.select(F.regexp_extract("key", RUNS, 0).alias("_f")).distinct().select(F.explode(begins).alias("_b")).distinct()
    begun = lists.select("doc_id", F.posexplode("_r").alias("i", "_t")).join(_small(first), F.col("_t") == F.col("_b"), "left_semi").select("doc_id", "i")
    per_doc = lists.join(begun.groupBy("doc_id").agg(F.collect_set("i").alias("_at")), "doc_id")
    cuts = F.transform("_at", lambda i: F.struct(i.alias("i"), F.slice("_r", i + 1, F.lit(long[-1])).alias("ts")))
    grams = per_doc.select("doc_id", F.explode(cuts).alias("_x")).select("doc_id", "_x.*").select("doc_id", "i", "ts", F.explode(F.array(*map(F.lit, long)).cast("array<int>")).alias("m")).filter("size(ts) >= m")
    more = grams.select("doc_id", "i", "m", F.array_join(F.slice("ts", F.lit(1), F.col("m")), "").alias("key")).join(_small(few), "key")
    return found.unionByName(more.select("doc_id", "i", "m", "name"))


def spans_of_names(docs: DataFrame, names: DataFrame, rule: str = "name") -> DataFrame:
    """doc_id, rule, start, stop, matched (folded) of a list's values, of any kind and however many, where letters or digits do not run on: what a bounded pattern for each would find."""
    found = substrings.places(docs, names, rule, bounds="names")
    return found.withColumn("matched", folded(F.col("matched"))).distinct()
