"""Token counts from an exact histogram of document lengths.

Every document is encoded once; what is kept of the corpus is how many
documents have each length. Sums over the longer lengths then answer, for every
context limit at once, how many documents reach it, what they hold, and what is
left of the corpus when each document is cut there; quantiles are lookups.

Cases: a null text has no tokens and counts as a document of length 0; copies
count each; an empty table gives an empty histogram; other columns are ignored; runs
of white space of any length are taken.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, with_offsets


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern's \\s has it (fixed values), in runs that are too long for the library's matcher.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
#: How a pattern ends that takes a run of white space whole, but for its last character before other text.
TAKES_RUNS = r"|\s+(?!\S)|\s+"


def count_tokens(encoder, text: str) -> int:
    """How many ids a text has. The matcher would run out of stack in a very long run of white space; what the pattern makes of one is encoded as it is."""
    n, at = 0, 0
    if encoder._pat_str.endswith(TAKES_RUNS):
        for m in LONG_BLANK.finditer(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            n += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : stop].encode()))
            at = stop
    return n + len(encoder.encode_ordinary(text[at:]))


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = encoding(path, pattern), {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n = count_tokens(encoder, text) if text else 0
                found[n] = found.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "docs"])

    return run


def histogram(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """n_tokens, docs: a row for each length that occurs. tokenizer: a file of ranks; pattern: how it splits texts."""
    return docs.select("text").mapInArrow(_lengths(tokenizer, pattern), "n_tokens long, docs long").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def by_limit(lengths: DataFrame) -> DataFrame:
    """For each length L of a histogram as a context limit.

    docs and tokens of exactly L; docs_at_least, tokens_at_least of L or more;
    docs_below, tokens_below; tokens_truncated: what a limit of L leaves of all
    documents; tokens_lost: the rest. A limit between two lengths follows from
    the next length above it: tokens_below + limit * docs_at_least.
    """
    each = lengths.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"))
    below = with_offsets(each, "n_tokens", 1024, {"docs_below": "docs", "tokens_below": "tokens"})
    docs, tokens = each.agg(F.sum("docs"), F.sum("tokens")).first()
    rows = below.withColumns({"docs_at_least": F.lit(docs) - F.col("docs_below"), "tokens_at_least": F.lit(tokens) - F.col("tokens_below")})
    return rows.withColumn("tokens_truncated", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).select(
        "n_tokens", "docs", "tokens", "docs_below", "tokens_below", "docs_at_least", "tokens_at_least", "tokens_truncated", (F.lit(tokens) - F.col("tokens_truncated")).alias("tokens_lost")
    )


#: Context limits and shares of documents that a report answers.
LIMITS = (128, 256, 512, 1024, 2048, 4096, 8192, 16_384, 32_768, 131_072)
SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def report(lengths: DataFrame) -> DataFrame:
    """by_limit() as rows of kind `length`; `limit` rows for LIMITS, with how many documents reach them and what they leave; `quantile` rows for SHARES. What a kind doesn't have is null."""
    answers = staged(by_limit(lengths).withColumn("kind", F.lit("length")), "answers")
    limits = at_limits(answers, list(LIMITS)).withColumnRenamed("limit", "n_tokens").withColumn("kind", F.lit("limit"))
    shares = quantiles(answers, list(SHARES)).withColumn("kind", F.lit("quantile"))
    return answers.unionByName(limits, allowMissingColumns=True).unionByName(shares, allowMissingColumns=True)


def at_limits(answers: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_at_least, tokens_truncated for any context limits, from by_limit()."""
    total = answers.agg(F.sum("tokens")).first()[0] or 0
    # The next length at or above a limit says all; beyond the longest document nothing is cut. One pass, a column for each limit.
    found = answers.agg(*[F.min_by(F.struct("docs_at_least", (F.col("tokens_below") + x * F.col("docs_at_least")).alias("tokens")), F.when(F.col("n_tokens") >= x, F.col("n_tokens"))).alias(f"l{k}") for k, x in enumerate(limits)]).first()
    rows = [(x, *(found[f"l{k}"] or (0, total))) for k, x in enumerate(limits)]
    return answers.sparkSession.createDataFrame(rows, "limit long, docs_at_least long, tokens_truncated long")


def quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that this share of documents does not exceed, from by_limit()."""
    total = answers.agg(F.sum("docs")).first()[0] or 0
    found = answers.agg(*[F.min(F.when(F.col("docs_below") + F.col("docs") >= x * total, F.col("n_tokens"))).alias(f"q{k}") for k, x in enumerate(shares)]).first()
    return answers.sparkSession.createDataFrame([(float(x), found[f"q{k}"]) for k, x in enumerate(shares)], "share double, n_tokens long")
