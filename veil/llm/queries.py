"""Queries over the operators of this package, each over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, lines, pieces, quality, secrets, sharding, substring, surrogates, token_counts, token_ids, variants, whitening
from .common import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


QUERIES["op8_quality_rules"] = op8_quality_rules

QUALITY_SQL = r"""
w AS (SELECT doc_id AS row_key, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             coalesce(text, '') AS t FROM {table}),
g AS (SELECT row_key, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT row_key, i, count(*) OVER (PARTITION BY row_key, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT row_key, count(DISTINCT i + d) AS n FROM h, (VALUES (0), (1), (2)) v(d) WHERE n >= 2 GROUP BY row_key),
m AS (SELECT w.row_key AS doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON r.row_key = w.row_key),
f AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values())) + """ AS BIGINT) AS fail_bits FROM m)
"""

ORACLE["op8_quality_rules"] = f"""WITH {QUALITY_SQL.replace('{table}', 'documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {quality.POLICIES[0].mask}) <> 0 AS base_failed, (fail_bits & {quality.DEFAULT.mask}) = 0 AS kept, fail_bits FROM f"""


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, from a stored ledger."""
    rows = staged(quality.ledger(documents(spark, sf_dir)), "ledger")
    return reduce(DataFrame.unionByName, [quality.ablation(rows, p).withColumn("policy", F.lit(f"{p.name}_v{p.version}")) for p in quality.POLICIES])


QUERIES["quality_ablation"] = quality_ablation

ORACLE["quality_ablation"] = f"WITH {QUALITY_SQL.replace('{table}', 'documents')} " + " UNION ALL ".join(
    f"SELECT '{p.name}_v{p.version}' AS policy, '{r}' AS rule, count(*) FILTER ((fail_bits & {1 << list(quality.RULES).index(r)}) <> 0) AS n_failed, count(*) FILTER ((fail_bits & {p.mask}) = {1 << list(quality.RULES).index(r)}) AS n_only FROM f"
    for p in quality.POLICIES
    for r in p.rules
)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


QUERIES["op3_secret_scans"] = op3_secret_scans


def _secret_sql(table: str) -> str:
    """A CTE for each rule's spans, and one of them all: doc_id, kind (number), start, span."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""r{k} AS (SELECT row_key, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {r.group}) AS vals, string_split_regex(t, '{p}') AS gaps FROM t0),
e{k} AS (SELECT row_key, {k} AS kind, '{r.kind}' AS name, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM r{k} WHERE len(hits) > 0),
s{k} AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row_key ORDER BY i) AS BIGINT) AS stop FROM e{k})"""
        )
    union = " UNION ALL ".join(f"SELECT row_key, kind, stop - length(hit) AS start, name || ':' || (stop - length(hit)) || ':' || stop AS span, length(val) >= {r.at_least} AS ok FROM s{k}" for k, r in enumerate(secrets.RULES))
    return f"t0 AS (SELECT doc_id AS row_key, coalesce(text, '') AS t FROM {table}),\n" + ",\n".join(parts) + f",\nspans AS (SELECT * FROM ({union}) WHERE ok)"


ORACLE["op3_secret_scans"] = f"""WITH {_secret_sql('documents')}
SELECT t0.row_key AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM t0 LEFT JOIN spans ON spans.row_key = t0.row_key GROUP BY t0.row_key"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))


QUERIES["op6_benchmark_decontamination"] = op6_benchmark_decontamination


def _contamination_sql(table: str) -> str:
    r"""The contract by itself: every window of every item against every position, by equality of the joined words."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""dw AS (SELECT doc_id AS row_key, {words} AS ws FROM {table}),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS ws FROM benchmark),
bi AS (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM bw WHERE len(ws) > 0),
bx AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + 9], ' ') AS win FROM bi),
ks AS (SELECT DISTINCT k FROM bx),
di AS (SELECT row_key, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT row_key, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
oc AS (SELECT di.row_key, di.i, di.k, bx.item FROM di JOIN bx USING (k, win)),
hp AS (SELECT row_key, count(DISTINCT p) AS n_hit FROM (SELECT row_key, unnest(range(i, i + k)) AS p FROM oc) GROUP BY row_key),
it AS (SELECT row_key, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_key, item FROM oc) GROUP BY row_key),
cr AS (SELECT dw.row_key AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
       FROM dw LEFT JOIN hp ON hp.row_key = dw.row_key LEFT JOIN it ON it.row_key = dw.row_key)"""


ORACLE["op6_benchmark_decontamination"] = f"WITH {_contamination_sql('documents')} SELECT * FROM cr"


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_report(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op1_token_ids"] = op1_token_ids


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), k=3, threshold=(90, 100))


QUERIES["op2_ngram_jaccard_join"] = op2_ngram_jaccard_join


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_repeats(documents(spark, sf_dir), window=35)


QUERIES["op7_substring_dedup"] = op7_substring_dedup


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.histogram(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.report(staged(lengths, "lengths"))


QUERIES["op4_token_counts"] = op4_token_counts


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


QUERIES["op5_sharding"] = op5_sharding


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmented(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op9_sentencepiece"] = op9_sentencepiece


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(documents(spark, sf_dir), b"veil surrogates")


QUERIES["op10_pii_surrogates"] = op10_pii_surrogates


def _jaccard_sql(table: str, k: int, num: int, den: int) -> str:
    r"""Every pair that shares a shingle, and what links reach. CTEs; the last is cl: doc_id, n_shingles, component_id."""
    return rf"""RECURSIVE jw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {table}),
sh AS (SELECT DISTINCT doc_id, least({k}, len(ws)) AS k, array_to_string(ws[i:i + {k} - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {k} + 1) + 1)) AS i FROM jw WHERE len(ws) > 0)),
sn AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sp AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS (SELECT x, y FROM sp JOIN sn p ON p.doc_id = x JOIN sn q ON q.doc_id = y WHERE {den} * o >= {num} * (p.n + q.n - o)),
ed AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
rc(doc, root) AS (SELECT doc_id, doc_id FROM jw UNION SELECT ed.y, rc.root FROM rc JOIN ed ON ed.x = rc.doc),
cl AS (SELECT jw.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM jw LEFT JOIN sn USING (doc_id) JOIN (SELECT doc, min(root) AS c FROM rc GROUP BY doc) ON doc = jw.doc_id)"""


ORACLE["op2_ngram_jaccard_join"] = f"WITH {_jaccard_sql('documents', 3, 90, 100)} SELECT * FROM cl"

ORACLE["op7_substring_dedup"] = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(len(ws))) AS j, unnest(ws) AS word FROM w),
g AS (SELECT doc_id, j, count(*) OVER v AS n, md5(string_agg(word, ' ') OVER v) AS h FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, j FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM g WHERE n = 35) WHERE c > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(j, j + 35)) AS j FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.j = x.j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduped_lines(documents(spark, sf_dir))


QUERIES["op11_line_dedup"] = op11_line_dedup

ORACLE["op11_line_dedup"] = r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES["op12_embedding_whitening"] = op12_embedding_whitening


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(documents(spark, sf_dir))


QUERIES["op13_spelling_variants"] = op13_spelling_variants
