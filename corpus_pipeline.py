"""From raw documents to token ids: quality rules, near copies, benchmark passages, secrets, segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result as Parquet to the shared folder and gives it to the next.
All stages but the last return the columns of documents. Stages work on
documents of any kind: null texts and short ones fail the quality rules; doc_ids
may be null or repeated; columns may have any names; an empty table passes
through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import decontaminate, jaccard, pieces, quality, secrets
from veil.llm.common import BROADCAST_ROWS, staged, whole


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles, the one with the smallest doc_id.

    Documents are told apart by row: a doc_id may be null or repeated, with the
    same text (one stays) or with others (each is judged by its own). A null
    doc_id comes last, and of equal doc_ids in a group the first row written
    stays. Texts without words are copies of nothing.
    """
    rows = staged(docs.select(F.monotonically_increasing_id().alias("doc_id"), whole(docs).alias("_doc")), "rows")
    found = jaccard.jaccard_components(rows.select("doc_id", F.col("_doc.text").alias("text")), k=5, threshold=(80, 100))
    named = staged(found.join(rows.select("doc_id", F.col("_doc.doc_id").alias("_own")), "doc_id").select("doc_id", "component_id", "_own"), "named")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("_own").isNull(), "_own", "doc_id"))["doc_id"].alias("doc_id"))
    drop = staged(named.select("doc_id").join(best, "doc_id", "left_anti"), "dropped")
    return rows.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, "doc_id", "left_anti").select("_doc.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.masked(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    return pieces.segmented(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_scans),
    ("SentencePiece encoding", segmentation),
]

#: The last stage has no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"), codec="snappy")
    return docs
