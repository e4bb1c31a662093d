"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Nodes with more than a share of 1 / MOST_HUBS of all edges are joined by broadcast; there can't be more than that many.
MOST_HUBS = 100_000


def _least(edges: DataFrame, least: Column, most: int) -> DataFrame:
    """Each edge with the m of its a. Edges of one node don't meet in a task: those of hubs (more than `most` edges) stay where they are."""
    of = edges.groupBy("a").agg(least.alias("m"), F.count("*").alias("_edges"))
    hubs = F.broadcast(of.filter(F.col("_edges") > most).drop("_edges"))
    rest = of.filter(F.col("_edges") <= most).drop("_edges")
    return edges.join(hubs, "a").unionByName(edges.join(hubs, "a", "left_anti").join(rest, "a"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Link each node's larger neighbours to its smallest one (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both, F.least(F.min("b"), F.first("a")), most).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _least(down, F.min("b"), most)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(moved.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that each node of an edge can reach.

    Edges may be in either direction and repeated. Rounds end when the edges
    are stars and stay as they are; each round is written to the shared folder.
    """
    now = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        most = max(1000, 2 * state[0] // MOST_HUBS)
        large = staged(_large_star(now, most), "large")
        now = staged(_small_star(large, most), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
