"""Sharding by a minimax contiguous partition of atomic groups.

Documents with equal texts form a group that stays whole. Groups are ordered by
a hash of their text; the smallest shard capacity for which a greedy pass over
that order needs no more than the wished number of shards is found by binary
search. A greedy pass only asks for the last group boundary at or below a
position. The driver answers from a table of at most `bins` boundaries around
the places where cuts can fall; where two of its boundaries may hide others
that matter, the table is drawn again from the groups, closer around the cuts,
until the smallest capacity is exact. So the driver's memory does not grow with
the corpus, and the groups are read a few times, filtered to those places.

Shards are then cut as evenly as that capacity allows: each takes what is next
to an equal share of the rest, and never so little that what is left would
exceed the capacity.

Cases: a null text counts as empty; repeated rows are documents of one group;
with fewer groups than shards some shards are empty; a group larger than an
equal share sets the capacity; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Parts of a group's rows that are numbered apart.
SALTS = 256
#: Hash ranges within which groups are summed one after another.
GROUPS_IN_RANGE = 100_000


def _totals(groups: DataFrame, ranges: int) -> DataFrame:
    """groups with stop and rows_before: the bytes up to and with each group and the rows before it, in order of hash."""
    spread = groups.withColumn("range", F.floor((F.shiftrightunsigned("h1", 1)) / F.lit(2.0**63 / ranges)).cast("int"))
    sums = spread.groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("range").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spread.join(offsets, "range").select(
        "h1", "h2", "bytes", (F.col("b0") + F.sum("bytes").over(inside)).alias("stop"), (F.col("r0") + F.sum("rows").over(inside) - F.col("rows")).alias("rows_before")
    )


class Boundaries:
    """Ends of groups, sorted, as far as they are known, and for each whether unknown ones may lie between it and the next."""

    def __init__(self, stops: np.ndarray, hidden: np.ndarray, total: int):
        self.stops, self.hidden, self.total = stops, hidden, total

    def last(self, x: int) -> tuple[int, int]:
        """The last known end at or below x, and the last that there can be."""
        if x >= self.total:
            return self.total, self.total
        i = int(np.searchsorted(self.stops, x, "right")) - 1
        at = int(self.stops[i])
        return at, min(x, int(self.stops[i + 1]) - 1) if self.hidden[i] else at

    def greedy(self, capacity: int, shards: int, best: bool) -> list[int]:
        """Where shards end: by what is known, or if best by what is possible."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.last(at + capacity)[best]
            ends.append(at)
        return ends


def _search(b: Boundaries, shards: int, least: int) -> tuple[int, int]:
    """The least capacity that what is known allows, and the least that is possible."""
    found = []
    for best in (False, True):
        low, high = least, b.total
        while low < high:
            mid = (low + high) // 2
            if b.greedy(mid, shards, best)[-1] >= b.total:
                high = mid
            else:
                low = mid + 1
        found.append(low)
    return found[0], found[1]


def _look(groups: DataFrame, spans: list[tuple[int, int]], bins: int) -> dict[int, bool]:
    """Ends at the first and last place of equal bins of each span; True where a bin has others between its two."""
    each = max(1, bins // len(spans))
    place = F.lit(None).cast("string")
    for k, (a, z) in enumerate(spans):
        width = max(1, -(-(z - a) // each))
        place = F.when((F.col("stop") > a) & (F.col("stop") <= z), F.concat_ws(":", F.lit(k), F.floor((F.col("stop") - F.lit(a) - 1) / F.lit(width)).cast("long"))).otherwise(place)
    marks: dict[int, bool] = {}
    for r in groups.select("stop", place.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.min("stop").alias("first"), F.max("stop").alias("last"), F.count("*").alias("n")).collect():
        marks[r["first"]] = r["n"] > 2
        marks.setdefault(r["last"], False)
    return marks


class Known:
    """What several looks have shown."""

    def __init__(self, total: int):
        self.total, self.stops, self.empty = total, {0, total}, set()

    def learn(self, marks: dict[int, bool], spans: list[tuple[int, int]]) -> Boundaries:
        self.stops.update(marks)
        edges, own = sorted(self.stops), sorted(marks)
        for x, y in zip(edges, [*edges[1:], self.total + 1]):
            # Nothing lies between x and y if the look covered all of it, and it isn't within a bin that had more.
            i = bisect_right(own, x) - 1
            if not (i >= 0 and marks[own[i]]) and any(a <= x and y - 1 <= z for a, z in spans):
                self.empty.add(x)
        hidden = np.array([x not in self.empty for x in edges])
        return Boundaries(np.array(edges, np.int64), hidden, self.total)


def cuts(groups: DataFrame, shards: int, bins: int = 60_000) -> list[int]:
    """Where shards end in the running sum of bytes. groups: stop and bytes."""
    head = groups.agg(F.max("stop").alias("total"), F.max("bytes").alias("largest")).first()
    if head["total"] is None:
        return [0] * shards
    total, largest = int(head["total"]), int(head["largest"])
    spans, seen = [(0, total)], Known(total)
    least = max(largest, -(-total // shards))
    while True:
        b = seen.learn(_look(groups, spans, bins), spans)
        known, possible = _search(b, shards, least)
        if known == possible:
            return _even(b, known, shards)
        # Cuts lie between those of the least possible capacity by what is known, and those of the known one by what is possible.
        low, high = b.greedy(possible, shards, False), b.greedy(known, shards, True)
        before, spans = spans, []
        for a, z in sorted((max(0, min(x, y) - 1), min(total, max(x, y) + 1)) for x, y in zip(low, high)):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
            else:
                spans.append((a, z))
        if spans == before:
            bins *= 2


def _even(b: Boundaries, capacity: int, shards: int) -> list[int]:
    """Cuts near equal shares: at known ends, within the capacity, and leaving no more than the shards after them can take."""
    stops, exact = b.stops, b
    # From the right: the least end of each shard from which the rest still fits, at known ends.
    need = [exact.total]
    for _ in range(shards - 1):
        i = int(np.searchsorted(stops, max(0, need[-1] - capacity), "left"))
        need.append(int(stops[i]))
    need.reverse()
    latest = exact.greedy(capacity, shards, False)
    ends, at = [], 0
    for k in range(shards):
        share = at + (exact.total - at) // (shards - k)
        i = int(np.searchsorted(stops, share, "left"))
        near = [int(stops[j]) for j in (i - 1, i) if 0 <= j < len(stops)]
        fits = [x for x in near if at <= x <= at + capacity and x >= need[k]]
        at = min(fits, key=lambda x: abs(x - share)) if fits else max(at, min(need[k], at + capacity)) if at + capacity >= need[k] else latest[k]
        ends.append(at)
    if ends[-1] != exact.total or any(b - a > capacity for a, b in zip([0, *ends], ends)):
        return latest
    return ends


def sharded(docs: DataFrame, shards: int = 24, bins: int = 60_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")
        ),
        "rows",
    )
    groups = staged(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    ranges = max(1, groups.count() // GROUPS_IN_RANGE)
    placed = staged(_totals(groups, ranges), "placed")
    ends = cuts(placed.select("stop", "bytes"), shards, bins)
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends[:-1]]), lambda e: F.col("stop") > e))
    owned = staged(placed.select("h1", "h2", "rows_before", shard.alias("shard")), "owned")
    firsts = owned.groupBy("shard").agg(F.min("rows_before").alias("first"))  # a row for each shard
    owned = owned.join(F.broadcast(firsts), "shard").select("h1", "h2", "shard", (F.col("rows_before") - F.col("first")).alias("base"))
    # Rows of a group are numbered in parts, so that a group of any size is spread.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("h1", "h2").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.join(owned, ["h1", "h2"]).select("h1", "h2", "salt", "shard", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
    own = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id")
    return (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(bases, ["h1", "h2", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
