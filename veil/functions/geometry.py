"""Rectangles in points, y downwards, as columns x0, y0, x1, y1 with a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def overlap(a: str, b: str) -> Column:
    """Whether rectangles a and b have an area in common."""
    c = lambda p, s: F.col(f"{p}{s}")
    return (c(a, "x0") < c(b, "x1")) & (c(b, "x0") < c(a, "x1")) & (c(a, "y0") < c(b, "y1")) & (c(b, "y0") < c(a, "y1"))


def near(a: str, b: str, within: float = 3.0) -> Column:
    """Whether all four sides differ by less than `within`."""
    out = F.lit(True)
    for s in SIDES:
        out = out & (F.abs(F.col(f"{a}{s}") - F.col(f"{b}{s}")) < within)
    return out


def union() -> list[Column]:
    """Aggregates: the least rectangle around all of a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def repaired() -> dict[str, Column]:
    """Sides of rectangles that are at least 1 wide and high."""
    return {"x1": F.greatest(F.col("x1"), F.col("x0") + 1), "y1": F.greatest(F.col("y1"), F.col("y0") + 1)}


def label() -> Column:
    """The text put on a rectangle: none where it would not fit."""
    return F.when((F.col("x1") - F.col("x0") < 10) | (F.col("y1") - F.col("y0") < 10), "").otherwise("REDACTED")


def contains(outer: str, inner: str) -> Column:
    """Whether one rectangle holds another."""
    c = lambda p, s: F.col(f"{p}{s}")
    return (c(outer, "x0") <= c(inner, "x0")) & (c(outer, "y0") <= c(inner, "y0")) & (c(outer, "x1") >= c(inner, "x1")) & (c(outer, "y1") >= c(inner, "y1"))


def clamped(width: str = "width", height: str = "height") -> dict[str, Column]:
    """Sides of rectangles cut at the page's."""
    return {s: F.least(F.greatest(F.col(s), F.lit(0.0)), F.col(width if s[0] == "x" else height)) for s in SIDES}


def shares(width: str = "width", height: str = "height") -> dict[str, Column]:
    """Sides in points as shares of the page."""
    return {s: F.col(s) / F.col(width if s[0] == "x" else height) for s in SIDES}


#: Cells of the coarser grids are so many times as wide as those of the next finer one; the coarsest has one cell a page.
CELL, COARSER, LEVELS = 48.0, 4.0, 4


def level() -> Column:
    """The finest grid of which a rectangle touches two cells each way at most."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(side <= CELL * COARSER**k, F.lit(k)).otherwise(out)
    return out


def cells(levels: Column) -> Column:
    """level, cx, cy of the cells that a rectangle touches in each of some grids."""

    def of(k: Column) -> Column:
        step = F.lit(CELL) * F.pow(F.lit(COARSER), k)
        span = lambda a, z: F.when(k < LEVELS - 1, F.sequence(F.floor(F.col(a) / step), F.floor(F.col(z) / step))).otherwise(F.array(F.lit(0).cast("bigint")))
        return F.flatten(F.transform(span("x0", "x1"), lambda x: F.transform(span("y0", "y1"), lambda y: F.struct(k.cast("int").alias("level"), x.alias("cx"), y.alias("cy")))))

    return F.flatten(F.transform(levels, of))
