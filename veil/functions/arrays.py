"""Array columns: a value used more than once, and running aggregates inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in a block of a running aggregate.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are computed once a row, however often they are used: projections that follow each other are otherwise put into one, with a copy of a column for each use."""
    for name, value in columns.items():
        rows = rows.withColumn(name, F.explode(F.array(value)))
    return rows


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What a step from 0 has reached before each value of an array of longs, and at last after all.

    An array is copied whenever it grows, so they grow in blocks: within each,
    then over the blocks' ends. A row of n values takes n times the block's
    length, not n times n.
    """

    def grown(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))

    def placed(own: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / BLOCK).cast("int")), lambda b: grown(F.slice(own, b * BLOCK + 1, F.lit(BLOCK))))
        return let(parts, lambda p: let(grown(F.transform(p, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(p, lambda x, i: spread(x, i, ends)))))

    def spread(x: Column, i: Column, ends: Column) -> Column:
        return F.transform(F.slice(x, F.when(i == 0, 1).otherwise(2), F.lit(BLOCK + 1)), lambda v: step(F.get(ends, i), v))

    return let(values, placed)


def up_to(ordered: Column, value: Column) -> Column:
    """How many values of an array in order are at most `value`, by halving."""

    def halved(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        goes = F.get(ordered, mid) <= value
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & goes, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~goes, mid).otherwise(a["hi"]).alias("hi"))

    turns = F.sequence(F.lit(0), F.length(F.bin(F.size(ordered).cast("bigint"))))
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), halved, lambda a: a["lo"])


def characters(text: Column) -> Column:
    """The characters of a text, one by one: cutting a long text at many places then takes time in proportion."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
