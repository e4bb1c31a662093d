"""The candidate table: kind, value, context, source, count, confirmed; a row for each (kind, value)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import natural_key
from ..functions.validate import kind_of, name_shape, phone_shape

KEY = ["kind", "value"]


def _placed_finds(finds: DataFrame) -> DataFrame:
    """Finds that are equal in all but their place, once, with their count and first place as one number.

    A text or a struct cannot be kept up in place while rows are added up, so
    Spark sorts all rows for its first value; a number can. Place is doc_id times
    2^63 plus start, a null before all others of its kind.
    """
    whole = lambda c, none: F.coalesce(F.col(c).cast("decimal(19,0)"), F.lit(str(none)).cast("decimal(19,0)"))
    place = whole("doc_id", -(2**63) - 1) * F.lit(str(2**63)).cast("decimal(19,0)") + whole("start", -1)
    return finds.groupBy(*KEY, "context", "source").agg(F.count("*").alias("count"), F.min(place).alias("_place"))


def roll_up(finds: DataFrame, seed: DataFrame | None = None, confirm: bool = True) -> DataFrame:
    """Candidates of finds (kind, value, context, source, doc_id, start): counts add up, the first sighting gives context and source, a table makes the source a table. A seed's rows come first and, if confirm, are confirmed."""
    places = {c: finds.schema[c].dataType for c in ("doc_id", "start")}
    if finds.isStreaming or seed is not None or not all(isinstance(t, IntegralType) for t in places.values()):
        seen = finds.select(*KEY, "context", "source", F.lit(1).cast("bigint").alias("count"), F.lit(False).alias("confirmed"), F.struct(F.lit(1).alias("p"), F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("source").alias("r")).alias("seq"))
    else:
        seen = _placed_finds(finds).select(*KEY, "context", "source", "count", F.lit(False).alias("confirmed"), F.struct("_place", "source").alias("seq"))
    if seed is not None:
        seen = seed.select(*KEY, "context", "source", "count", (F.col("confirmed") | F.lit(confirm)).alias("confirmed"), F.struct(F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("s"), F.col("source").alias("r")).alias("seq")).unionByName(seen)
    return seen.groupBy(*KEY).agg(
        F.min_by("context", "seq").alias("context"),
        F.when(F.bool_or(F.col("source") == "table"), "table").otherwise(F.min_by("source", "seq")).alias("source"),
        F.sum("count").alias("count"),
        F.bool_or("confirmed").alias("confirmed"),
    )


def keep(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows, confirmed; what is not chosen goes."""
    return candidates.join(chosen.select(*KEY).distinct(), KEY, "left_semi").withColumn("confirmed", F.lit(True))


def promote(curated: DataFrame, leftovers: DataFrame, chosen: DataFrame, source: str = "manual") -> DataFrame:
    """The curated rows and the chosen leftovers that are not among them."""
    new = leftovers.join(chosen.select(*KEY).distinct(), KEY, "left_semi").join(curated, KEY, "left_anti")
    return curated.unionByName(new.withColumn("source", F.lit(source)).select(curated.columns))


def add_values(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates and the new values among free lines (value), each of the kind that it looks like."""
    new = lines.select(F.trim("value").alias("value")).filter("value <> ''").distinct()
    new = new.select(kind_of(F.col("value")).alias("kind"), "value", F.lit("").alias("context"), F.lit("manual").alias("source"), F.lit(1).cast("bigint").alias("count"), F.lit(False).alias("confirmed"))
    return candidates.unionByName(new.join(candidates, KEY, "left_anti"))


def difference(now: DataFrame, saved: DataFrame) -> DataFrame:
    """kind, value, change: what saving would add or remove."""
    a, b = now.select(*KEY, F.lit(1).alias("_now")), saved.select(*KEY, F.lit(1).alias("_saved"))
    return a.join(b, KEY, "full_outer").filter("_now IS NULL OR _saved IS NULL").select(*KEY, F.when(F.col("_saved").isNull(), "add").otherwise("remove").alias("change"))


def cleaned_list(values: DataFrame, function_words: Sequence[str] | None = None) -> DataFrame:
    """value, kept, n: valid names once each, and the rest with how often they stood there."""
    v = values.select(F.trim("value").alias("value")).filter("value <> ''")
    return v.groupBy("value").agg(F.count("*").alias("n")).withColumn("kept", name_shape(F.col("value"), function_words)).select("value", "kept", F.when(F.col("kept"), 1).otherwise(F.col("n")).cast("bigint").alias("n"))


def first_removed(cleaned: DataFrame, n: int = 20) -> DataFrame:
    """value, n of the first values, in order, that cleaning took out."""
    return cleaned.filter("NOT kept").orderBy("value").limit(n).select("value", "n")


@dataclass(frozen=True)
class Weights:
    """What adds to a candidate's score, and from which score it counts as sure (fixed values by default)."""

    table: int = 4
    email: int = 4
    phone: int = 3
    several_words: int = 2
    most_repeats: int = 3
    ambiguous: int = 3
    single_guess: int = 1
    high: int = 4
    medium: int = 1

    def changed(self, **values: object) -> Weights:
        """With the values that are whole numbers; others are ignored."""
        good = {k: int(v) for k, v in values.items() if k in asdict(self) and str(v).lstrip("-").isdigit()}
        return Weights(**(asdict(self) | good))


def scored(candidates: DataFrame, common: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Candidates with ambiguous, score and tier."""
    words = common.select(F.lower("value").alias("_c")).distinct().withColumn("_common", F.lit(True))
    c = candidates.join(words, F.lower("value") == F.col("_c"), "left")
    one = ~F.contains(F.trim("value"), F.lit(" "))
    is_name = F.col("kind") == "name"
    ambiguous = F.coalesce(is_name & one & F.col("_common"), F.lit(False))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = (
        points(F.col("source") == "table", w.table)
        + points(F.col("kind") == "email", w.email)
        + points((F.col("kind") == "phone") & phone_shape(F.col("value")), w.phone)
        + points(is_name & ~one, w.several_words)
        + F.least(F.col("count") - 1, F.lit(w.most_repeats))
        - points(ambiguous, w.ambiguous)
        - points(is_name & one & (F.col("source") == "ner"), w.single_guess)
    ).cast("bigint")
    return c.withColumn("ambiguous", ambiguous).withColumn("score", score).withColumn("tier", _tier(F.col("score"), w)).drop("_c", "_common")


def _tier(score: Column, w: Weights) -> Column:
    sure = F.col("confirmed") | (F.col("source") == "manual")
    return F.when(sure | (score >= w.high), "High").when(score >= w.medium, "Medium").otherwise("Low")


def annotated(candidates: DataFrame, common: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Scored candidates; one-word names that are part of a High name of several words become High."""
    s = scored(candidates, common, w)
    parts = s.filter("kind = 'name' AND tier = 'High' AND contains(value, ' ')").select(F.explode(F.split("value", r"\s+")).alias("_part")).distinct().withColumn("_of", F.lit(True))
    return s.join(parts, (F.col("kind") == "name") & (F.col("value") == F.col("_part")), "left").withColumn("tier", F.when(F.col("_of"), "High").otherwise(F.col("tier"))).drop("_part", "_of")


def tier_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tier", "kind").agg(F.count("*").alias("n"))


def review(rows: DataFrame, saved: DataFrame, find: str = "") -> DataFrame:
    """What a reviewer sees: surest first, with whether to keep it and whether it is saved already; find filters by any visible column."""
    known = saved.select(*KEY).distinct().withColumn("saved", F.lit(True))
    out = rows.join(known, KEY, "left").withColumn("saved", F.coalesce("saved", F.lit(False))).withColumn("keep", F.col("tier") == "High")
    return out.filter(F.contains(F.lower(F.concat_ws(" ", *KEY, "context", "source")), F.lit(find.lower()))).orderBy(*review_order())


def review_order() -> list[Column]:
    """Surest first, then by kind and value, digits by what they count."""
    tier = F.when(F.col("tier") == "High", 0).when(F.col("tier") == "Medium", 1).otherwise(2)
    return [tier, F.col("kind"), natural_key(F.col("value")), F.col("value")]


def positions(rows: DataFrame, order: list[Column] | None = None, prefix: int = 3) -> DataFrame:
    """Rows with their position (from 1) in an order of columns of which the last two are texts, without a sort of all rows in one place.

    Rows that begin alike are numbered side by side; only the counts of
    beginnings, which are few, are added up in order.
    """
    order = review_order() if order is None else order
    named = {f"_o{k}": c for k, c in enumerate(order)}
    keyed = rows.select("*", *[c.alias(n) for n, c in named.items()])
    text = f"_o{len(order) - 2}"
    keyed = keyed.withColumn("_p", F.substring(text, 1, prefix))
    begin = [*list(named)[:-2], "_p"]
    counts = keyed.groupBy(*begin).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*begin).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*begin, before.alias("_before"))
    inside = Window.partitionBy(*begin).orderBy(*list(named)[-2:])
    return keyed.join(starts, begin).withColumn("position", F.col("_before") + F.row_number().over(inside)).select(*rows.columns, "position")
