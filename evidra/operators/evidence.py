"""Evidence as a long table (entity, axis, value, confidence), and everything that ranks by it.

value and confidence are whole hundredths: sums of weighted signals are then the same whatever
the order in which they are added. A null value was not measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.text import weighted_half_up

# What stands in for a signal that was not measured, in hundredths.
IMPUTED_VALUE, IMPUTED_CONFIDENCE = 50, 10


def axis_table(weights: dict[str, int]) -> str:
    """SQL rows of (axis, weight)."""
    return ", ".join(f"('{a}', {w})" for a, w in weights.items())


def weight_column(weights: dict[str, int]) -> Column:
    """An axis's weight; null for one that isn't active."""
    case = F.lit(None).cast("long")
    for axis, w in weights.items():
        case = F.when(F.col("axis") == axis, F.lit(w).cast("long")).otherwise(case)
    return case


def melt(wide: DataFrame, entity: str, axes: list[str]) -> DataFrame:
    """(entity, axis, value, confidence) from columns axis (hundredths, null if not measured) and axis_confidence."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("long").alias("value"), F.col(f"{a}_confidence").cast("long").alias("confidence")) for a in axes])).alias("s")
    return wide.select(entity, rows).select(entity, "s.*")


def impute(evidence: DataFrame) -> DataFrame:
    """Fills what was not measured, and marks it."""
    gone = F.col("value").isNull()
    return evidence.withColumns({
        "imputed": gone,
        "confidence": F.when(gone, F.lit(IMPUTED_CONFIDENCE).cast("long")).otherwise(F.coalesce("confidence", F.lit(0).cast("long"))),
        "value": F.coalesce("value", F.lit(IMPUTED_VALUE).cast("long")),
    })


def rank_totals(evidence: DataFrame, entity: str, weights: dict[str, int], disabled: tuple[str, ...] = ()) -> DataFrame:
    """(entity, total, confidence, unmeasured): the weighted mean over active axes, half up, in one shuffle by entity."""
    active = {a: w for a, w in weights.items() if a not in disabled}
    rows = impute(evidence).withColumn("w", weight_column(active)).filter("w is not null")
    sums = rows.groupBy(entity).agg(
        F.sum(F.col("value") * F.col("w")).alias("s"),
        F.sum("w").alias("sw"),
        F.sum(F.col("confidence") * F.col("w")).alias("c"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("imputed"), F.col("axis")))), ",").alias("unmeasured"),
    )
    return sums.select(entity, weighted_half_up(F.col("s"), F.col("sw")).alias("total"), weighted_half_up(F.col("c"), F.col("sw")).alias("confidence"), "unmeasured")


def indexed_confidence(confidence: Column, indexed: Column) -> Column:
    """Confidence in hundredths, ten more (a hundred at most) where a code index was read."""
    return F.least(F.lit(100), confidence + F.when(indexed, 10).otherwise(0)).cast("long")


def gated(total: Column, gates: list[tuple[Column, int]]) -> Column:
    """total after each gate's percentage in turn, rounded half up after each; gates are (condition, percent)."""
    for test, percent in gates:
        total = F.when(test, F.floor((2 * total * percent + 100) / 200).cast("long")).otherwise(total)
    return total


def tiered(scored: DataFrame, order: list[Column], keep: int, least: int | None = None) -> DataFrame:
    """The first keep rows by order with their rank; rows under least go unless they are shortlisted."""
    if least is not None:
        scored = scored.filter((F.col("total") >= least) | F.col("shortlisted"))
    top = scored.orderBy(*order).limit(keep)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def reasons(evidence: DataFrame, entity: str, weights: dict[str, int], best: int = 5, worst: int = 4, high: int = 75, low: int = 40) -> DataFrame:
    """(entity, side, rank, axis, value): the strongest measured signals by what they add, the weakest by what they cost."""
    rows = evidence.filter("value is not null").withColumn("w", weight_column(weights)).filter("w is not null")
    sides = [("for", F.col("value") >= high, F.col("value") * F.col("w"), best), ("against", F.col("value") <= low, (100 - F.col("value")) * F.col("w"), worst)]
    out = None
    for side, test, size, keep in sides:
        order = Window.partitionBy(entity).orderBy(F.desc("size"), "axis")
        part = rows.filter(test).withColumn("size", size).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= keep)
        part = part.select(entity, F.lit(side).alias("side"), "rank", "axis", "value")
        out = part if out is None else out.unionByName(part)
    return out


def axis_spread(evidence: DataFrame, entity: str, tied_under: int = 15) -> DataFrame:
    """(axis, least, most, spread, winner, tied) over measured signals; the winner of a tie is the least entity."""
    rows = evidence.filter("value is not null")
    got = rows.groupBy("axis").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.max(F.struct("value", (-F.col(entity)).alias("k"))).alias("top"))
    spread = F.col("most") - F.col("least")
    return got.select("axis", "least", "most", spread.alias("spread"), (-F.col("top.k")).alias("winner"), (spread < tied_under).alias("tied"))


def recency_steps(days: Column) -> Column:
    """Hundredths for the days since the last activity."""
    return F.when(days <= 30, 100).when(days <= 90, 85).when(days <= 180, 70).when(days <= 365, 50).when(days <= 730, 25).otherwise(8)


def age_ceiling(days: Column) -> Column:
    """The most that something so young can have."""
    return F.when(days <= 30, 45).when(days <= 90, 60).when(days <= 365, 80).otherwise(100)


def popularity(count: Column) -> Column:
    return F.least(F.lit(100), F.floor(F.log10(count + 1) / 4.5 * 100 + 0.5)).cast("long")


def dependency_simplicity(count: Column) -> Column:
    value = F.lit(1.0) - F.log10(count / 3.0) / F.log10(F.lit(20.0))
    return F.when(count <= 3, 100).otherwise(F.greatest(F.lit(0), F.floor(value * 100 + 0.5))).cast("long")
