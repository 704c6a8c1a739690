"""Tables of facts and cached values: all-of lookups, upserts, expiry, eviction, request windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def all_of(facts: DataFrame, entity: str, capability: str, strength: str, wanted: list[str], least: float, most: int | None = None) -> DataFrame:
    """(entity, strength_sum): entities that have every wanted capability at that strength, strongest first.

    Wanted names are made distinct and compared without case. Partial sums are made before the
    one shuffle, by entity; no wanted name gives no entity.
    """
    names = sorted({w.lower() for w in wanted})
    rows = facts.filter(F.lower(capability).isin(names) & (F.col(strength) >= least))
    got = rows.groupBy(entity).agg(F.countDistinct(F.lower(capability)).alias("n"), F.sum(strength).alias("strength_sum"))
    got = got.filter(F.col("n") == len(names)).filter(F.lit(len(names) > 0)).drop("n")
    return got.orderBy(F.desc("strength_sum"), entity).limit(most) if most else got


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by order. A map-side maximum, not a window, so a hot key is no single task's."""
    rest = [c for c in rows.columns if c not in key]
    made = F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *[F.col(c) for c in rest])
    return rows.groupBy(*key).agg(F.max(made).alias("_m")).select(*key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with all rows of each key in rows replaced by those; rows of other keys stay."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def live(entries: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Entries that never expire, or later than now."""
    return entries.filter(F.col(expires).isNull() | (F.col(expires) > now))


def cleared(entries: DataFrame, namespace: str, column: str = "namespace") -> DataFrame:
    """entries without those of a namespace."""
    return entries.filter(~F.col(column).eqNullSafe(F.lit(namespace)))


def deleted(entries: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """entries without those of the keys."""
    return entries.join(keys.select(key), key, "left_anti")


def stored(entries: DataFrame, rows: DataFrame, now: Column, ttl_seconds: Column, key: str = "key") -> DataFrame:
    """entries with rows (key, value, namespace) put in place of those of their keys; a null time to live never expires. Of several rows of a key the greatest value stays."""
    fresh = rows.withColumns({"stored_at": now, "expires_at": F.when(ttl_seconds.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + ttl_seconds).cast(entries.schema["expires_at"].dataType))})
    return upsert(entries, latest(fresh, [key], [F.col("value")]).select(*entries.columns), [key])


def evict(entries: DataFrame, most: int, key: str, stored: str = "stored_at", expires: str = "expires_at") -> DataFrame:
    """At most that many entries: the oldest go first, those that never expire last."""
    return entries.orderBy(F.col(expires).isNull().desc(), F.col(stored).desc(), F.col(key).desc()).limit(most)


def window_counts(log: DataFrame, kind: str, at: str, seconds: int, capacity: int) -> DataFrame:
    """log with in_window (requests of the kind in the seconds before and at each) and allowed.

    Time is cut into pieces as long as the window; a request counts in its own piece and, for
    others, in the next. So one busy kind is spread over as many tasks as there are pieces.
    """
    size = seconds * 1_000_000
    rows = log.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    rows = rows.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("_piece", F.floor(F.col("_t") / size) + F.when(F.col("_own"), 0).otherwise(1))
    span = Window.partitionBy(kind, "_piece").orderBy("_t").rangeBetween(-size, 0)
    got = rows.withColumn("in_window", F.count("*").over(span)).filter("_own").drop("_t", "_own", "_piece")
    return got.withColumn("allowed", F.col("in_window") <= capacity)


def fingerprints(assessed: DataFrame, entity: str, commit: str, capabilities: str, strength: Column) -> DataFrame:
    """(entity, commit, capability, strength) of assessed rows that name a commit and have capabilities; zeros stay."""
    rows = assessed.filter(F.col(commit).isNotNull() & (F.size(capabilities) > 0))
    return rows.select(entity, commit, F.explode(capabilities).alias("capability"), strength.alias("strength"))
