"""Request limits over a log that is still being written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_totals(log: DataFrame, kind: str, at: str, seconds: int, slide: int, late: str = "1 minute") -> DataFrame:
    """(kind, start, stop, requests): requests of each kind in windows of so many seconds, a window every slide seconds.

    On a stream a window is told once the watermark has passed its end, and requests that come
    later than late are left out; state is a count for each kind and open window. Requests without a
    time or a kind count nowhere. On a table all windows are told.
    """
    rows = log.filter(F.col(at).isNotNull() & F.col(kind).isNotNull())
    if log.isStreaming:
        rows = rows.withWatermark(at, late)
    counted = rows.groupBy(F.window(at, f"{seconds} seconds", f"{slide} seconds").alias("w"), kind).agg(F.count("*").alias("requests"))
    return counted.select(kind, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "requests")


def overruns(totals: DataFrame, kind: str, capacity: dict[str, int]) -> DataFrame:
    """Windows with more requests than their kind may have; a kind without a capacity has none to overrun."""
    limit: Column = F.coalesce(*[F.when(F.col(kind) == k, n) for k, n in capacity.items()], F.lit(None).cast("int"))
    return totals.filter(F.col("requests") > limit).withColumn("over", F.col("requests") - limit)
