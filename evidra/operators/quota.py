"""Request budgets over a log of requests: slices, limits, what the server says, waits, kinds of failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Requests a window and the window's seconds by class; requests of each class that a call may spend, by its kind.
CAPACITY = {"core": (5000, 3600), "search": (30, 60), "code-search": (10, 60)}
SLICES = {"discovery": {"search": 6, "core": 100, "code-search": 2}, "analysis": {"search": 1, "core": 60, "code-search": 3}, "light": {"search": 2, "core": 12, "code-search": 0}}


def slices(max_queries: int = 6, max_deep: int = 5) -> dict[str, dict[str, int]]:
    """Requests of each class that a call of each kind may spend."""
    return SLICES | {"discovery": {"search": max_queries, "core": 40 + 12 * max_deep, "code-search": 2}}


def afforded(log: DataFrame, call: str, kind: str, order: str, limits: dict[str, int]) -> DataFrame:
    """log with spent (requests of the class that the call was given before) and afforded: the first ones of each class, as many as its slice has."""
    before = F.row_number().over(Window.partitionBy(call, kind).orderBy(order)) - 1
    limit = F.coalesce(*[F.when(F.col(kind) == k, n) for k, n in limits.items()], F.lit(0))
    return log.withColumn("_b", before).withColumn("spent", F.least("_b", limit).cast("long")).withColumn("afforded", F.col("_b") < limit).drop("_b")


def remaining(log: DataFrame, kind: str, at: str, told: str, capacity: dict[str, int]) -> DataFrame:
    """(kind, remaining, source): what the server told last, less the requests since; where it told nothing, the capacity less all requests."""
    last = log.groupBy(kind).agg(F.max(F.when(F.col(told).isNotNull(), F.struct(F.col(at).alias("at"), F.col(told).alias("left")))).alias("server"), F.count("*").alias("n"))
    since = log.join(last, kind).filter("server is not null").filter(F.col(at) > F.col("server.at")).groupBy(kind).agg(F.count("*").alias("since"))
    whole = F.coalesce(*[F.when(F.col(kind) == k, n) for k, n in capacity.items()], F.lit(0))
    local = F.greatest(F.lit(0), whole - F.col("n"))
    server = F.greatest(F.lit(0), F.col("server.left") - F.coalesce("since", F.lit(0)))
    rows = last.join(since, kind, "left")
    return rows.select(kind, F.when(F.col("server").isNotNull(), server).otherwise(local).cast("long").alias("remaining"), F.when(F.col("server").isNotNull(), "server").otherwise("local").alias("source"))


def retry_wait(attempt: Column, retry_after: Column, jitter: Column, most: int = 3) -> Column:
    """Milliseconds before the next attempt (0 is the first): the server's wait and 250, a minute at most; else doubling from 500 to 8000 and jitter; null past the last."""
    backoff = F.least(F.lit(8000), 500 * F.pow(F.lit(2), attempt)).cast("long") + jitter
    wait = F.when(retry_after.isNotNull(), F.least(retry_after + 250, F.lit(60_000))).otherwise(backoff)
    return F.when(attempt < most, wait).cast("long")


def failure(status: Column, left: Column, retry_after: Column) -> Column:
    """struct(kind, retryable) of a response; null for one that isn't a failure. A 403 is a limit if nothing is left or a wait is named."""
    kind = lambda name, again: F.struct(F.lit(name).alias("kind"), F.lit(again).alias("retryable"))
    limited = (status == 429) | ((status == 403) & ((F.coalesce(left, F.lit(-1)) == 0) | (F.coalesce(retry_after, F.lit(0)) > 0)))
    return (
        F.when(status < 400, F.lit(None)).when(limited, kind("rate-limit", True)).when(status == 401, kind("auth", False)).when(status == 403, kind("forbidden", False))
        .when(status == 404, kind("not-found", False)).when(status == 422, kind("unsupported", False)).when(status >= 500, kind("network", True)).otherwise(kind("internal", False))
    )
