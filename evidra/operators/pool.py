"""Pools of candidates: shares for each query, round-robin choice, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share_pool(hits: DataFrame, query_ord: str, rank: str, entity: str, size: int, queries: int, least_share: int = 3) -> DataFrame:
    """(entity, first_query, n_queries, admitted_by, place): a pool of size entities from ranked hits of several queries.

    A hit counts for the first query that found it. A query admits its share, ceil(size / queries)
    and three at least, in order of rank; what is over fills the pool up, in order of query and
    rank. This is a closed form of a fold over queries: an entity over its share in the first query
    that found it waits for the filling, whichever later query finds it too.
    """
    share = max(least_share, -(-size // queries))
    first = hits.groupBy(entity).agg(F.min(F.struct(query_ord, rank)).alias("f"), F.countDistinct(query_ord).alias("n_queries"))
    own = Window.partitionBy("first_query").orderBy("first_rank", entity)
    rows = first.select(entity, F.col(f"f.{query_ord}").alias("first_query"), F.col(f"f.{rank}").alias("first_rank"), "n_queries")
    rows = rows.withColumn("n", F.row_number().over(own)).withColumn("over", F.col("n") > share)
    rows = rows.filter(F.col("n") <= size)  # of each query no more can be in the pool
    order = [F.col("over"), F.col("first_query"), F.col("n")]
    top = rows.orderBy(*order).limit(size)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    return top.select(entity, "first_query", "n_queries", F.when(F.col("over"), "filling").otherwise("share").alias("admitted_by"), place.alias("place"))


def round_robin(candidates: DataFrame, shape: str, shape_ord: Column, precision: Column, key: str, keep: int, rounds: int = 6, text: str | None = None) -> DataFrame:
    """The first keep candidates, one of each shape in turn, best first within a shape; with text what comes again without case is passed over in its turn."""
    turn = F.row_number().over(Window.partitionBy(shape).orderBy(precision.desc(), key))
    rows = candidates.withColumn("turn", turn).filter(F.col("turn") <= (rounds if text else min(rounds, keep))).withColumn("_o", shape_ord)
    if text:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower(F.trim(text))).orderBy("turn", "_o", key))).filter("_n = 1").drop("_n")
    top = rows.orderBy("turn", "_o", key).limit(keep)
    return top.withColumn("place", F.row_number().over(Window.orderBy("turn", "_o", key)).cast("long")).drop("_o")


def budget_shares(tasks: DataFrame, weight: str, total: int) -> DataFrame:
    """tasks with weight_sum and queries: max(1, total by weight, half up)."""
    whole = tasks.agg(F.sum(weight).alias("weight_sum"))
    got = tasks.join(F.broadcast(whole))  # one row
    queries = F.floor((2 * F.col(weight) * total + F.col("weight_sum")) / (2 * F.col("weight_sum")))
    return got.withColumn("queries", F.greatest(F.lit(1), queries).cast("long"))


def admit_prefix(rows: DataFrame, group: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows of each group in order until the first whose running cost exceeds the budget."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(upto)).filter(F.col("spent") <= budget)


def admit_greedy(costs: Column, budget: int, most: int) -> Column:
    """array<boolean>: which of the costs, in order, are admitted; one that doesn't fit is passed over."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).alias("n"), F.expr("cast(array() as array<boolean>)").alias("out"))

    def step(s: Column, c: Column) -> Column:
        ok = (c <= s["left"]) & (s["n"] < most)
        return F.struct(F.when(ok, s["left"] - c).otherwise(s["left"]).alias("left"), F.when(ok, s["n"] + 1).otherwise(s["n"]).alias("n"), F.concat(s["out"], F.array(ok)).alias("out"))

    return F.aggregate(F.transform(costs, lambda c: c.cast("long")), start, step)["out"]


def keep_lines(text: Column, budget: int, tokens) -> Column:
    """struct(kept, used): whole lines from the start while they fit the budget; tokens maps a line to its count."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"), F.lit(False).alias("full"))

    def step(s: Column, line: Column) -> Column:
        after = s["used"] + tokens(line)
        fits = ~s["full"] & (after <= budget)
        return F.struct(F.when(fits, after).otherwise(s["used"]).alias("used"), F.when(fits, s["kept"] + 1).otherwise(s["kept"]).alias("kept"), (~fits).alias("full"))

    return F.aggregate(lines, start, step)


def truncated(text: Column, budget: int, kind: str = "prose") -> Column:
    """text if it fits the budget of tokens; else its first whole lines that do and a mark; a first line that doesn't is cut by characters."""
    from evidra.functions.text import estimate_tokens

    mark = F.lit("\n… [truncated]")
    kept = keep_lines(text, budget, lambda line: estimate_tokens(F.concat(line, F.lit("\n")), kind))["kept"].cast("int")
    cut = F.when(kept > 0, F.array_join(F.slice(F.split(text, "\n"), F.lit(1), kept), "\n")).otherwise(F.left(text, F.lit(max(1, budget * (3 if kind == "code" else 4)))))
    return F.when(estimate_tokens(text, kind) <= budget, text).otherwise(F.concat(cut, mark))
