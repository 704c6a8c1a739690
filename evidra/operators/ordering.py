"""Orders of tasks in which what a task needs stands before it, by fixpoints of joins, whatever the depth and with cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.lineage import cut, numbered

#: Stands after every place in a list.
LAST = 2**31 - 1


def walks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, task, walk): how a depth-first walk of a plan first gets to each of its tasks.

    tasks (plan, task, priority), one row a task: the walk starts at the most urgent task, then at the next one
    that it hasn't seen. edges (plan, task, needs, at): what a task needs, in order of at; what isn't a task is left out.
    A walk is the task at which it started and the places in the lists of needs that it followed. A depth-first walk
    gets to a task by the first of all these in their order, so each is the least of its own
    start and one step after the walk of each task that needs it. Rounds go on, from the tasks
    whose walk became less, until none does: as many as the longest walk has steps.
    """
    first = F.struct((-F.coalesce(F.col("priority").cast("bigint"), F.lit(-(2**62)))).alias("late"), F.col("task").alias("start"), F.expr("cast(array() as array<int>)").alias("steps"))
    state = cut(tasks.select("plan", "task", first.alias("walk")))
    ahead = state
    steps = cut(edges.select(F.col("plan").alias("p"), F.col("task").alias("t"), "needs", F.col("at").cast("int").alias("at")))
    while True:
        after = F.struct("walk.late", "walk.start", F.concat("walk.steps", F.array("at")).alias("steps"))
        found = ahead.join(steps, (F.col("plan") == F.col("p")) & (F.col("task") == F.col("t"))).groupBy(F.col("plan").alias("q"), F.col("needs").alias("n"))
        found = found.agg(F.min(after).alias("other"))
        got = state.join(found, (F.col("plan") == F.col("q")) & (F.col("task") == F.col("n")), "left")
        got = cut(got.select("plan", "task", F.least("walk", F.coalesce("other", "walk")).alias("walk"), F.coalesce(F.col("other") < F.col("walk"), F.lit(False)).alias("less")))
        state, ahead = got.drop("less"), got.filter("less").drop("less")
        if ahead.isEmpty():
            return state


def _apart(rows: DataFrame, plan: Column, task: Column, priority: Column, needs: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks, edges) of rows with a list of needs: rows of the same task are one, with the highest priority and the needs of all."""
    named = rows.select(plan.alias("plan"), task.alias("task"), priority.alias("priority"), needs.alias("needs"))
    tasks = named.groupBy("plan", "task").agg(F.max("priority").alias("priority"))
    edges = named.select("plan", "task", F.posexplode("needs").alias("at", "needs")).groupBy("plan", "task", "needs").agg(F.min("at").alias("at"))
    return tasks, edges


def topological(rows: DataFrame, plan: str, task: str, priority: str, needs: str) -> DataFrame:
    """rows with place (long, from 1 in each plan): what a task needs stands before it, the most urgent first.

    The order is that in which a depth-first walk (see walks) leaves tasks: a task comes after all that it is the first
    to lead to. Cycles are broken where they close. Ties of priority are by task; a null priority comes last; needs (a list,
    null: none) that aren't tasks of the plan don't count; rows with the same task share a place. No
    plan is in one task: places are numbered over ranges.
    """
    tasks, edges = _apart(rows, F.col(plan), F.col(task), F.col(priority), F.col(needs))
    left = F.concat("walk.steps", F.array(F.lit(LAST))).alias("left")  # after what it leads to
    walked = cut(walks(tasks, edges).select("plan", "task", "walk.late", "walk.start", left))
    order = [F.col(c) for c in ("plan", "late", "start", "left")]
    placed = cut(numbered(walked, order, "n").select("plan", "task", "n"))
    begun = placed.groupBy("plan").agg(F.min("n").alias("first"))
    place = placed.join(begun, "plan").select(F.col("plan").alias("_plan"), F.col("task").alias("_task"), (F.col("n") - F.col("first") + 1).alias("place"))
    return rows.join(place, (F.col(plan) == F.col("_plan")) & (F.col(task) == F.col("_task"))).drop("_plan", "_task")


def without_cycles(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (task, needs) without those on which a depth-first walk by priority gets back to a task that it is still in."""
    plan = F.lit(0).alias("plan")
    seen = edges.select("task", "needs").distinct()
    urgent = tasks.select(F.col("task").alias("k"), F.coalesce("priority", F.lit(-(2**62))).alias("u"))
    listed = seen.join(urgent, F.col("needs") == F.col("k"), "left")
    # needs are followed as the tasks themselves are: the most urgent first
    lists = listed.groupBy("task").agg(F.array_sort(F.collect_list(F.struct((-F.col("u")).alias("late"), "needs"))).alias("l"))
    ordered = lists.select(plan, "task", F.posexplode(F.transform("l", lambda x: x["needs"])).alias("at", "needs"))
    walked = cut(walks(tasks.select(plan, "task", "priority"), ordered))
    of = lambda t: walked.select(F.col("task").alias(f"k_{t}"), F.col("walk").alias(f"w_{t}"))
    both = seen.join(of("task"), F.col("task") == F.col("k_task")).join(of("needs"), F.col("needs") == F.col("k_needs"))
    a, b = F.col("w_needs.steps"), F.col("w_task.steps")
    back = (F.col("w_needs.start") == F.col("w_task.start")) & (a == F.slice(b, F.lit(1), F.size(a)))
    return both.filter(~back).select("task", "needs")


def build_order(rows: DataFrame, edges: DataFrame, key: str, priority: str) -> DataFrame:
    """rows with level (the longest chain of needs before it) and place (by level, then priority, then key).

    edges are (key, needs). Levels rise, from the tasks whose level rose last, until none does, however long chains are. Where
    needs form a cycle, the edges that close it in a depth-first walk don't count (see without_cycles);
    nor do needs that aren't there. rows has one row a key.
    """
    tasks = rows.select(F.col(key).alias("task"), F.col(priority).cast("bigint").alias("priority"))
    steps = cut(without_cycles(tasks, edges.toDF("task", "needs")).withColumnsRenamed({"task": "t"}))
    levels = cut(tasks.select("task", F.lit(0).alias("level")))
    risen = levels
    while not risen.isEmpty():
        up = risen.join(steps, F.col("task") == F.col("needs")).groupBy(F.col("t").alias("k")).agg((F.max("level") + 1).alias("up"))
        got = levels.join(up, F.col("task") == F.col("k"), "left")
        got = cut(got.select("task", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), F.coalesce(F.col("up") > F.col("level"), F.lit(False)).alias("rose")))
        levels, risen = got.drop("rose"), got.filter("rose").drop("rose")
    got = rows.join(levels.withColumnRenamed("task", "_task"), F.col(key) == F.col("_task")).drop("_task")
    return numbered(got, [F.col("level").asc(), F.col(priority).desc(), F.col(key).asc()], "place")
