"""Bounded expansion of graphs: level by level, and a connected set within a budget for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.operators.lineage import cut


def expand(seeds: DataFrame, edges: DataFrame, depth: int, fan: int | None = None) -> DataFrame:
    """(seed, node, level): nodes within depth steps of each seed, at their least level.

    edges is (src, dst, ord); with fan a node passes on its first fan edges only. Levels are joins
    by key, and what was reached before is left out by an anti-join.
    """
    step = edges
    if fan:
        step = edges.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))).filter(F.col("_n") <= fan)
    step = step.select("src", "dst").distinct()
    out = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("level"))
    wave = out
    for k in range(1, depth + 1):
        wave = wave.join(step, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        wave = wave.join(out.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("level", F.lit(k).cast("long"))
        out = out.unionByName(wave)
    return out


def _admitted(ranked: DataFrame, state: DataFrame, core: int, stop: bool) -> tuple[DataFrame, DataFrame]:
    """(ranked with ok, new state): each repo's symbols in order of rank, as long as its core has room and what is left of its budget holds their cost; with stop none after the first that doesn't fit."""
    start = F.struct("left", "n", F.lit(True).alias("open"), F.expr("cast(array() as array<boolean>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        ok = s["open"] & (s["n"] < core) & (x["cost"] <= s["left"])
        return F.struct(F.when(ok, s["left"] - x["cost"]).otherwise(s["left"]).alias("left"), F.when(ok, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["open"] & (ok | F.lit(not stop))).alias("open"), F.concat(s["out"], F.array(ok)).alias("out"))

    lists = ranked.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cost"))).alias("all")).join(state, "repo")
    told = cut(lists.withColumn("end", F.aggregate("all", start, step)))
    ok = told.select("repo", F.explode(F.zip_with("all", "end.out", lambda x, k: F.struct(x["id"].alias("id"), k.alias("ok")))).alias("x")).select("repo", "x.id", "x.ok")
    changed = told.select("repo", F.col("end.left").alias("l2"), F.col("end.n").alias("n2"))
    after = state.join(changed, "repo", "left").select("repo", F.coalesce("l2", "left").alias("left"), F.coalesce("n2", "n").alias("n"))
    return cut(ranked.join(ok, ["repo", "id"])), cut(after)


def minimal_set(symbols: DataFrame, edges: DataFrame, budget: int = 1200, core: int = 8, depth: int = 2, seed_score: float = 0.45, seeds: int = 4, floor: float = 0.25, cohesion: float = 0.08) -> DataFrame:
    """(repo, id, role, relevance): which symbols of each repo to keep together.

    symbols is (repo, id, score, cost, noise, and dir if known), edges (repo, src, dst). The best
    symbols that aren't noise seed the core, up to the first that the budget doesn't hold. Neighbours of
    what was admitted come level by level, best first, a little better in a seed's folder; one below the
    floor or for which the core or the budget has no room becomes supporting. A core of fewer than
    three is topped up with the best of the rest. A repo without a seed keeps its five best symbols above 0.15.
    Every symbol gets a role: seed, core, supporting or excluded; equals go by id.

    Each level is a join by key; a repo's candidates of one level (neighbours of a core) are ranked
    in one array.
    """
    folder = F.col("dir") if "dir" in symbols.columns else F.lit(None).cast("string")
    rows = cut(symbols.select("repo", "id", F.col("score").cast("double").alias("score"), F.col("cost").cast("long").alias("cost"), F.coalesce("noise", F.lit(False)).alias("noise"), folder.alias("dir")))
    step = edges.select("repo", "src", "dst").distinct()
    order = Window.partitionBy("repo").orderBy(F.desc("score"), "id")
    useful = rows.filter("not noise")
    first = useful.filter(F.col("score") >= seed_score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= seeds)
    state = cut(first.groupBy("repo").agg(F.lit(budget).cast("long").alias("left"), F.lit(0).cast("long").alias("n")))
    folders = cut(first.filter("dir is not null").select("repo", "dir").distinct().withColumn("near", F.lit(1)))
    told, state = _admitted(first.select("repo", "id", "cost", "score", "rank"), state, core, True)
    chosen = told.filter("ok").select("repo", "id", F.lit("seed").alias("role"), "score")
    wave, seen = chosen, chosen.select("repo", "id")
    for _ in range(depth):
        open_ = wave.join(state.filter(F.col("n") < core).select("repo"), "repo", "left_semi")
        near = open_.select("repo", F.col("id").alias("src")).join(step, ["repo", "src"]).select("repo", F.col("dst").alias("id")).distinct()
        near = cut(near.join(seen, ["repo", "id"], "left_anti"))
        seen = seen.union(near)
        level = near.join(useful, ["repo", "id"]).join(folders, ["repo", "dir"], "left")
        level = level.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("score") + F.when(F.col("near") == 1, cohesion).otherwise(0.0), 2)))).select("repo", "id", "cost", "score")
        ranked = level.filter(F.col("score") >= floor).withColumn("rank", F.row_number().over(order))
        told, state = _admitted(ranked, state, core, False)
        wave = told.filter("ok").select("repo", "id", F.lit("core").alias("role"), "score")
        late = told.filter("not ok").select("repo", "id", F.lit("supporting").alias("role"), "score").union(level.filter(F.col("score") < floor).select("repo", "id", F.lit("supporting"), "score"))
        chosen = cut(chosen.union(wave).union(late))
    thin = state.filter(F.col("n") < min(3, core))
    rest = useful.join(thin.select("repo"), "repo", "left_semi").join(chosen.select("repo", "id"), ["repo", "id"], "left_anti").filter(F.col("score") >= floor).withColumn("rank", F.row_number().over(order))
    more, _ = _admitted(rest.select("repo", "id", "cost", "score", "rank"), thin, core, False)
    bare = useful.filter("score > 0.15").join(state.select("repo"), "repo", "left_anti").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(5, core))
    chosen = chosen.union(more.filter("ok").select("repo", "id", F.lit("core"), "score")).union(bare.select("repo", "id", F.lit("core"), "score"))
    got = rows.select("repo", "id", F.col("score").alias("own")).join(chosen, ["repo", "id"], "left")
    return got.select("repo", "id", F.coalesce("role", F.lit("excluded")).alias("role"), F.round(F.coalesce("score", "own"), 2).alias("relevance"))
