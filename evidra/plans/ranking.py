"""Queries about ranking by evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.text import half_up
from evidra.operators import evidence as ev
from evidra.operators import knowledge, pool
from evidra.sources.tables import table

# The clock is a parameter.
AS_OF = "2001-12-01"
WEIGHTS = {"popularity": 3, "quality": 15, "discount": 12, "balance": 9, "freshness": 7}
AXES = list(WEIGHTS)


def supplier_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, axis, value, confidence): five signals of a supplier; a balance below zero isn't a measurement."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"), F.max("l_shipdate").alias("last"),
    )
    wide = table(spark, sf_dir, "supplier").join(items, F.col("s_suppkey") == F.col("k"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = lambda c: F.when(F.col("n") > 0, c)
    days = F.datediff(F.lit(AS_OF).cast("date"), F.col("last").cast("date"))
    wide = wide.select(
        "s_suppkey",
        ev.popularity(F.col("n")).alias("popularity"), F.lit(90).alias("popularity_confidence"),
        some(F.floor((200 * (F.col("n") - F.col("returned")) + F.col("n")) / (2 * F.col("n")))).alias("quality"), F.lit(80).alias("quality_confidence"),
        some(F.floor((20 * F.col("disc") + F.col("n")) / (2 * F.col("n")))).alias("discount"), F.lit(70).alias("discount_confidence"),
        F.when(F.col("s_acctbal") >= 0, F.least(F.lit(100), F.floor(F.col("s_acctbal") / 100))).alias("balance"), F.lit(60).alias("balance_confidence"),
        some(ev.recency_steps(days)).alias("freshness"), F.lit(85).alias("freshness_confidence"),
    )
    return ev.melt(wide, "s_suppkey", AXES)


_EVIDENCE_SQL = f"""
items as (select l_suppkey as k, count(*) as n, count(*) filter (l_returnflag = 'R') as returned,
                 sum(cast(round(l_discount * 100) as bigint)) as disc, max(l_shipdate) as last from lineitem group by 1),
wide as (select s_suppkey, coalesce(n, 0) as n, returned, disc, s_acctbal, date_diff('day', cast(last as date), date '{AS_OF}') as days
         from supplier left join items on s_suppkey = k),
evidence as (
  select s_suppkey, 'popularity' as axis, cast(least(100, floor(log10(n + 1) / 4.5e0 * 100 + 0.5e0)) as bigint) as value, 90 as confidence from wide
  union all select s_suppkey, 'quality', case when n > 0 then (200 * (n - returned) + n) // (2 * n) end, 80 from wide
  union all select s_suppkey, 'discount', case when n > 0 then cast((20 * disc + n) // (2 * n) as bigint) end, 70 from wide
  union all select s_suppkey, 'balance', case when s_acctbal >= 0 then cast(least(100, floor(s_acctbal / 100)) as bigint) end, 60 from wide
  union all select s_suppkey, 'freshness', case when n > 0 then case when days <= 30 then 100 when days <= 90 then 85 when days <= 180 then 70 when days <= 365 then 50 when days <= 730 then 25 else 8 end end, 85 from wide
),
weighted as (select e.*, w, value is null as imputed, coalesce(value, 50) as v, case when value is null then 10 else confidence end as c
             from evidence e join (values {ev.axis_table(WEIGHTS)}) t(axis, w) on e.axis = t.axis),
ranked as (select s_suppkey, cast((2 * sum(v * w) + sum(w)) // (2 * sum(w)) as bigint) as total,
                  cast((2 * sum(c * w) + sum(w)) // (2 * sum(w)) as bigint) as confidence,
                  coalesce(string_agg(axis, ',' order by axis) filter (imputed), '') as unmeasured from weighted group by 1)
"""


def supplier_rank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS).select("s_suppkey", "total")


def supplier_rank_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS).select("s_suppkey", "confidence", "unmeasured")


def rank_disabled_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS, disabled=("discount",)).select("s_suppkey", "total")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS)
    return got.withColumn("tier", F.when(F.col("unmeasured") == "", 0).otherwise(1)).withColumn("shortlisted", F.col("tier") == 0)


def tiered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc("tier"), F.desc("total"), F.desc("confidence"), F.asc("s_suppkey")]
    return ev.tiered(_scored(spark, sf_dir), order, 20, least=35).select("rank", "s_suppkey", "tier", "total", "confidence")


def explain_top5_bottom4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.reasons(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS)


def axis_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.axis_spread(supplier_evidence(spark, sf_dir), "s_suppkey")


def customer_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency of the last order, refined by recent orders, under the ceiling of the first order's age; both clocks are AS_OF."""
    day = F.lit(AS_OF).cast("date")
    ago = lambda c: F.datediff(day, F.col(c).cast("date"))
    got = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first"), F.count_if(ago("o_orderdate") <= 365).alias("recent"))
    step = ev.recency_steps(ago("last"))
    refined = F.when(ago("last") <= 180, F.floor((step * 80 + F.least(F.lit(100), F.floor(F.col("recent") * 100 / 30)) * 20 + 50) / 100)).otherwise(step)
    return got.select("o_custkey", F.least(refined, ev.age_ceiling(ago("first"))).cast("long").alias("maintenance"), F.col("recent"))


def gate_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's total under the completeness factor, then under the factor of its gate."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns({"n": F.coalesce("n", F.lit(0)), "done": F.coalesce("done", F.lit(0))})
    base = F.least(F.lit(100), F.floor(F.greatest(F.lit(0.0), F.col("c_acctbal")) / 100)).cast("long")
    verdict = F.when(F.col("c_acctbal") < 0, "DO_NOT_USE").when(F.col("n") == 0, "REFERENCE_ONLY").when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "ADAPT").otherwise("DIRECT_REUSE")
    none = (F.col("done") == 0) & (F.col("n") >= 3)
    before = ev.gated(base, [(none & (F.col("n") >= 5), 45), (none & (F.col("n") < 5), 55)])
    rows = rows.select("c_custkey", verdict.alias("verdict"), before.alias("before"))
    total = ev.gated(F.col("before"), [(F.col("verdict") == "ADAPT", 95), (F.col("verdict") == "REFERENCE_ONLY", 75), (F.col("verdict") == "DO_NOT_USE", 40)])
    return rows.withColumn("total", total)


def capability_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return knowledge.all_of(facts, "user_id", "event_type", "cents", ["click", "purchase"], 5000)


def sliding_request_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return knowledge.window_counts(log, "event_type", "ts", 3600, 2).select("event_id", F.col("in_window"), "allowed")


def ttl_and_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries: views never expire, others after a day; what is live at the clock, at most 2000."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("stored_at"), F.when(F.col("event_type") != "view", F.col("ts") + F.expr("interval 1 day")).alias("expires_at"))
    got = knowledge.live(rows, F.lit("2024-01-28 00:00:00").cast("timestamp_ntz" if dict(rows.dtypes)["stored_at"] == "timestamp_ntz" else "timestamp"))
    return knowledge.evict(got, 2000, "event_id").select("event_id", F.col("expires_at").isNull().alias("immutable"))


def fingerprint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of (user, hour of day) replaced by those of the last ten days."""
    rows = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("commit"), F.col("event_type").alias("capability"), F.round(F.col("value") * 100).cast("long").alias("cents"), (F.dayofmonth("ts") > 20).alias("new"))
    facts = lambda new: rows.filter(F.col("new") == new).groupBy("user_id", "commit", "capability").agg(F.max("cents").alias("strength"))
    return knowledge.upsert(facts(False), facts(True), ["user_id", "commit"])


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("namespace")).agg(F.count("*").alias("entries"))


def latest_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


def commit_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's last hundred orders: those of the last year, the last date, and distinct priorities."""
    from pyspark.sql.window import Window

    last = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(last)).filter("n <= 100")
    recent = F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")) <= 365
    return rows.groupBy("o_custkey").agg(F.count_if(recent).alias("recent"), F.max("o_orderdate").cast("date").cast("string").alias("last_day"), F.countDistinct("o_orderpriority").alias("kinds"))


def share_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    types = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2)
    hits = table(spark, sf_dir, "events").select("user_id", types.alias("q"), F.round(F.col("value") * 100).cast("long").alias("v")).filter("q is not null").groupBy("user_id", "q").agg(F.max("v").alias("v"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("v"), "user_id"))).filter("r <= 60")
    return pool.share_pool(ranked, "q", "r", "user_id", 40, 3).withColumnRenamed("first_query", "query")


def diverse_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return pool.round_robin(rows, "event_type", F.col("event_type"), F.col("value"), "event_id", 12).select("place", "event_id", "event_type")


def budget_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("weight"))
    return pool.budget_shares(tasks, "weight", 120).select("p_brand", F.col("weight"), "queries")


def quality_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's composite in 0..100 of three measured shares, to one digit."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("kept"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    score = 30.0 * F.col("kept") / F.col("n") + 25.0 * F.least(F.lit(1.0), F.col("n") / 40.0) + 45.0 * F.col("done") / F.col("n")
    return lines.select("l_partkey", half_up(score, 1).alias("quality"))


def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first half as a cache, purchases as later writes, signups cleared, clicks of the first users deleted."""
    rows = table(spark, sf_dir, "events")
    kind = rows.schema["ts"].dataType
    old = rows.groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("namespace")).agg(F.max("event_id").alias("value"), F.max("ts").alias("stored_at")).withColumn("expires_at", F.col("stored_at") + F.expr("interval 1 day"))
    old = old.withColumn("key", F.concat_ws(":", "namespace", "key")).select("key", "namespace", "value", "stored_at", "expires_at")
    new = old.filter("namespace = 'purchase'").select("key", "namespace", (F.col("value") + 1).alias("value"))
    got = knowledge.stored(old, new, F.lit("2024-02-01 00:00:00").cast(kind), F.lit(3600))
    gone = rows.filter("user_id < 5").select(F.concat_ws(":", F.lit("click"), "user_id").alias("key"))
    return knowledge.deleted(knowledge.cleared(got, "signup"), gone).select("key", "value", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


def indexed_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS)
    return got.select("s_suppkey", ev.indexed_confidence(F.col("confidence"), F.col("s_suppkey") % 2 == 0).alias("confidence"))


def diverse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as queries of the shape of their type, sizes as precision; a name that comes again is passed over."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_name")
    return pool.round_robin(rows, "p_type", F.col("p_type"), F.col("p_size"), "p_partkey", 12, text="p_name").select("place", "p_partkey")


_TIER = "case when unmeasured = '' then 0 else 1 end"
QUERIES = {f.__name__: f for f in (
    supplier_rank_weighted, supplier_rank_confidence, rank_disabled_axis, tiered_topk, explain_top5_bottom4, axis_spread, customer_maintenance, gate_multipliers,
    capability_all_of, sliding_request_count, ttl_and_eviction, fingerprint_upsert, cache_stats, latest_commit, commit_activity, diverse_round_robin, budget_share, quality_composite, cache_writes, indexed_confidence, diverse_queries,
)} | {"query_share_pool": share_pool}
SQL = {
    "cache_writes": """with o as (select event_type || ':' || user_id as key, event_type as namespace, max(event_id) as value, max(ts) + interval 1 day as expires_at from events group by user_id, event_type)
        select key, case namespace when 'purchase' then value + 1 else value end as value, case namespace when 'purchase' then '2024-02-01' else strftime(expires_at, '%Y-%m-%d') end as expires from o
        where namespace <> 'signup' and not (namespace = 'click' and cast(split_part(key, ':', 2) as bigint) < 5)""",
    "indexed_confidence": f"with {_EVIDENCE_SQL} select s_suppkey, cast(least(100, confidence + case when s_suppkey % 2 = 0 then 10 else 0 end) as bigint) as confidence from ranked",
    "diverse_queries": """with t as (select *, row_number() over (partition by p_type order by p_size desc, p_partkey) as turn from part qualify turn <= 6), d as (select * from t qualify row_number() over (partition by lower(trim(p_name)) order by turn, p_type, p_partkey) = 1)
        select row_number() over (order by turn, p_type, p_partkey) as place, p_partkey from d order by turn, p_type, p_partkey limit 12""",
    "supplier_rank_weighted": f"with {_EVIDENCE_SQL} select s_suppkey, total from ranked",
    "supplier_rank_confidence": f"with {_EVIDENCE_SQL} select s_suppkey, confidence, unmeasured from ranked",
    "rank_disabled_axis": f"with {_EVIDENCE_SQL} select s_suppkey, cast((2 * sum(v * w) + sum(w)) // (2 * sum(w)) as bigint) as total from weighted where axis <> 'discount' group by 1",
    "tiered_topk": f"with {_EVIDENCE_SQL} select row_number() over (order by {_TIER}, total desc, confidence desc, s_suppkey) as rank, s_suppkey, {_TIER} as tier, total, confidence from ranked where total >= 35 or unmeasured = '' order by 1 limit 20",
    "explain_top5_bottom4": f"""with {_EVIDENCE_SQL}, sides as (
        select s_suppkey, 'for' as side, axis, value, row_number() over (partition by s_suppkey order by value * w desc, axis) as rank from weighted where value >= 75
        union all select s_suppkey, 'against', axis, value, row_number() over (partition by s_suppkey order by (100 - value) * w desc, axis) from weighted where value <= 40)
        select s_suppkey, side, rank, axis, value from sides where rank <= case side when 'for' then 5 else 4 end""",
    "axis_spread": f"""with {_EVIDENCE_SQL} select axis, min(value) as least, max(value) as most, max(value) - min(value) as spread,
        arg_min(s_suppkey, (-value, s_suppkey)) as winner, max(value) - min(value) < 15 as tied from weighted where value is not null group by axis""",
    "customer_maintenance": f"""with d as (select o_custkey, date_diff('day', cast(o_orderdate as date), date '{AS_OF}') as ago from orders),
        g as (select o_custkey, min(ago) as last, max(ago) as first, count(*) filter (ago <= 365) as recent from d group by 1),
        s as (select *, case when last <= 30 then 100 when last <= 90 then 85 when last <= 180 then 70 when last <= 365 then 50 when last <= 730 then 25 else 8 end as step,
              case when first <= 30 then 45 when first <= 90 then 60 when first <= 365 then 80 else 100 end as ceiling from g)
        select o_custkey, cast(least(case when last <= 180 then (step * 80 + least(100, recent * 100 // 30) * 20 + 50) // 100 else step end, ceiling) as bigint) as maintenance, recent from s""",
    "gate_multipliers": """with o as (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as done from orders group by 1),
        c as (select c_custkey, cast(least(100, floor(greatest(0.0, c_acctbal) / 100)) as bigint) as base, coalesce(n, 0) as n, coalesce(done, 0) as done,
              case when c_acctbal < 0 then 'DO_NOT_USE' when coalesce(n, 0) = 0 then 'REFERENCE_ONLY' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'ADAPT' else 'DIRECT_REUSE' end as verdict
              from customer left join o on c_custkey = o_custkey),
        b as (select *, case when done = 0 and n >= 5 then (2 * base * 45 + 100) // 200 when done = 0 and n >= 3 then (2 * base * 55 + 100) // 200 else base end as "before" from c)
        select c_custkey, verdict, "before", case verdict when 'ADAPT' then (2 * "before" * 95 + 100) // 200 when 'REFERENCE_ONLY' then (2 * "before" * 75 + 100) // 200
               when 'DO_NOT_USE' then (2 * "before" * 40 + 100) // 200 else "before" end as total from b""",
    "capability_all_of": """select user_id, cast(sum(cast(round(value * 100) as bigint)) as bigint) as strength_sum from events
        where event_type in ('click', 'purchase') and cast(round(value * 100) as bigint) >= 5000 group by 1 having count(distinct event_type) = 2""",
    "sliding_request_count": """with w as (select event_id, count(*) over (partition by event_type order by ts range between interval 3600 seconds preceding and current row) as in_window from events)
        select event_id, in_window, in_window <= 2 as allowed from w""",
    "ttl_and_eviction": """with e as (select event_id, ts, case when event_type <> 'view' then ts + interval 1 day end as expires from events)
        select event_id, expires is null as immutable from e where expires is null or expires > timestamp '2024-01-28 00:00:00'
        order by (expires is null) desc, ts desc, event_id desc limit 2000""",
    "fingerprint_upsert": """with f as (select user_id, cast(hour(ts) as integer) as commit, event_type as capability, day(ts) > 20 as new, max(cast(round(value * 100) as bigint)) as strength from events group by all)
        select user_id, commit, capability, strength from f where new
        union all select user_id, commit, capability, strength from f o where not new and not exists (select 1 from f n where n.new and n.user_id = o.user_id and n.commit = o.commit)""",
    "cache_stats": "select event_type as namespace, count(*) as entries from events group by 1",
    "latest_commit": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1",
    "commit_activity": f"""with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)
        select o_custkey, count(*) filter (date_diff('day', cast(o_orderdate as date), date '{AS_OF}') <= 365) as recent, cast(cast(max(o_orderdate) as date) as varchar) as last_day,
               count(distinct o_orderpriority) as kinds from r where n <= 100 group by 1""",
    "diverse_round_robin": """with t as (select event_id, event_type, row_number() over (partition by event_type order by value desc, event_id) as turn from events)
        select row_number() over (order by turn, event_type, event_id) as place, event_id, event_type from t where turn <= 6 order by turn, event_type, event_id limit 12""",
    "budget_share": """with t as (select p_brand, sum(p_size) as weight from part group by 1), s as (select sum(weight) as total from t)
        select p_brand, cast(weight as bigint) as weight, cast(greatest(1, (2 * weight * 120 + total) // (2 * total)) as bigint) as queries from t, s""",
    "quality_composite": """select l_partkey, floor((30e0 * count(*) filter (l_returnflag = 'N') / count(*) + 25e0 * least(1e0, count(*) / 40e0) + 45e0 * count(*) filter (l_linestatus = 'F') / count(*)) * 10e0 + 0.5e0) / 10e0 as quality
        from lineitem group by 1""",
    "query_share_pool": """with h as (select user_id, case event_type when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 end as q, max(cast(round(value * 100) as bigint)) as v
        from events where event_type in ('click', 'purchase', 'signup') group by all),
        r as (select *, row_number() over (partition by q order by v desc, user_id) as r from h qualify r <= 60),
        f as (select user_id, min((q, r)) as f, count(distinct q) as n_queries from r group by 1),
        o as (select user_id, f[1] as query, n_queries, row_number() over (partition by f[1] order by f[2], user_id) as n from f),
        m as (select *, n > 14 as over from o where n <= 40)
        select user_id, query, n_queries, case when over then 'filling' else 'share' end as admitted_by, row_number() over (order by over, query, n) as place from m order by over, query, n limit 40""",
}
