"""Queries about how entities relate: copies, shared parts, conflicts, graphs, constraints, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.operators import clusters, graph, ordering, synthesis
from evidra.plans import names
from evidra.plans.ranking import _EVIDENCE_SQL, WEIGHTS, supplier_evidence
from evidra.operators import evidence as ev
from evidra.sources.tables import table


def exact_copy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose descriptions are the same (more than 40 characters): the first of each group, its size and sources."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", clusters.description_key("text").alias("k")).filter("k is not null")
    got = rows.groupBy("k").agg(F.min("doc_id").alias("representative"), F.count("*").alias("members"), F.countDistinct("source").alias("sources"))
    return got.filter("members > 1").drop("k")


def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the same plain name and brand: the dearest represents them, the least key among equals."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", clusters.plain_key("p_name").alias("name"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents")).filter("name is not null")
    rows = rows.withColumn("g", F.concat_ws("|", "p_brand", "name"))
    return clusters.representatives(rows, "g", "p_partkey", "cents").filter("members > 1").select(F.col("g").alias("cluster"), "representative", "members")


def dice_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like names of parts within a type; distinct names are compared, whatever the number of parts."""
    got = clusters.dice_links(table(spark, sf_dir, "part"), "p_partkey", ["p_type"], "p_name", 0.6)
    return got.select("p_type", F.col("name").alias("name_a"), F.col("name2").alias("name_b"), tx.half_up(F.col("score"), 3).alias("score"))


def fork_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers folded into the richest of their nation, as forks into an original."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"))
    best = clusters.representatives(rows, "s_nationkey", "s_suppkey", "cents").select("s_nationkey", F.col("representative").alias("parent"))
    got = clusters.fork_links(rows.join(best, "s_nationkey"), "s_suppkey", "parent")
    return got.groupBy(F.col("a").alias("representative")).agg(F.count("*").alias("forks"), F.min("b").alias("first_fork"))


def overlapping_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.overlaps(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's quantities as versions: the tens are its major."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.floor(F.col("l_quantity") / 10).cast("string"), F.lit("."), (F.col("l_quantity") % 10).cast("int").cast("string")).alias("version"))
    return synthesis.version_conflicts(rows, "l_partkey", "version")


def naming_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.naming_conflicts(table(spark, sf_dir, "part"), "p_name", "p_brand")


def concurrency_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as ways to wait: more than one is a conflict."""
    rules = {"urgent": "^1-|^2-", "normal": "^3-", "none": "^4-|^5-"}
    return synthesis.models(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", rules)


def _part_families(part: DataFrame) -> DataFrame:
    keys = part.select("p_partkey", F.concat_ws("|", F.lit("n"), "p_brand", "p_name").alias("k")).union(part.select("p_partkey", F.concat_ws("|", F.lit("s"), "p_size", "p_type", "p_brand")))
    return synthesis.families(keys, "p_partkey", "k").groupBy("family").agg(F.count("*").alias("members"))


def family_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts joined by sharing a name and brand, or a size, type and brand; families by the least part."""
    return _part_families(table(spark, sf_dir, "part"))


def bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers within two steps of the first five, over the parts that they share with their first customers' orders."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    near = items.groupBy("l_partkey").agg(F.min("l_suppkey").alias("hub"))
    edges = items.join(near, "l_partkey").filter("l_suppkey <> hub").select(F.col("hub").alias("src"), F.col("l_suppkey").alias("dst")).distinct().withColumn("ord", F.col("dst"))
    seeds = table(spark, sf_dir, "supplier").filter("s_suppkey < 5").select(F.col("s_suppkey").alias("seed"))
    return graph.expand(seeds, edges, 2, fan=6)


def minimal_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols of the code base of their brand; no SQL expresses the budget's order, the tests hold it against plain Python."""
    part = table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_brand").alias("repo"), F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") / 50.0).alias("score"), (F.col("p_size") * 8 + 20).cast("long").alias("cost"), (F.col("p_type") == "PROMO").alias("noise"))
    edges = part.select(F.col("p_brand").alias("repo"), F.col("p_partkey").cast("string").alias("src"), (F.col("p_partkey") * 7 % 1999).cast("string").alias("dst"), F.lit(0).alias("kind_ord"))
    return graph.minimal_set(symbols, edges)


def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the first constraint that each breaks; an explicit list is left out first."""
    rows = table(spark, sf_dir, "supplier").filter(~F.col("s_suppkey").isin(1, 2, 3)).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    why = synthesis.violations([("negative balance", F.col("s_acctbal") < 0), ("excluded region", F.col("n_regionkey") == 4), ("small", F.col("s_acctbal") < 1000)])
    return rows.select("s_suppkey", why.alias("violation"))


def alternatives_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS)
    viable = constraint_filter(spark, sf_dir).filter("violation is null")
    return ranked.join(viable, "s_suppkey", "left_semi").orderBy(F.desc("total"), F.desc("confidence"), "s_suppkey").limit(4).select("s_suppkey", "total")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(F.col("l_returnflag") != "R").alias("kept"), F.count_if(F.col("l_tax") > 0).alias("taxed"),
        F.count_if(F.col("l_quantity") >= 25).alias("large"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_discount") > 0.05).alias("cut"))
    col = F.col
    tests = {"components": (col("done"), col("n")), "symbols": (col("kept"), col("n")), "dependencies": (col("suppliers"), col("n")), "requirements": (col("taxed"), col("n")), "edge-cases": (col("large"), F.when(col("n") > 1, col("n")).otherwise(0)), "attribution": (col("cut"), F.lit(1))}
    return synthesis.checks(lines, "l_orderkey", tests)


def verification_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).groupBy("check", "status").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


def verification_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.verification(_checks(spark, sf_dir), "l_orderkey")


def shared_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that sell most of more than one brand."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.count("*").alias("n"))
    best = sold.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("l_suppkey").alias("s"))).alias("m")).select("p_brand", F.col("m.s").alias("l_suppkey"))
    return synthesis.shared_selection(best, "l_suppkey", "p_brand")


def build_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("priority"))
    edges = nations.select("n_nationkey", F.floor(F.col("n_nationkey") / 3).cast("int").alias("needs")).filter("n_nationkey <> needs")
    return ordering.build_order(nations, edges, "n_nationkey", "priority").select("n_nationkey", F.col("level"), "place")


QUERIES = {f.__name__: f for f in (
    exact_copy_clusters, name_clusters, dice_similarity, fork_fold, overlapping_dependencies, version_conflicts, naming_conflicts, concurrency_models, family_components, bounded_bfs,
    minimal_set, constraint_filter, alternatives_topk, verification_checks, verification_confidence, shared_selection, build_order,
)}

_PLAIN = names._PLAIN.format("p_name")
_GRAMS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
_TIMES = "len(list_filter({0}, lambda y: y = x))"
_VIOLATION = "case when s_acctbal < 0 then 'negative balance' when n_regionkey = 4 then 'excluded region' when s_acctbal < 1000 then 'small' end"
_CHECKS = """l as (select l_orderkey, count(*) as n, count(*) filter (l_linestatus = 'F') as done, count(*) filter (l_returnflag <> 'R') as kept, count(*) filter (l_tax > 0) as taxed,
    count(*) filter (l_quantity >= 25) as large, count(distinct l_suppkey) as suppliers, count(*) filter (l_discount > 0.05e0) as cut from lineitem group by 1),
t as (select l_orderkey, 'components' as "check", done as f, n as w from l union all select l_orderkey, 'symbols', kept, n from l union all select l_orderkey, 'dependencies', suppliers, n from l
    union all select l_orderkey, 'requirements', taxed, n from l union all select l_orderkey, 'edge-cases', large, case when n > 1 then n else 0 end from l union all select l_orderkey, 'attribution', cut, 1 from l),
checks as (select l_orderkey, "check", case when w = 0 then 'unknown' when f >= w then 'pass' when f > 0 then 'partial' else 'fail' end as status from t)"""
SQL = {
    "exact_copy_clusters": """with k as (select doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as k from documents)
        select min(doc_id) as representative, count(*) as members, count(distinct source) as sources from k where length(k) > 40 group by k having count(*) > 1""",
    "name_clusters": f"""with p as (select p_partkey, p_brand || '|' || {_PLAIN} as cluster, cast(round(p_retailprice * 100) as bigint) as cents from part)
        select cluster, arg_min(p_partkey, (-cents, p_partkey)) as representative, count(*) as members from p group by 1 having count(*) > 1""",
    "dice_similarity": f"""with n as (select distinct p_type, lower(p_name) as name from part),
        p as (select a.p_type, a.name as name_a, b.name as name_b, {_GRAMS.format('a.name')} as ga, {_GRAMS.format('b.name')} as gb from n a join n b on a.p_type = b.p_type and a.name < b.name),
        s as (select p_type, name_a, name_b, 2e0 * list_sum(list_transform(list_distinct(ga), lambda x: least({_TIMES.format('ga')}, {_TIMES.format('gb')}))) / (len(ga) + len(gb)) as score from p)
        select p_type, name_a, name_b, floor(score * 1000e0 + 0.5e0) / 1000e0 as score from s where score > 0.6e0""",
    "fork_fold": """with p as (select s_nationkey, arg_min(s_suppkey, (-cast(round(s_acctbal * 100) as bigint), s_suppkey)) as parent from supplier group by 1)
        select parent as representative, count(*) as forks, min(s_suppkey) as first_fork from supplier join p using (s_nationkey) where s_suppkey <> parent group by 1""",
    "overlapping_dependencies": "select l_partkey, count(distinct l_suppkey) as n_entities, count(distinct l_returnflag) as n_versions from lineitem group by 1 having count(distinct l_suppkey) > 1 order by n_entities desc, l_partkey limit 20",
    "version_conflicts": """with v as (select l_partkey, cast(floor(l_quantity / 10) as integer) as major from lineitem)
        select l_partkey, count(distinct major) as n_majors, (select string_agg(cast(m as varchar), ',' order by m) from (select unnest(list_distinct(list(major))) as m)) as majors
        from v group by 1 having count(distinct major) > 1 order by n_majors desc, l_partkey limit 15""",
    "naming_conflicts": "select p_name, count(distinct p_brand) as n_entities from part group by 1 having count(distinct p_brand) > 1 order by n_entities desc, p_name limit 12",
    "concurrency_models": """with m as (select o_custkey, case when regexp_matches(o_orderpriority, '^1-|^2-') then 'urgent' when regexp_matches(o_orderpriority, '^3-') then 'normal' when regexp_matches(o_orderpriority, '^4-|^5-') then 'none' end as model from orders)
        select model, count(distinct o_custkey) as n_entities, (select count(distinct model) > 1 from m) as conflict from m where model is not null group by 1""",
    "family_components": """with recursive k as (select p_partkey as v, 'n|' || p_brand || '|' || p_name as k from part union all select p_partkey, 's|' || p_size || '|' || p_type || '|' || p_brand from part),
        e as (select distinct a.v as a, b.v as b from k a join k b on a.k = b.k),
        r as (select v as origin, v as reached from k union select origin, b from r join e on a = reached),
        f as (select origin, min(reached) as family from r group by 1)
        select family, count(*) as members from f group by 1""",
    "bounded_bfs": """with recursive i as (select distinct l_suppkey, l_partkey from lineitem), h as (select l_partkey, min(l_suppkey) as hub from i group by 1),
        e as (select distinct hub as src, l_suppkey as dst from i join h using (l_partkey) where l_suppkey <> hub),
        f as (select src, dst from e qualify row_number() over (partition by src order by dst) <= 6),
        r as (select s_suppkey as seed, s_suppkey as node, 0 as level from supplier where s_suppkey < 5 union select seed, dst, level + 1 from r join f on node = src where level < 2)
        select seed, node, cast(min(level) as bigint) as level from r group by 1, 2""",
    "constraint_filter": f"select s_suppkey, {_VIOLATION} as violation from supplier join nation on s_nationkey = n_nationkey where s_suppkey not in (1, 2, 3)",
    "alternatives_topk": f"with {_EVIDENCE_SQL} select s_suppkey, total from ranked join supplier using (s_suppkey) join nation on s_nationkey = n_nationkey where s_suppkey not in (1, 2, 3) and {_VIOLATION} is null order by total desc, confidence desc, s_suppkey limit 4",
    "verification_checks": f'with {_CHECKS} select "check", status, count(*) as n, min(l_orderkey) as first from checks group by 1, 2',
    "verification_confidence": f"""with {_CHECKS}, p as (select l_orderkey, case status when 'pass' then 2 when 'partial' then 1 when 'fail' then 0 end as p from checks)
        select l_orderkey, count(p) as known, cast(case when count(p) > 0 then (80 * sum(p) + count(p)) // (2 * count(p)) else 0 end as bigint) as confidence from p group by 1""",
    "shared_selection": """with s as (select p_brand, l_suppkey, count(*) as n from lineitem join part on l_partkey = p_partkey group by all),
        b as (select p_brand, arg_min(l_suppkey, (-n, l_suppkey)) as l_suppkey from s group by 1)
        select l_suppkey, count(distinct p_brand) as n_features from b group by 1 having count(distinct p_brand) > 1""",
    "build_order": """with recursive e as (select n_nationkey as k, cast(n_nationkey // 3 as integer) as needs from nation where n_nationkey <> n_nationkey // 3),
        r as (select n_nationkey as k, 0 as level from nation union select e.k, r.level + 1 from r join e on e.needs = r.k),
        l as (select k, max(level) as level from r group by 1)
        select n_nationkey, level, row_number() over (order by level, n_regionkey desc, n_nationkey) as place from nation join l on k = n_nationkey""",
}
