"""Queries of results as text, and of what plans take for granted and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.operators import bundling, reporting
from evidra.plans import content, files, tasks
from evidra.plans.reads import _at, _pick
from evidra.sources.tables import table


def primary_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of most of a brand's source files, by their extensions."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo"), "p_brand")
    return reporting.primary_language(files.source_files(spark, sf_dir).join(brands, "repo"), "p_brand", "path")


def adaptation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may go wrong with a part's adaptation, and what it has to keep."""
    size = F.col("p_size")
    parts = F.slice(F.split("p_name", " "), F.lit(1), size % 3)
    risky = reporting.adaptation_risks(size / 50.0, (size % 10) / 10.0, size % 4 > 0)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(risky, "; ").alias("risks"), F.array_join(reporting.kept_in_adaptation(parts), "; ").alias("kept"))


def _plans(spark: SparkSession, sf_dir: str):
    """(selections, unrecognised, unenriched, not searched, conflicts, versions, licences): regions as plans, nations as features."""
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("plan"), F.col("n_name").alias("feature"), F.concat(F.lit("own/r"), key.cast("string")).alias("candidate"), (key % 3).alias("undetermined"), F.when(key % 4 > 0, key * 7 % 100).alias("tested"),
        (key * 11 % 100).alias("shaped"), (key * 100).alias("days"), key.alias("key"),
    )
    named = lambda k: rows.filter(F.col("key") % k == 0).select("plan", F.lower("feature").alias("name"))
    conflicts = rows.filter("key % 6 = 1").select("plan", _pick(F.col("key"), "licence", "architecture", "licence", "other").alias("kind"), _pick(F.col("key"), "high", "low", "medium").alias("severity"), F.concat(F.lit("issue of "), "feature").alias("issue"))
    licences = rows.groupBy("plan").agg(F.max("candidate").alias("strictest"), F.when(F.col("plan") % 2 == 0, "high").otherwise("low").alias("risk"))
    return rows, named(5), named(6), named(7), conflicts, named(8), licences


def plan_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, unrecognised, unenriched, left, *_ = _plans(spark, sf_dir)
    return reporting.assumptions(rows, "plan", unrecognised, unenriched, left)


def plan_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _, _, conflicts, versions, licences = _plans(spark, sf_dir)
    return reporting.risks(rows, "plan", conflicts, versions, licences)


def plan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tasks.build_steps(spark, sf_dir).withColumnRenamed("n_regionkey", "plan")
    return reporting.plan_report(steps, "plan", plan_assumptions(spark, sf_dir), plan_risks(spark, sf_dir))


def comparison_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, evidence = tasks._compared(spark, sf_dir)
    return reporting.comparison_report(bundling.compare(rows, "feature", "s_suppkey", "total", "mode", "archived", "spdx", evidence), "feature")


def bundle_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("long")
    parts = {"summary": F.col("p_name"), "symbols": F.col("p_type"), "tests": F.col("p_brand")}
    got = bundling.bundle(table(spark, sf_dir, "part"), "p_partkey", n * 2, 100 - n, n + 20, 60, parts, {"summary": n, "symbols": n, "tests": F.lit(10).cast("long")})
    return reporting.bundle_report(got, "p_partkey", list(parts))


def discovery_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the candidates of their nation."""
    key = F.col("s_suppkey")
    order = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("task"), F.row_number().over(order).alias("rank"), F.concat(F.lit("own/r"), key.cast("string")).alias("full_name"), (key % 101).alias("total"), (key % 90).alias("confidence"),
        _pick(key, "DIRECT_REUSE", "ADAPT", None).alias("verdict"), _pick(key, "", "completeness,tests").alias("unmeasured"),
    )
    return reporting.discovery_report(rows)


def metrics_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.metrics_report(content.context_reduction(spark, sf_dir), "conv_id", "raw", "returned", "reduction")


QUERIES = {f.__name__: f for f in (
    primary_languages, adaptation_notes, plan_assumptions, plan_risks, plan_reports, comparison_reports, bundle_reports, discovery_reports, metrics_reports,
)}

_PLANS = f"""n as (select n_regionkey as plan, n_name as feature, 'own/r' || n_nationkey as candidate, n_nationkey as key from nation),
        c as (select plan, {_at('key', 'licence', 'architecture', 'licence', 'other')} as kind, {_at('key', 'high', 'low', 'medium')} as severity, 'issue of ' || feature as issue from n where key % 6 = 1)"""
_named = lambda part, said, k: f"select plan, {part} as part, '' as b, '{said}' || string_agg(distinct lower(feature), ', ' order by lower(feature)) as text from n where key % {k} = 0 group by plan"
_ASSUMED = f"""a as (select plan, 0 as part, feature || '|0' as b, feature || ': ' || key % 3 || ' requirements couldn''t be looked up in ' || candidate as text from n where key % 3 > 0
        union all select plan, 0, feature || '|1', feature || ': hardly any sign that ' || candidate || ' tests this' from n where key % 4 > 0 and key * 7 % 100 < {reporting.TESTED}
        union all select plan, 0, feature || '|2', feature || ': the architecture of ' || candidate || ' is a guess' from n where key * 11 % 100 < {reporting.SHAPED}
        union all {_named(1, 'not planned, as no capability is known for it: ', 5)} union all {_named(2, 'searched in the words given: ', 6)} union all {_named(3, 'not searched, the limit was reached: ', 7)}
        union all select distinct plan, 9, '', 'licences are to be confirmed before anything is shipped' from n),
        assumed as (select plan, row_number() over (partition by plan order by part, b, text) as place, text from a)"""
_RISKED = f"""k as (select plan, case kind when 'licence' then 0 else 1 end as part, issue as b, issue as text from c where (kind = 'licence' and severity = 'high') or kind = 'architecture'
        union all {_named(2, 'several major versions of: ', 8)}
        union all select plan, 3, '', 'the strictest licence governs all: ' || max(candidate) from n where plan % 2 = 0 group by plan
        union all select plan, 4, '', 'no longer maintained: ' || string_agg(distinct candidate, ', ' order by candidate) from n where key * 100 > {reporting.OLD} group by plan),
        risked as (select plan, row_number() over (partition by plan order by part, b, text) as place, text from k)"""
_listed = lambda rows, title: f"select plan, '{title}' || chr(10) || string_agg(place || '. ' || text, chr(10) order by place) as r from {rows} group by plan"
SQL = {
    "primary_languages": """with l as (select p_brand, ['Kotlin', 'TypeScript', 'Python', 'Rust', 'Go'][p_partkey % 5 + 1] as language, count(*) as n from part group by 1, 2)
        select p_brand, language, n from l qualify row_number() over (partition by p_brand order by n desc, language) = 1""",
    "adaptation_notes": """select p_partkey, array_to_string(list_filter([case when p_size / 50e0 < 0.35e0 then 'tests have to be written anew in the other language' end, case when p_size % 10 < 5 then 'the source''s architecture is a guess: look at it first' end,
        case when p_size % 4 = 0 then 'the target was not looked at: places to connect are general ones' end], lambda x: x is not null), '; ') as risks,
        'logic and changes of state; edge cases: errors, retries, timeouts; public interfaces that fit the target' || case when p_size % 3 > 0 then '; borders between components: ' || array_to_string(string_split(p_name, ' ')[1:p_size % 3], ', ') else '' end as kept from part""",
    "plan_assumptions": f"with {_PLANS}, {_ASSUMED} select plan, place, text from assumed",
    "plan_risks": f"with {_PLANS}, {_RISKED} select plan, place, text from risked",
    "plan_reports": f"""with {_PLANS}, {_ASSUMED}, {_RISKED}, steps as (select n_regionkey as plan, step as place, text from ({tasks.SQL['build_steps']})),
        r as (select 0 as k, * from ({_listed('steps', 'PLAN')}) union all select 1, * from ({_listed('assumed', 'TAKEN FOR GRANTED')}) union all select 2, * from ({_listed('risked', 'RISKS')}))
        select plan, string_agg(r, chr(10) || chr(10) order by k) as report from r group by plan""",
    "comparison_reports": f"""with q as ({tasks.SQL['comparison']})
        select feature, concat_ws(chr(10), 'TAKE ' || recommendation, {', '.join(f"case when {c} <> '' then '{said}' || replace({c}, ',', ', ') end" for said, c in (('blocked: ', 'blockers'), ('they differ in: ', 'differentiators'), ('they are alike in: ', 'tied'), ('switch for: ', 'switch_if')))}) as report from q""",
    "bundle_reports": """select p_partkey, concat_ws(chr(10), 'BUNDLE, sure ' || least(2 * p_size, 100 - p_size, p_size + 20) || '%', case when p_size <= 60 then 'summary: ' || p_name end, case when 2 * p_size <= 60 then 'symbols: ' || p_type end, case when 2 * p_size + 10 <= 60 then 'tests: ' || p_brand end,
        case when 2 * p_size + 10 > 60 then 'left out for the budget: ' || (1 + cast(2 * p_size > 60 as int) + cast(p_size > 60 as int)) end) as report from part""",
    "discovery_reports": f"""with r as (select s_nationkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as n, s_suppkey as k from supplier)
        select 't' || s_nationkey as task, 'CANDIDATES for t' || s_nationkey || chr(10) || string_agg(n || '. own/r' || k || ' ' || k % 101 || '/100, sure ' || k % 90 || '%, ' || {_at('k', 'DIRECT_REUSE', 'ADAPT', 'not looked into')} || case when k % 2 = 1 then '; not measured: completeness,tests' else '' end, chr(10) order by n) as report from r group by s_nationkey""",
    "metrics_reports": f"with m as ({content.SQL['context_reduction']}) select conv_id, 'read ' || raw || ' tokens, returned ' || returned || ' (' || reduction || ' % less)' as report from m",
}
