"""Queries from requirements to tasks, their checks, comparisons and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions import text as tx
from evidra.operators import bundling as bd
from evidra.operators import clusters, matching, ordering, planning, verifying
from evidra.plans.literals import VOCABULARY, VOCABULARY_SQL, idioms, values, vocabulary
from evidra.plans.names import _PLAIN, _STEMMED
from evidra.plans.ranking import _EVIDENCE_SQL, WEIGHTS, supplier_evidence
from evidra.plans.reads import _at, _pick
from evidra.operators import evidence as ev
from evidra.sources.tables import table


def _units(spark: SparkSession, sf_dir: str):
    return planning.recognised(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", vocabulary(spark))


def requirement_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir)[0]


def primary_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir)[1]


def implementation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document's units is worth a search, and its share of queries."""
    return planning.plan(requirement_units(spark, sf_dir), "doc_id", vocabulary(spark), 12, ("greeting",), ("question",)).select("doc_id", "unit", "strategy", "share", "queries")


def task_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [v[0] for v in VOCABULARY] + ["unknown thing"]
    key = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", _pick(key, *ids).alias("id"), _pick(key, "Opening lines", "a question", "Place", "My Sorting").alias("feature"), F.array(F.col("text")).alias("requirements"),
        F.when(key % 3 == 0, F.array(F.lit("Acme"), F.lit(" "))).alias("must_mention"), (key % 5 + 1).cast("int").alias("limit"),
    )
    return planning.queries(rows, "item_id", vocabulary(spark), idioms(spark), "kotlin", "limit").groupBy("shape").agg(F.count("*").alias("n"), F.sum("place").alias("places"), F.min("query").alias("first"))


def feature_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capability that explains most words of what a part is called."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", _pick(F.col("p_partkey"), "french", "order for the", "short question", "de la german")).alias("name"))
    return planning.best_capability(rows, "key", "name", vocabulary(spark))


def enriched_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select("item_id", (key % 20).alias("ord"), _pick(key, "Order", "Voice notes", "German text").alias("name"), F.array(F.lit("fast"), F.lit("says what next")).alias("requirements"), F.when(key % 2 == 0, F.array(F.lit("hint"))).alias("search_hints"), F.when(key % 3 == 0, F.array(F.lit("Acme"))).alias("must_mention"))
    got = planning.enriched(rows, "item_id", vocabulary(spark), "kotlin", 3)
    return got.select("item_id", "id", "strategy", "priority", F.array_join("checklist", "|").alias("checklist"), F.array_join("searches", "|").alias("searches"))


def products_and_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    feature = F.concat(F.lit("Sync "), _pick(key, "Stripe", "with REST", "Acme.io data", "plain"), F.lit(" for Android and Redis"))
    declared = F.when(key % 5 == 0, F.array(F.lit(" Stripe "), F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
    hits = planning.exclusion_hits(F.array(F.lit("Brown"), F.lit(" "), F.lit("steel")), F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(planning.named_products(feature, declared), ",").alias("products"), F.array_join(hits, ",").alias("excluded"))


def stack_idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = spark.createDataFrame([("en", 0, " the "), ("en", 0, " and "), ("fr", 1, " de "), ("fr", 1, " la "), ("de", 2, " und ")], "stack string, ord int, marker string")
    return planning.stack_idioms(table(spark, sf_dir, "documents"), "doc_id", "text", markers)


def composite_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, main = _units(spark, sf_dir)
    got = planning.composite(units, "doc_id", main, vocabulary(spark), 6, 1)
    return got.groupBy("id").agg(F.count("*").alias("n"), F.max(F.size("checklist")).cast("long").alias("most"), F.min(F.array_join(F.slice("checklist", 1, 1), "")).alias("head"))


def declared_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.array(F.lower("n_name"), _pick(F.col("n_nationkey"), "nation_1", "NATION_2", "nowhere")).alias("needs"))
    return planning.declared_needs(rows, "n_nationkey", "n_name", "needs")


def chosen_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7 % 25).alias("priority"), F.col("n_name").alias("place"))
    return planning.chosen_in_order(rows, "n_nationkey", "priority", "place", None)[0].select("n_nationkey", "place")


def not_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7 % 25).alias("priority"), F.col("n_name").alias("place"))
    return planning.chosen_in_order(rows, "n_nationkey", "priority", "place", 30)[1].select("n_nationkey")


def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as plans, their parts as tasks: each needs those at a half and a third of its own number in the brand."""
    per = F.col("i")
    of = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.row_number().over(of).alias("i"))
    needs = F.array_distinct(F.filter(F.array(F.floor(per / 3), F.floor(per / 2)), lambda x: x > 0))
    got = ordering.topological(rows.withColumn("needs", needs).withColumn("i", per.cast("long")), "p_brand", "i", "p_size", "needs")
    return got.select("p_brand", "p_partkey", "place")


def closure_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reachable over chains of parts by their sizes, however long."""
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s"), ((F.col("n_nationkey") * 2 + F.col("n_regionkey")) % 25).alias("d"))
    return matching.closure(edges, "s", "d")


def declared_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required libraries that nations' projects declare, by equal names or names within names."""
    key = F.col("n_nationkey")
    need = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(_pick(key, "com.squareup:okhttp", "@types/node", "react"), F.lit("room"))).alias("name"))
    have = table(spark, sf_dir, "nation").select("n_nationkey", _pick(key, "okhttp", "react-dom", "node", "androidx.room:room-runtime").alias("lib"))
    return verifying.declared(need, "n_nationkey", "name", have, "lib")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    arr = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<string>)")
    by = lambda *lists: F.coalesce(*[F.when(F.pmod(key, F.lit(len(lists))) == k, arr(*x)) for k, x in enumerate(lists)])
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", by(("src/queue/DownloadQueue.kt", "tests/download_test.kt", "NOTICE"), ("src/a.py", "tests/x.py"), ("main.go",)).alias("files"), by(("RetryPolicy", "resume_store"), ()).alias("symbols"), by(("Queue", "Retry policy", "Cache"), ("Worker",), ()).alias("components"),
        by(("DownloadManager", "ResumeHandler", "RetryPolicy"), ("Foo",), ("UploadQueue", "Api")).alias("core"), by(("okhttp", "room"), ("react",), ()).alias("required"), by(("com.squareup:okhttp",), ("react-dom", "androidx.room:room")).alias("libraries"),
        F.lit("Resumable download").alias("feature"), by(("timeouts and expiry", "retry behaviour"), ("queue overflow",), ()).alias("edge_cases"), by(("keep the notice",), ()).alias("obligations"), (key % 5 == 0).alias("reference_only"),
    )


def plan_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifying.verify(_plans(spark, sf_dir), "s_suppkey").select("s_suppkey", "check", "status", "found", "wanted")


def verification_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.verification_report(plan_verification(spark, sf_dir), "s_suppkey")


def excluded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return verifying.without(rows, "n_name", rows.filter("n_nationkey < 5").select(F.lower("n_name").alias("name")), "name")


def integration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.array(*[F.lit(x) for x in ("Queue", "Persistence", "HTTP client", "Screens", "Extra")])).alias("ord", "component")).withColumn("component", F.when((F.col("s_suppkey") % 2 == 0) & (F.col("ord") == 0), "Worker").otherwise(F.col("component")))
    dirs = spark.createDataFrame([(0, "app/ui", "presentation"), (1, "app/data", "data access"), (2, "app/net", "networking"), (3, "app/jobs", "background work")], "ord int, path string, role string")
    return bd.integration_points(parts, "s_suppkey", "component", "ord", dirs, "path", "role", "ord")


def alternatives_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    axes = {"maintenance": n * 2, "integrationSurface": n * 3 % 101, "completeness": F.when(n > 10, n * 5 % 101), "testEvidence": n * 7 % 101}
    return table(spark, sf_dir, "part").select("p_partkey", bd.choose_when(axes, _pick(n, "DIRECT_REUSE", "ADAPT", "REFERENCE_ONLY")).alias("when"))


def adaptation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    efforts = F.flatten(F.array(F.array_repeat(F.lit("medium"), n % 5), F.array_repeat(F.lit("large"), n % 3), F.array(F.lit("small"))))
    return table(spark, sf_dir, "part").select("p_partkey", bd.adaptation_difficulty(efforts, n / 50.0).alias("difficulty"))


def _compared(spark: SparkSession, sf_dir: str):
    facts = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("feature"), _pick(F.col("s_suppkey"), "DIRECT_REUSE", "ADAPT", "DO_NOT_USE").alias("mode"), (F.col("s_suppkey") % 7 == 0).alias("archived"), _pick(F.col("s_suppkey"), "MIT", "UNKNOWN").alias("spdx"))
    ranked = ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS).select("s_suppkey", "total")
    evidence = supplier_evidence(spark, sf_dir).join(facts.select("s_suppkey", "feature"), "s_suppkey")
    return facts.join(ranked, "s_suppkey"), evidence


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, evidence = _compared(spark, sf_dir)
    got = bd.compare(rows, "feature", "s_suppkey", "total", "mode", "archived", "spdx", evidence)
    return got.select("feature", "recommendation", *[F.array_join(c, ",").alias(c) for c in ("blockers", "differentiators", "tied", "switch_if")])


def bundle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("long")
    parts = {"summary": F.col("p_name"), "symbols": F.col("p_type"), "tests": F.col("p_brand")}
    got = bd.bundle(table(spark, sf_dir, "part"), "p_partkey", n * 2, 100 - n, n + 20, 60, parts, {"summary": n, "symbols": n, "tests": F.lit(10).cast("long")})
    return got.select("p_partkey", "confidence", F.array_join("kept", ",").alias("kept"), "tests")


def build_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_name", (F.col("n_nationkey") * 11 % 25).alias("place"), F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit("own/r"), F.col("n_nationkey").cast("string"))).alias("chosen"), _pick(F.col("n_nationkey"), "reuse-library", "build-from-scratch", "study-reference").alias("strategy"))
    return bd.build_steps(rows, "n_regionkey", "n_name", "place", "chosen", "strategy")


def strategy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    k = F.col("n_nationkey")
    lines = bd.strategy_lines(k % 6, F.when(k % 2 == 0, F.array(F.lit("HTTP client"), F.lit("logging"))).otherwise(none), F.when(k % 3 == 0, F.array(*map(F.lit, "abcd"))).otherwise(none), k % 5 == 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(lines, "; ").alias("lines"))


def degradation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("stage"), F.concat(F.lit("r"), (F.floor("value") % 4).cast("string")).alias("reason"), "event_id")
    return bd.degradations(rows, "user_id", "event_id")


def budget_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(tx.estimate_tokens(F.col("text"))).alias("tokens"))
    return bd.largest_first(rows, "source", "lang", "tokens")


def score_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ev.rank_totals(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS)
    reasons = ev.reasons(supplier_evidence(spark, sf_dir), "s_suppkey", WEIGHTS).filter("side = 'for'").groupBy("s_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "axis"))), lambda x: x["axis"]).alias("reasons"))
    rows = got.join(reasons, "s_suppkey", "left").withColumn("reasons", F.coalesce("reasons", F.expr("cast(array() as array<string>)")))
    return bd.score_report(rows, "s_suppkey", "total", "confidence", "reasons")


def folded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as repositories: owner and name from brand and name, some of them forks or copies; what of each cluster is kept."""
    key = F.col("p_partkey")
    name = F.concat(_pick(key, "", "awesome-", ""), F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size").cast("string"), _pick(key, "", "-android", "", "2"))
    rows = table(spark, sf_dir, "part").select(
        key.alias("id"), F.lower("p_brand").alias("owner"), F.lower(name).alias("name"), F.when(key % 13 == 0, key - 1).alias("parent"), (key % 13 == 0).alias("is_fork"), (F.col("p_size") % 9 == 0).alias("archived"), (F.col("p_size") * 20).alias("days"),
        F.floor("p_retailprice").cast("long").alias("stars"), F.when(key % 11 == 0, F.concat(F.lit("a long description of what the project of type "), "p_type")).alias("description"),
    )
    return clusters.folded(rows).select("id", "representative", "members", "kept")


QUERIES = {f.__name__: f for f in (
    requirement_units, primary_capability, implementation_plan, task_queries, feature_matches, enriched_features, products_and_exclusions, stack_idioms, composite_tasks, declared_needs, chosen_in_order, not_searched, topological_order,
    closure_whole, declared_dependencies, plan_verification, verification_reports, excluded_entities, integration_points, alternatives_when, adaptation_bands, comparison,
    bundle_parts, build_steps, strategy_lines, degradation_rows, budget_breakdown, score_reports, folded_clusters,
)}

_TRIGGERS_SQL = f"{VOCABULARY_SQL}, trig as (select distinct id, ' ' || array_to_string({_STEMMED}, ' ') || ' ' as t from (select id, unnest(triggers) as text from vocabulary))"
_FOUND_SQL = f"""stemmed as (select doc_id, {_STEMMED} as ws from documents), spaced as (select doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' as s from stemmed),
    found as (select doc_id, id, count(*) as hits, min(case when strpos(s, t) = 1 then 0 else len(string_split(trim(left(s, strpos(s, t) - 1)), ' ')) end) as position from spaced join trig on contains(s, t) group by 1, 2)"""
_UNITS_SQL = f"""{_TRIGGERS_SQL}, {_FOUND_SQL}, needs as (select id, unnest(implies) as d from vocabulary), reach as (select id, d from needs union select r.id, n.d from reach r join needs n on n.id = r.d),
    both_ as (select doc_id, id, false as implied, hits from found union all (select distinct f.doc_id, r.d, true, 0 from found f join reach r on r.id = f.id where not exists (select 1 from found g where g.doc_id = f.doc_id and g.id = r.d))),
    units as (select doc_id, b.id as unit, label as name, implied, hits, reuse, checklist, cast(greatest(0, least(100, 50 + case when foundational then 25 else 0 end + case reuse when 'high' then 15 when 'low' then -15 else 0 end - case when implied then 20 else 0 end + least(10, 3 * hits))) as bigint) as priority from both_ b join vocabulary v on v.id = b.id),
    placed as (select *, row_number() over (partition by doc_id order by priority desc, name) as place from units)"""
_PRIMARY_SQL = f"""heads as (select doc_id, coalesce(list_filter(range(1, len(ws) + 1), lambda i: ws[i] in ({', '.join(f"'{q}'" for q in matching.QUALIFIERS)}))[1] - 1, len(ws)) as e from stemmed),
    inside as (select f.*, position < e as inside, max(position < e) over (partition by f.doc_id) as some_inside from found f join heads h on h.doc_id = f.doc_id), pool as (select * from inside where inside or not some_inside),
    main as (select doc_id, arg_max(id, (position, hits, id)) as capability from pool p where not exists (select 1 from pool q join (select id, unnest(narrows) as wide from vocabulary) n on n.id = q.id where q.doc_id = p.doc_id and n.wide = p.id) group by 1)"""
_NAMES = "[" + ", ".join(f"'{v[0]}'" for v in VOCABULARY) + ", 'unknown thing']"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_CONTENT = f"list_filter(string_split({_NORM}, ' '), lambda w: length(w) >= 3 and w not in ({', '.join(repr(w) for w in planning.PHRASE_STOP)}))"
_COMPACT = f"nullif(array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 and w not in ({', '.join(repr(w) for w in tx.QUERY_STOP)})), 1, 4), ' '), '')"
_COMPARE_SQL = f"""{_EVIDENCE_SQL}, facts as (select s_suppkey, s_nationkey as feature, {_at('s_suppkey', 'DIRECT_REUSE', 'ADAPT', 'DO_NOT_USE')} as mode, s_suppkey % 7 = 0 as archived, {_at('s_suppkey', 'MIT', 'UNKNOWN')} as spdx from supplier),
    c as (select f.*, r.total, mode = 'DO_NOT_USE' as blocked, case when mode = 'DO_NOT_USE' then 'do not use' when archived then 'archived' when spdx = 'UNKNOWN' then 'no licence' end as issue from facts f join ranked r using (s_suppkey)),
    w as (select feature, arg_min(s_suppkey, (blocked, -total, s_suppkey)) as best, coalesce(string_agg(s_suppkey || ': ' || issue, ',' order by s_suppkey || ': ' || issue) filter (issue is not null), '') as blockers from c group by 1),
    a as (select feature, axis, count(*) as n, max(value) - min(value) as spread, arg_min(c.s_suppkey, (-value, -total, c.s_suppkey)) as winner, arg_min(blocked, (-value, -total, c.s_suppkey)) as blocked from evidence e join c using (s_suppkey) where value is not null group by 1, 2 having count(*) >= 2),
    d as (select feature, string_agg(axis, ',' order by spread desc, axis) filter (rn <= 6) as differentiators from (select *, row_number() over (partition by feature order by spread desc, axis) as rn from a where spread >= 15) group by 1),
    t as (select feature, string_agg(axis, ',' order by axis) as tied from a where spread < 15 group by 1),
    f as (select a.feature, winner, min((-spread, axis)) as m from a join w using (feature) where spread >= 15 and winner <> best and not blocked group by 1, 2),
    s as (select feature, string_agg(m[2] || ': ' || winner, ',' order by rn) as switch_if from (select *, row_number() over (partition by feature order by m) as rn from f) where rn <= 3 group by 1)"""
# By the rules, worked out by hand: what each third and half of the suppliers' plans hold.
VERIFIED = (
    (0, 0, "components", "partial", 2, 3), (0, 1, "components", "partial", 1, 3), (1, 0, "components", "fail", 0, 1), (1, 1, "components", "fail", 0, 1),
    (0, 0, "symbols", "pass", 3, 3), (0, 1, "symbols", "partial", 1, 3), (1, 0, "symbols", "fail", 0, 1), (1, 1, "symbols", "fail", 0, 1), (2, 0, "symbols", "fail", 0, 2), (2, 1, "symbols", "fail", 0, 2),
    (0, 0, "dependencies", "partial", 1, 2), (0, 1, "dependencies", "partial", 1, 2), (1, 0, "dependencies", "fail", 0, 1), (1, 1, "dependencies", "pass", 1, 1),
    (0, 0, "tests", "pass", 1, 1), (0, 1, "tests", "pass", 1, 1), (1, 0, "tests", "partial", 0, 1), (1, 1, "tests", "partial", 0, 1), (2, 0, "tests", "fail", 0, 0), (2, 1, "tests", "fail", 0, 0),
    (0, 0, "edge-cases", "pass", 1, 2), (0, 1, "edge-cases", "unknown", 0, 2), (1, 0, "edge-cases", "unknown", 0, 1), (1, 1, "edge-cases", "unknown", 0, 1),
    (0, 0, "obligations", "pass", 1, 1), (1, 0, "obligations", "fail", 0, 1), (2, 0, "obligations", "fail", 0, 1),
)
_VERIFIED_SQL = f"checks as (select s_suppkey, \"check\", status, cast(found as bigint) as found, cast(wanted as bigint) as wanted from supplier join {values(VERIFIED, 'm3, m2, \"check\", status, found, wanted')} on s_suppkey % 3 = m3 and s_suppkey % 2 = m2 where \"check\" <> 'obligations' or s_suppkey % 5 <> 0)"
_GRAMS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
_TIMES = "len(list_filter({0}, lambda y: y = x))"
SQL: dict[str, str] = {
    "plan_verification": f"with {_VERIFIED_SQL} select * from checks",
    "verification_reports": f"""with {_VERIFIED_SQL} select s_suppkey, string_agg(case status when 'pass' then '✓' when 'partial' then '~' when 'fail' then '✗' else '?' end || ' ' || "check" || ' ' || found || '/' || wanted, chr(10) order by "check") as report from checks group by 1""",
    "folded_clusters": f"""with recursive n as (select *, {_at('p_partkey', '', 'awesome-', '')} || replace(p_name, ' ', '-') || p_size || {_at('p_partkey', '', '-android', '', '2')} as raw from part),
        r as (select p_partkey as id, lower(p_brand) as owner, lower(raw) as name, {_PLAIN.format('raw')} as plain, p_partkey % 13 = 0 as fork, p_size % 9 = 0 as archived, p_size * 20 as days, cast(floor(p_retailprice) as bigint) as stars, case when p_partkey % 11 = 0 then p_type end as description from n),
        o as (select owner, name, min(id) as id, {_GRAMS.format('name')} as g from r group by owner, name),
        e as (select id - 1 as a, id as b from r where fork and id > 0 union all select min(id) over (partition by name), id from r union all select min(id) over (partition by plain), id from r where plain <> '' union all select min(id) over (partition by description), id from r where description is not null
              union all select x.id, y.id from o x join o y on x.owner = y.owner and x.name < y.name where 2 * least(len(x.g), len(y.g)) > 0.85e0 * (len(x.g) + len(y.g)) and 2e0 * list_sum(list_transform(list_distinct(x.g), lambda x_: least(len(list_filter(x.g, lambda q: q = x_)), len(list_filter(y.g, lambda q: q = x_))))) / (len(x.g) + len(y.g)) > 0.85e0
              union all select min(id) over (partition by owner, name), id from r),
        u as (select a, b from e where a <> b union select b, a from e where a <> b), w as (select id as origin, id as reached from r union select origin, b from w join u on a = reached), f as (select origin as id, min(reached) as cluster from w group by 1),
        s as (select id, cluster, case when archived then -1000e0 else case when days <= 90 then 100 when days <= 365 then 60 when days <= 730 then 25 else 0 end + 8 * log10(stars + 1) - case when fork then 15 else 0 end end as score from f join r using (id)),
        c as (select cluster, arg_min(id, (-score, id)) as representative, count(*) as members from s group by 1) select id, representative, members, id = representative as kept from s join c using (cluster)""",
    "requirement_units": f"with recursive {_UNITS_SQL} select doc_id, unit, name, implied, hits, priority, place from placed",
    "primary_capability": f"with {_TRIGGERS_SQL}, {_FOUND_SQL}, {_PRIMARY_SQL} select doc_id, capability from main",
    "implementation_plan": f"""with recursive {_UNITS_SQL}, c as (select *, case when reuse = 'low' then 'build-from-scratch' when unit = 'greeting' then 'reuse-library' when unit = 'question' then 'study-reference' else 'reuse-pattern' end as strategy from units),
        w as (select *, case strategy when 'build-from-scratch' then null else greatest(50, priority * case strategy when 'reuse-library' then 13 when 'study-reference' then 8 else 11 end) end as w from c), s as (select *, sum(w) over (partition by doc_id) as total from w)
        select doc_id, unit, strategy, cast((200 * w + total) // (2 * total) as bigint) as share, cast(greatest(1, (2 * w * 12 + total) // (2 * total)) as bigint) * case when w is not null then 1 end as queries from s""",
    "task_queries": f"""with {VOCABULARY_SQL}, t as (select item_id, {_NAMES}[item_id % 7 + 1] as id, {_at('item_id', 'Opening lines', 'a question', 'Place', 'My Sorting')} as feature, text, item_id % 5 + 1 as lim from benchmark),
        v as (select t.*, v.id as vid, label, search_terms, topics, {_COMPACT} as compact, trim(regexp_replace(lower(coalesce(v.id, feature)), '[^a-z0-9]+', ' ', 'g')) as topic from t left join vocabulary v on v.id = t.id),
        s as (select item_id, lim, 0 as o, 'vendor-sdk' as shape, case when item_id % 3 = 0 then ['Acme', 'Acme sdk'] else [] end as q from v union all select item_id, lim, 1, 'stack-idiom', case vid when 'greeting' then ['salutation'] when 'order' then ['ordinal', 'sequence'] else [] end from v
           union all select item_id, lim, 2, 'domain-term', list_slice(coalesce(search_terms, []), 1, 4) from v union all select item_id, lim, 3, 'topic', list_transform(case when len(topics) > 0 then list_slice(topics, 1, 2) when length(topic) between 3 and 35 then [replace(topic, ' ', '-')] else [] end, lambda x: 'topic:' || x) from v
           union all select item_id, lim, 4, 'requirement', case when compact is null then [] else [compact || ' kotlin'] end from v union all select item_id, lim, 5, 'generic', case when coalesce(lower(feature) in (lower(label), replace(vid, '-', ' ')), false) then [] else [lower(feature) || ' kotlin'] end from v),
        u as (select item_id, lim, o, shape, unnest(q) as query, generate_subscripts(q, 1) - 1 as turn from s), d as (select * from u where turn < 6 and trim(query) <> '' qualify row_number() over (partition by item_id, lower(trim(query)) order by turn, o) = 1),
        p as (select *, row_number() over (partition by item_id order by turn, o) as place from d)
        select shape, count(*) as n, cast(sum(place) as bigint) as places, min(query) as first from p where place <= greatest(1, lim) group by 1""",
    "feature_matches": f"""with {VOCABULARY_SQL}, own as (select distinct id, unnest({_CONTENT.format('text')}) as w from (select id, unnest(list_append(triggers, label)) as text from vocabulary)),
        f as (select p_partkey as key, p_name || ' ' || {_at('p_partkey', 'french', 'order for the', 'short question', 'de la german')} as name from part), t as (select key, {_CONTENT.format('name')} as ws from f), e as (select key, len(ws) as n, unnest(ws) as w from t),
        g as (select key, id, n, count(*) as explained, count(*) / cast(n as double) as coverage from e join own using (w) group by 1, 2, 3 having count(*) / cast(n as double) >= 0.4e0), tied as (select *, max(coverage) over (partition by key) as top from g qualify top - coverage < 0.01e0),
        x as (select t.*, exists (select 1 from (select id, unnest(narrows) as wide from vocabulary) v join tied o on o.id = v.wide where v.id = t.id and o.key = t.key) as narrow from tied t)
        select key, arg_min(id, (not narrow, -coverage, -explained, id)) as capability, cast(floor(arg_min(coverage, (not narrow, -coverage, -explained, id)) * 100e0 + 0.5e0) as bigint) as coverage from x group by 1""",
    "enriched_features": f"""with f as (select item_id, {_at('item_id', 'Order', 'Voice notes', 'German text')} as name from benchmark)
        select item_id, case name when 'Order' then 'order' when 'German text' then 'german' else 'voice-notes' end as id, case name when 'Voice notes' then 'reuse-pattern' else 'reuse-library' end as strategy, cast(greatest(10, 90 - 5 * (item_id % 20)) as bigint) as priority,
               'fast|says what next' || case name when 'Order' then '|says what first|says what last' when 'German text' then '|is German' else '' end as checklist,
               array_to_string(list_slice(list_concat(case when item_id % 2 = 0 then ['hint'] else [] end, case when item_id % 3 = 0 then ['Acme', 'Acme sdk'] else [] end, [name || ' kotlin'], case name when 'Order' then ['in order'] when 'German text' then ['auf deutsch'] else [] end), 1, 3 + case when item_id % 3 = 0 then 2 else 0 end), '|') as searches from f""",
    "products_and_exclusions": f"""select p_partkey, case when p_partkey % 5 = 0 then 'stripe' else case {_at('p_partkey', 'Stripe', 'with REST', 'Acme.io data', 'plain')} when 'Stripe' then 'stripe,' when 'Acme.io data' then 'acme.io,' else '' end || 'redis' end as products,
        array_to_string(list_filter(['brown', 'steel'], lambda t: contains(lower(p_name || ' ' || p_type), t)), ',') as excluded from part""",
    "stack_idioms": """with m as (select * from (values ('en', 0, ' the '), ('en', 0, ' and '), ('fr', 1, ' de '), ('fr', 1, ' la '), ('de', 2, ' und ')) as t(stack, o, marker)), h as (select doc_id, stack, o, count(distinct marker) as hits from documents join m on contains(lower(text), marker) group by all)
        select doc_id, arg_max(stack, (hits, -o)) as stack, max(hits) as hits from h group by 1""",
    "composite_tasks": f"""with recursive {_UNITS_SQL}, {_PRIMARY_SQL}, l as (select p.doc_id, m.capability, p.unit <> m.capability as late, p.place, case when p.unit = m.capability then p.checklist else p.checklist[1:1] end as l from placed p join main m on m.doc_id = p.doc_id),
        g as (select doc_id, capability, list(l order by late, place) as all_ from l group by 1, 2), c as (select doc_id, capability, flatten(all_) as items from g), n as (select *, len(list_distinct(items)) as n from c)
        select capability as id, count(*) as n, cast(max(least(6, n)) as bigint) as most, min(items[1]) as head from n group by 1""",
    "declared_needs": f"select a.n_nationkey, b.n_nationkey as needed from (select n_nationkey, {_at('n_nationkey', 'NATION_1', 'NATION_2', 'nowhere')} as d from nation) a join nation b on b.n_name = a.d where a.n_nationkey <> b.n_nationkey",
    "chosen_in_order": "select n_nationkey, n_name as place from nation order by n_nationkey * 7 % 25 desc, n_nationkey limit 4",
    "not_searched": "with t as (select n_nationkey from nation order by n_nationkey * 7 % 25 desc, n_nationkey limit 20) select n_nationkey from nation where n_nationkey not in (select n_nationkey from t)",
    "topological_order": """with recursive t as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) as i from part),
        e as (select p_brand, i, unnest(list_distinct(list_filter([i // 3, i // 2], lambda x: x > 0))) as needs, i // 2 as half from t),
        w as (select p_brand, i, [-p_size, i] as walk from t
              union all select w.p_brand, e.needs, list_append(w.walk, case when e.needs = e.half and e.half <> e.i // 3 and e.i // 3 > 0 then 1 else 0 end)
              from w join e on e.p_brand = w.p_brand and e.i = w.i),
        m as (select p_brand, i, min(walk) as walk from w group by 1, 2)
        select p_brand, p_partkey, row_number() over (partition by p_brand order by list_append(walk, 2147483647)) as place from m join t using (p_brand, i)""",
    "closure_whole": """with recursive e as (select distinct n_nationkey as s, (n_nationkey * 2 + n_regionkey) % 25 as d from nation), r as (select s as origin, d as reached, 1 as steps from e union select origin, d, steps + 1 from r join e on reached = s where steps < 26)
        select origin, reached, min(steps) as steps from r group by 1, 2""",
    "declared_dependencies": f"""with n as (select n_nationkey, unnest([{_at('n_nationkey', 'com.squareup:okhttp', '@types/node', 'react')}, 'room']) as name, {_at('n_nationkey', 'okhttp', 'react-dom', 'node', 'androidx.room:room-runtime')} as lib from nation),
        s as (select n_nationkey, name, case name when 'com.squareup:okhttp' then 'okhttp' when '@types/node' then 'node' else name end as n, case lib when 'androidx.room:room-runtime' then 'room-runtime' else lib end as t from n) select n_nationkey, name, contains(t, n) or contains(n, t) as present from s""",
    "excluded_entities": "select n_nationkey, n_name from nation where n_nationkey >= 5",
    "integration_points": f"""select s_suppkey, component, coalesce(location, '.') as location, location is not null as found from supplier, {values((("Queue", "app/jobs"), ("Persistence", "app/data"), ("HTTP client", "app/net"), ("Screens", None)), "component, location")} where not (component = 'Queue' and s_suppkey % 2 = 0)
        union all select s_suppkey, 'Worker', 'app/jobs', true from supplier where s_suppkey % 2 = 0""",
    "alternatives_when": f"""with s as (select p_partkey, list_filter([case when p_size * 2 >= 85 then 'you need active maintenance' end, case when p_size * 3 % 101 >= 80 then 'you want the smallest integration surface' end, case when p_size > 10 and p_size * 5 % 101 >= 80 then 'requirement coverage matters most' end,
        case when p_size * 7 % 101 >= 85 then 'you want the strongest test evidence' end, case when p_size % 3 = 0 then 'you need to vendor code directly' end], lambda x: x is not null) as said from part)
        select p_partkey, case when len(said) > 0 then array_to_string(said[1:2], ', or ') else 'if the recommendation does not fit your constraints' end as "when" from s""",
    "adaptation_bands": """with t as (select p_partkey, 2 * (p_size % 5) + 4 * (p_size % 3) + 1 + case when p_size / 50e0 < 0.35e0 then 4 when p_size / 50e0 < 0.7e0 then 2 else 0 end as t from part)
        select p_partkey, case when t <= 2 then 'trivial' when t <= 4 then 'low' when t <= 8 then 'medium' when t <= 13 then 'high' else 'very-high' end as difficulty from t""",
    "comparison": f"with {_COMPARE_SQL} select feature, best as recommendation, blockers, coalesce(differentiators, '') as differentiators, coalesce(tied, '') as tied, coalesce(switch_if, '') as switch_if from w left join d using (feature) left join t using (feature) left join s using (feature)",
    "bundle_parts": """select p_partkey, cast(least(2 * p_size, 100 - p_size, p_size + 20) as bigint) as confidence, case when p_size > 60 then '' when 2 * p_size > 60 then 'summary' when 2 * p_size + 10 > 60 then 'summary,symbols' else 'summary,symbols,tests' end as kept, case when 2 * p_size + 10 <= 60 then p_brand end as tests from part""",
    "build_steps": f"""with t as (select n_regionkey, n_name, n_nationkey * 11 % 25 as place, case when n_nationkey % 4 > 0 then 'own/r' || n_nationkey end as chosen, {_at('n_nationkey', 'reuse-library', 'build-from-scratch', 'study-reference')} as strategy from nation)
        select n_regionkey, row_number() over (partition by n_regionkey order by place, n_name) as step, case when strategy = 'build-from-scratch' then 'build ' || n_name when chosen is null then 'build ' || n_name || ' (nothing found)' when strategy = 'study-reference' then 'study ' || chosen || ' for ' || n_name else 'adapt ' || chosen || ' for ' || n_name end as text from t""",
    "strategy_lines": """select n_nationkey, case when n_nationkey % 6 = 0 then '' else 'define own interfaces first' || case when n_nationkey % 2 = 0 then '; one library for each of: HTTP client, logging' else '' end || case when n_nationkey % 3 = 0 then '; rename on the way in: a, b, c' else '' end
        || case when n_nationkey % 5 = 0 then '; settle licences before code' else '' end || '; integrate one feature at a time, with its tests' end as lines from nation""",
    "degradation_rows": """with f as (select user_id, event_type as stage, 'r' || cast(floor(value) % 4 as bigint) as reason, min(event_id) as o from events group by all) select user_id, stage, reason from f qualify row_number() over (partition by user_id order by o, stage, reason) <= 8""",
    "budget_breakdown": """with t as (select source, lang, cast(sum(case when length(text) > 0 then greatest(1, ceil(length(text) / 4e0 + (length(text) - length(replace(text, chr(10), ''))) * 0.3e0)) else 0 end) as bigint) as tokens from documents group by all)
        select source, lang, tokens, row_number() over (partition by source order by tokens desc, lang) as place from t""",
    "score_reports": f"""with {_EVIDENCE_SQL}, f as (select s_suppkey, axis, row_number() over (partition by s_suppkey order by value * w desc, axis) as rank from weighted where value >= 75), r as (select s_suppkey, string_agg('- ' || axis, chr(10) order by rank) as lines from f where rank <= 5 group by 1)
        select s_suppkey, 'SCORE ' || total || '/100  confidence ' || confidence || '%' || chr(10) || coalesce(lines, '') as report from ranked left join r using (s_suppkey)""",
}
