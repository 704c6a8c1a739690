"""Discovery end to end: queries of many tasks against a table of repositories, ranked candidates with reasons.

All tasks go through one plan with the task as a key, instead of one after another. Cheap signals
come from the repositories' own columns; files are joined for the shortlist alone, past a filter of a fixed
size, and give the other axes: quality, tests, documentation, dependencies, symbols, structure and checklist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions import scores
from evidra.functions.text import content_terms
from evidra.operators import clusters, enriching, evidence, licences, matching, verifying
from evidra.operators.lineage import cut

# Weights of the axes, in hundredths.
WEIGHTS = {
    "featureRelevance": 15, "completeness": 15, "stackMatch": 12, "implementationQuality": 9, "testEvidence": 8, "reusability": 8, "maintenance": 7, "licenseCompatibility": 7,
    "architectureMatch": 5, "integrationSurface": 5, "documentation": 3, "popularity": 3, "dependencySimplicity": 3,
}
MULTIPLIER = {"DIRECT_REUSE": 100, "ADAPT": 95, "REFERENCE_ONLY": 75, "DO_NOT_USE": 40}


def search(queries: DataFrame, repos: DataFrame, per_query: int = 100) -> DataFrame:
    """(task, ord, query, full_name, rank): repositories that hold all terms of a query, the most starred first.

    queries (task, ord, query) go against all repositories in blocks of a bounded size, a block a
    reading of the text. A query that finds nothing is tried again without its last term, twice at most.
    """
    wanted = matching.relaxed(queries, "query").select("task", "ord", "query", "drop", F.split("variant", " ").alias("terms"))
    blocks = -(-max(1, wanted.count()) // matching.SMALL)
    text = F.lower(F.concat_ws(" ", "full_name", "description", F.array_join("topics", " ")))
    found = None
    for k in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("task", "ord", "drop"), F.lit(blocks)) == k)
        lists = own.groupBy().agg(F.collect_list(F.struct("task", "ord", "query", "drop", "terms")).alias("all"))
        rows = repos.select("full_name", "stars", text.alias("text")).join(F.broadcast(lists))  # one row
        hit = F.filter("all", lambda q: F.forall(q["terms"], lambda t: F.contains(F.col("text"), F.lower(F.regexp_replace(t, "^topic:", "")))))
        part = rows.select("full_name", "stars", F.explode(hit).alias("q")).select("full_name", "stars", "q.task", "q.ord", "q.query", "q.drop")
        found = part if found is None else found.union(part)
    least = found.groupBy("task", "ord").agg(F.min("drop").alias("drop"))
    found = found.join(matching.small(least), ["task", "ord", "drop"])
    order = Window.partitionBy("task", "ord").orderBy(F.desc("stars"), "full_name")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_query).select("task", "ord", "query", "full_name", "rank")


def pool(hits: DataFrame, size: int, least_share: int = 3) -> DataFrame:
    """(task, full_name, discovered_via): each query admits its share, what is over fills the pool."""
    queries = hits.groupBy("task").agg(F.countDistinct("ord").alias("queries"))
    first = hits.groupBy("task", "full_name").agg(F.min(F.struct("ord", "rank")).alias("f"), F.array_sort(F.collect_set("query")).alias("discovered_via"))
    own = Window.partitionBy("task", "f.ord").orderBy("f.rank", "full_name")
    rows = first.join(queries, "task").withColumn("n", F.row_number().over(own)).withColumn("over", F.col("n") > F.greatest(F.lit(least_share), F.ceil(F.lit(size) / F.col("queries"))))
    place = Window.partitionBy("task").orderBy("over", "f.ord", "n")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= size).select("task", "full_name", "discovered_via")


def fold(candidates: DataFrame, as_of: Column) -> DataFrame:
    """candidates (task, full_name, ... of repos) without those folded into another of the same task, with folded, the size of each one's cluster."""
    keyed = candidates.withColumn("id", F.concat_ws("|", "task", "full_name"))
    parts = F.split(F.lower("full_name"), "/")
    rows = keyed.select(
        "id", "task", F.element_at(parts, 1).alias("owner"), F.element_at(parts, 2).alias("name"), F.when(F.col("parent").isNotNull(), F.concat_ws("|", "task", "parent")).alias("parent"), "is_fork", "archived",
        F.datediff(as_of, F.col("pushed_at").cast("date")).alias("days"), "stars", "description",
    )
    best = clusters.folded(rows, block="task").filter("kept").select("id", F.col("members").alias("folded"))
    return keyed.join(best, "id").drop("id")


def hundredths(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


def cheap(candidates: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """candidates with the axes that a repository's own columns give; the others are null."""
    none = F.expr("cast(array() as array<string>)")
    rows = candidates.join(matching.small(tasks), "task")
    terms = content_terms(F.col("requirement"), matching.STOP, 4, 12)
    days = lambda c: F.datediff(as_of, F.col(c).cast("date"))
    kind = licences.category(licences.normal_spdx(F.col("license_spdx")))
    axes = {
        "featureRelevance": (scores.feature_relevance(terms, F.col("topics"), F.concat_ws(" ", "full_name", "description"), F.lit(None).cast("string"), none, none), 60),
        "stackMatch": (scores.stack_match(F.col("language"), F.col("target_language"), none, none, none), 40),
        "maintenance": (scores.maintenance(days("pushed_at"), F.lit(None).cast("long"), days("created_at"), F.col("archived")), 90),
        "licenseCompatibility": (licences.score(kind) / 100.0, 95),
        "popularity": (scores.popularity(F.col("stars")), 90),
    }
    for axis in WEIGHTS:
        value, sure = axes.get(axis, (F.lit(None).cast("double"), 0))
        rows = rows.withColumn(axis, hundredths(value)).withColumn(f"{axis}_confidence", F.lit(sure))
    empty = {"manifest_text": F.lit(None).cast("string"), "readme": F.lit(None).cast("string"), "modules": none, "library_paths": F.lit(0), "app_paths": F.lit(0)}
    return reusable(rows.withColumns(empty)).drop(*empty).withColumn("licence_kind", kind)


def reusable(rows: DataFrame) -> DataFrame:
    """rows with the reusability axis, kind and kind_confidence, from what a repository says of itself and what is known of its files."""
    said = F.concat_ws(" ", F.substring_index("full_name", "/", -1), "description", F.array_join("topics", " "))
    got = rows.withColumn("_signs", enriching.library_signs(said))
    kind = scores.reusability(F.col("_signs.library"), F.col("_signs.application"), F.col("_signs.signs"), F.col("_signs.example"))
    got = got.withColumn("_kind", kind)
    axis = scores.reusability_axis(F.col("_kind"))
    made = {"reusability": hundredths(axis["value"]), "reusability_confidence": F.coalesce(hundredths(axis["confidence"]), F.lit(0)).cast("int"), "kind": F.col("_kind.kind"), "kind_confidence": F.col("_kind.confidence")}
    return got.withColumns(made).drop("_signs", "_kind")


def enrich(short: DataFrame, files: DataFrame) -> DataFrame:
    """The shortlist with the axes that its files (full_name, path, content or not) give; other repositories' files are not read past the filter.

    Quality is measured where repositories have releases, documentation, dependencies and symbols where files have a content.
    Adds kind and kind_confidence, and satisfied and decidable, the items of the task's checklist that are there and
    those that could be looked up.
    """
    texts = files if "content" in files.columns else files.withColumn("content", F.lit(None).cast("string"))
    known = "content" in files.columns
    found = enriching.facts(short, texts)
    none = F.expr("cast(array() as array<string>)")
    got = short.drop("kind", "kind_confidence").join(found, "full_name", "left").withColumns({"modules": F.coalesce("modules", none)})
    got = reusable(got)
    seen = F.col("files").isNotNull()
    readme = F.when(F.col("has_readme"), scores.readme_quality(F.col("readme"))).otherwise(0.0) if known else F.lit(None).cast("double")
    releases = F.col("releases") if "releases" in short.columns else F.lit(None).cast("long")
    size_kb = F.col("size_kb") if "size_kb" in short.columns else F.lit(None).cast("long")
    runtime, names = F.coalesce("runtime", none), F.coalesce("symbols", none)
    terms = content_terms(F.col("requirement"), matching.STOP, 4, 12)
    counted = F.when(F.size(names) > 0, F.size(names)).otherwise(scores.size_proxy(size_kb))
    surface = scores.surface_axis(scores.integration_surface(counted, F.size(runtime), F.coalesce("points", F.lit(2)), F.lit(0), scores.coupling(runtime, none, F.col("mean_depth"))))
    fit = scores.architecture_axis(F.when(F.size(names) > 0, verifying.architecture_fit(names, terms)))
    made = {
        "implementationQuality": (scores.implementation_quality(F.col("has_ci"), releases, F.col("has_docs"), F.col("has_contributing"), F.col("has_changelog"), F.col("has_readme")), 75),
        "testEvidence": (scores.test_evidence(F.col("test_files") > 0, F.col("test_files")), 80), "documentation": (scores.documentation(readme, F.col("has_docs"), F.col("has_changelog")), 70),
        "dependencySimplicity": (F.when(F.col("runtime").isNotNull(), scores.dependency_simplicity(F.size(runtime))), 80),
        "integrationSurface": (surface["value"] if known else F.lit(None).cast("double"), 75), "architectureMatch": (fit["value"], 70),
    }
    for axis, (value, sure) in made.items():
        got = got.withColumn(axis, F.when(seen, hundredths(value))).withColumn(f"{axis}_confidence", F.when(F.col(axis).isNotNull(), sure).otherwise(0))
    got = checked(cut(got)) if "checklist" in short.columns else got.withColumns({"satisfied": F.lit(None).cast("long"), "decidable": F.lit(None).cast("long")})
    return got.drop(*[c for c in found.columns if c != "full_name"])


def checked(short: DataFrame) -> DataFrame:
    """short with the completeness axis, satisfied and decidable: its task's checklist held against what is known of each repository."""
    entity = F.concat_ws("|", "task", "full_name").alias("entity")
    items = short.select("task", F.explode("checklist").alias("requirement")).distinct()
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    # a corpus's reliability: what is declared in code before what is said of it
    corpora = [(joined("symbols"), 100), (joined("runtime"), 60), (F.col("paths"), 55), (F.col("readme"), 35), (F.concat_ws(" ", "description", F.array_join("topics", " ")), 30)]
    rows = short.select(entity, "task", F.inline(F.array(*[F.struct(body.alias("body"), F.lit(w).alias("w")) for body, w in corpora])))
    got = matching.coverage(items, "requirement", "requirement", rows.filter("body is not null"), "entity", "body", "w", "task")
    counts = got.groupBy("entity").agg(
        F.count_if(F.col("status") == "evidenced").alias("satisfied"), F.count_if(F.col("status") == "unknown").alias("open"), F.count("*").alias("items"),
    )
    counts = counts.withColumn("decidable", F.col("items") - F.col("open"))
    axis = scores.completeness_axis(F.col("satisfied"), F.col("open"), F.col("items"))
    both = short.withColumn("entity", entity).join(counts, "entity", "left")
    made = {"completeness": hundredths(axis["value"]), "completeness_confidence": F.coalesce(hundredths(axis["confidence"]), F.lit(0)).cast("int")}
    return both.withColumns(made).drop("entity", "open", "items")


def totals(wide: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """wide with total, confidence and unmeasured of each (task, full_name); what is measured elsewhere (task, full_name, axis, value, confidence, in hundredths) comes before an axis of wide."""
    keyed = wide.withColumn("_e", F.struct("task", "full_name"))
    rows = evidence.melt(keyed, "_e", list(WEIGHTS))
    if measured is not None:
        own = measured.select(F.struct("task", "full_name").alias("_e"), "axis", F.col("value").cast("long").alias("_v"), F.col("confidence").alias("_c"))
        rows = rows.join(own, ["_e", "axis"], "left").select("_e", "axis", F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(F.col("confidence")).alias("confidence"))
    got = evidence.rank_totals(rows, "_e", WEIGHTS)
    return wide.join(got.select("_e.*", "total", "confidence", "unmeasured"), ["task", "full_name"])


def discover(tasks: DataFrame, queries: DataFrame, repos: DataFrame, files: DataFrame, as_of: str, size: int = 40, deep: int = 5, least: int = 35, measured: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of each task: (task, rank, full_name, tier, total, confidence, verdict, unmeasured, discovered_via, folded), and the axes in hundredths.

    tasks (task, requirement, target_language, checklist or not), queries (task, ord, query), repos and files as in
    the survey's data model; measured has axes that are known from elsewhere. An axis that nothing measures stays
    unmeasured, and a gate whose input is unknown stays open. Assessed rows come before those that
    were not looked into.
    """
    clock = F.lit(as_of).cast("date")
    found = pool(search(queries, repos), size).join(repos, "full_name")
    scored = totals(cheap(fold(found, clock), tasks, clock), measured)
    order = Window.partitionBy("task").orderBy(F.desc("total"), "full_name")
    scored = cut(scored.withColumn("shortlisted", F.row_number().over(order) <= deep).drop("total", "confidence", "unmeasured"))
    short = enrich(scored.filter("shortlisted"), files)
    both = totals(short.unionByName(scored.filter("not shortlisted"), allowMissingColumns=True), measured)
    old = F.datediff(clock, F.col("pushed_at").cast("date")) > 730
    licence = F.col("licence_kind")
    fit = F.col("architectureMatch") / 100.0
    if measured is not None:
        fits = measured.filter("axis = 'architectureMatch'").select("task", "full_name", (F.col("value") / 100.0).alias("_fit"))
        both, fit = both.join(fits, ["task", "full_name"], "left"), F.coalesce("_fit", fit)
    verdict = scores.reuse(
        licences.compatible(licence, "closed") != "false", ~licence.isin("unknown", "none"), old | F.col("archived"), F.col("kind"), F.col("kind_confidence"),
        licence.isin("strong-copyleft", "network-copyleft"), F.lit(False), F.col("stackMatch") / 100.0, fit, F.coalesce(F.col("licenseCompatibility") / 100.0, F.lit(0.0)),
    )["verdict"]
    both = both.withColumn("verdict", F.when(F.col("shortlisted"), verdict))
    nothing = F.col("satisfied") == 0
    gates = [(nothing & (F.col("decidable") >= 5), 45), (nothing & F.col("decidable").between(3, 4), 55), *[(F.col("verdict") == v, p) for v, p in MULTIPLIER.items() if p < 100]]
    both = both.withColumn("total", evidence.gated(F.col("total"), gates))
    both = both.withColumn("tier", F.when(F.col("shortlisted"), 0).otherwise(1)).filter((F.col("total") >= least) | F.col("shortlisted"))
    last = Window.partitionBy("task").orderBy("tier", F.desc("total"), F.desc("confidence"), "full_name")
    named = ["full_name", "tier", "total", "confidence", "verdict", "unmeasured", "discovered_via", "folded"]
    return both.withColumn("rank", F.row_number().over(last)).select("task", "rank", *named, *WEIGHTS)
