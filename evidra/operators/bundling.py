"""Putting an answer together: where components go, roles, adaptation, comparison, steps, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of place, by words of a directory's role and words of a component that belongs there.
PLACES = (("(data|persist|repositor|storage)", "(data|persist|repositor|storage|entity|dao)"), ("(network|http|api)", "(client|network|http|request)"), ("(background|worker|job)", "(worker|queue|job|scheduler)"))
# The role of a symbol by its name, the first that fits.
ROLES = (("(?i)manager|coordinator", "orchestration"), ("(?i)worker|executor|runner", "execution"), ("(?i)queue|scheduler", "work scheduling"), ("(?i)handler|policy|strategy", "behaviour policy"), ("(?i)repository|store|dao", "persistence"), ("(?i)client|adapter", "external interface"))
# What a directory's name says, the first that fits.
DIRECTORIES = (
    ("^(src|lib|source)$", "source root"), ("^(domain|core|model|models|entity|entities)$", "domain model"), ("^(data|repository|repositories|persistence|db|database|storage)$", "data access"),
    ("^(ui|presentation|view|views|screen|screens|components?)$", "presentation"), ("^(network|net|api|http|remote|client)$", "networking"), ("^(di|inject|injection|module|modules)$", "dependency injection"),
    ("^(util|utils|common|shared|helpers?)$", "shared utilities"), ("^(worker|workers|job|jobs|task|tasks|background)$", "background work"), ("^(service|services|usecase|usecases|interactor)$", "business logic"),
    ("^(config|configuration|settings)$", "configuration"), ("^(test|tests|spec)$", "tests"),
)
# The circumstance in which an alternative's strength decides, in this order, with the least value.
STRENGTHS = (("maintenance", 85, "you need active maintenance"), ("integrationSurface", 80, "you want the smallest integration surface"), ("completeness", 80, "requirement coverage matters most"), ("testEvidence", 85, "you want the strongest test evidence"))


def role_matches(role: Column, component: Column) -> Column:
    a, b = F.lower(role), F.lower(component)
    out = F.contains(a, b) | F.contains(b, a)
    for left, right in PLACES:
        out = out | (a.rlike(left) & b.rlike(right))
    return out


def directory_role(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(f"(?i){p}"), r) for p, r in DIRECTORIES])


def symbol_role(name: Column, components: Column) -> Column:
    """The component whose first word is in the name, else what the name says."""
    low = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))
    own = F.get(F.filter(components, lambda c: F.contains(low, F.element_at(F.split(F.lower(c), " "), 1))), F.lit(0))
    return F.coalesce(own, *[F.when(name.rlike(p), r) for p, r in ROLES], F.lit("core implementation"))


def choose_when(axes: dict[str, Column], mode: Column) -> Column:
    """When an alternative is the better choice: its first two strengths. axes are values in hundredths."""
    said = F.array_compact(F.array(*[F.when(F.coalesce(axes[a], F.lit(0)) >= n, text) for a, n, text in STRENGTHS if a in axes], F.when(mode == "DIRECT_REUSE", "you need to vendor code directly")))
    return F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, 2), ", or ")).otherwise("if the recommendation does not fit your constraints")


def integration_points(components: DataFrame, entity: str, component: str, ord_: str, directories: DataFrame, path: str, role: str, dir_ord: str, root: str = ".", most: int = 4) -> DataFrame:
    """(entity, component, location, found): the first directory of the target whose role fits each of an entity's first components; its root if none does.

    directories are those of one target project, a short list in its listing's order.
    """
    order = Window.partitionBy(entity).orderBy(ord_)
    rows = components.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    lists = directories.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(dir_ord).alias("o"), F.col(path).alias("path"), F.col(role).alias("role")))), lambda d: F.struct(d["path"].alias("path"), d["role"].alias("role"))).alias("_ds"))
    first = F.get(F.filter("_ds", lambda d: role_matches(d["role"], F.col(component))), F.lit(0))["path"]
    return rows.join(F.broadcast(lists)).select(entity, component, F.coalesce(first, F.lit(root)).alias("location"), first.isNotNull().alias("found"))  # one row


# Concepts for which a project wants one library, and what they are called; what does the same, in order of preference.
CONCEPTS = (
    ("HTTP client", "okhttp|retrofit|ktor-client|axios|got|^ky$|httpx|requests|aiohttp|alamofire|reqwest|^dio$"),
    ("local database", "room|realm|sqldelight|core-?data|prisma|drizzle|typeorm|sequelize|sqlalchemy|gorm|diesel"),
    ("dependency injection", "dagger|hilt|koin|guice|inversify|tsyringe|spring-context"),
    ("JSON serialisation", "gson|moshi|jackson|kotlinx-serialization|serde_json|pydantic"),
    ("logging", "timber|slf4j|logback|winston|pino|log4j|zap|tracing"),
    ("background scheduling", "workmanager|celery|bullmq|asynq|quartz|sidekiq"),
    ("image loading", "coil|glide|picasso|kingfisher|sdwebimage"),
    ("reactive streams", "rxjava|rxjs|rxswift|reactor-core"),
)
SUBSTITUTES = (
    ("local database", ("room", "realm", "core.?data", "sqldelight", "sqlite", "prisma", "drizzle", "typeorm", "sqlalchemy", "hibernate", "gorm", "diesel")),
    ("HTTP client", ("okhttp", "retrofit", "ktor", "axios", "httpx", "requests", "reqwest", "alamofire", "urlsession")),
    ("dependency injection", ("dagger", "hilt", "koin", "guice", "inversify", "tsyringe", "spring")),
    ("background scheduling", ("workmanager", "celery", "bullmq", "asynq", "quartz", "sidekiq")),
    ("serialisation", ("gson", "moshi", "jackson", "kotlinx.?serialization", "serde", "pydantic")),
    ("reactive/async", ("rxjava", "rxjs", "coroutines", "combine", "asyncio", "tokio")),
)


def duplicate_abstractions(deps: DataFrame, entity: str, name: str) -> DataFrame:
    """(concept, families, entities): concepts that libraries of more than one family serve; libraries that share an identity key, directly or through others, are one family."""
    from evidra.functions.text import identity_keys
    from evidra.operators.synthesis import families

    concept = F.array_compact(F.array(*[F.when(F.col(name).rlike(f"(?i){p}"), c) for c, p in CONCEPTS]))
    rows = deps.select(entity, F.col(name).alias("_d"), F.explode(concept).alias("concept"))
    keys = rows.select("_d", "concept").distinct().select(F.concat_ws("|", "concept", "_d").alias("m"), F.explode(identity_keys(F.col("_d"))).alias("k")).select("m", F.concat_ws("|", F.substring_index("m", "|", 1), "k").alias("k"))
    named = families(keys, "m", "k")
    got = rows.withColumn("m", F.concat_ws("|", "concept", "_d")).join(named, "m").groupBy("concept").agg(F.countDistinct("family").alias("families"), F.countDistinct(entity).alias("entities"))
    return got.filter("families > 1")


def adaptation(rows: DataFrame, key: str) -> DataFrame:
    """(key, step, action, effort): what has to change, in order: port, replace or decide each library, reshape, test.

    rows (key, stack_match, language, dependencies, target_libraries, pattern, target_pattern); names are compared without case.
    """
    deps, theirs = F.transform("dependencies", F.lower), F.lower(F.array_join(F.coalesce("target_libraries", F.array().cast("array<string>")), " "))
    step = lambda action, effort: F.struct(action.alias("action"), F.lit(effort).alias("effort"))
    named = lambda m: lambda d: d.rlike(rf"\b{m}\b")
    steps = [F.when(F.col("stack_match") < 0.35, step(F.concat(F.lit("port into "), F.coalesce("language", F.lit("your language"))), "large"))]
    for concept, members in SUBSTITUTES:
        source = F.coalesce(*[F.when(F.exists(deps, named(m)), k) for k, m in enumerate(members)])
        target = F.coalesce(*[F.when(theirs.rlike(rf"\b{m}\b"), k) for k, m in enumerate(members)])
        steps.append(F.when(source.isNotNull() & target.isNull(), step(F.lit(f"decide on {concept}"), "medium")).when(source != target, step(F.lit(f"replace {concept}"), "medium")))
    long_words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z ]", " "), r"\s+"), lambda w: F.length(w) > 3))
    alike = F.size(F.array_intersect(long_words(F.col("pattern")), long_words(F.col("target_pattern")))) >= 2
    steps.append(F.when(F.col("target_pattern").isNotNull() & F.col("pattern").isNotNull() & ~alike, step(F.concat(F.lit("reshape into "), "target_pattern"), "medium")))
    steps.append(step(F.lit("test what was adapted"), "small"))
    return rows.select(key, F.posexplode(F.array_compact(F.array(*steps))).alias("at", "s")).select(key, (F.col("at") + 1).cast("long").alias("step"), "s.action", "s.effort")


def adaptation_difficulty(efforts: Column, stack_match: Column) -> Column:
    """Band of the summed efforts (small 1, medium 2, large 4) and what a foreign stack adds."""
    total = F.aggregate(efforts, F.lit(0), lambda t, e: t + F.when(e == "large", 4).when(e == "medium", 2).when(e == "small", 1).otherwise(0)) + F.when(stack_match < 0.35, 4).when(stack_match < 0.7, 2).otherwise(0)
    return F.when(total <= 2, "trivial").when(total <= 4, "low").when(total <= 8, "medium").when(total <= 13, "high").otherwise("very-high")


def compare(candidates: DataFrame, group: str, entity: str, total: str, mode: str, archived: str, spdx: str, evidence: DataFrame, threshold: int = 15) -> DataFrame:
    """(group, recommendation, blockers, differentiators, tied, switch_if): a comparison of each group's candidates.

    The best total that may be used is recommended (the best of all if none may). Axes that two or
    more candidates have measured part them by threshold hundredths or more, or are tied; other
    winners of parting axes, three at most, are who to switch to. evidence is (group, entity, axis, value in hundredths).
    """
    rows = candidates.withColumn("_blocked", F.col(mode) == "DO_NOT_USE")
    issue = F.when(F.col("_blocked"), "do not use").when(F.col(archived), "archived").when(F.col(spdx) == "UNKNOWN", "no licence")
    heads = rows.groupBy(group).agg(
        F.min(F.struct("_blocked", (-F.col(total)).alias("t"), F.col(entity).alias("e"))).alias("w"),
        F.array_sort(F.collect_list(F.when(issue.isNotNull(), F.concat(F.col(entity).cast("string"), F.lit(": "), issue)))).alias("blockers"),
    )
    measured = evidence.filter("value is not null").join(rows.select(group, entity, F.col(total).alias("_t"), "_blocked"), [group, entity])
    axes = measured.groupBy(group, "axis").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"), F.min(F.struct((-F.col("value")).alias("v"), (-F.col("_t")).alias("t"), F.col(entity).alias("e"), F.col("_blocked").alias("b"))).alias("m"))
    axes = axes.filter("n >= 2").select(group, "axis", "spread", F.col("m.e").alias("winner"), F.col("m.b").alias("blocked"))
    joined = axes.join(heads.select(group, F.col("w.e").alias("best")), group)
    first = joined.filter((F.col("spread") >= threshold) & (F.col("winner") != F.col("best")) & ~F.col("blocked")).groupBy(group, "winner").agg(F.min(F.struct((-F.col("spread")).alias("s"), "axis")).alias("m"))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("m.s", "m.axis"))).filter("_n <= 3")
    switch = first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(": ", "m.axis", F.col("winner").cast("string")).alias("x")))), lambda x: x["x"]).alias("switch_if"))
    summed = axes.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("spread") >= threshold, F.struct((-F.col("spread")).alias("s"), "axis")))), lambda x: x["axis"]).alias("differentiators"),
        F.array_sort(F.collect_list(F.when(F.col("spread") < threshold, F.col("axis")))).alias("tied"),
    )
    none = F.expr("cast(array() as array<string>)")
    got = heads.join(summed, group, "left").join(switch, group, "left")
    return got.select(group, F.col("w.e").alias("recommendation"), "blockers", F.slice(F.coalesce("differentiators", none), 1, 6).alias("differentiators"), F.coalesce("tied", none).alias("tied"), F.coalesce("switch_if", none).alias("switch_if"))


def bundle(rows: DataFrame, key: str, architecture: Column, tests: Column, licence: Column, budget: int, parts: dict[str, Column], costs: dict[str, Column]) -> DataFrame:
    """(key, confidence, kept): the least of three confidences, and the parts of an answer, in order, up to the first that overflows the budget of tokens."""
    spent, open_, kept = F.lit(0).cast("long"), F.lit(True), []
    for name in parts:
        spent = spent + costs[name]
        open_ = open_ & (spent <= budget)
        kept.append(F.when(open_, name))
    return rows.select(key, F.least(architecture, tests, licence).alias("confidence"), F.array_compact(F.array(*kept)).alias("kept"), *[F.when(F.array_contains(F.array_compact(F.array(*kept)), n), c).alias(n) for n, c in parts.items()])


def strategy_lines(selected: Column, duplicates: Column, naming: Column, high_licence: Column) -> Column:
    """The steps to one architecture: own interfaces first, one library a concept, names apart, licences settled, a feature at a time."""
    lines = F.array_compact(F.array(
        F.lit("define own interfaces first"), F.when(F.size(duplicates) > 0, F.concat(F.lit("one library for each of: "), F.array_join(duplicates, ", "))),
        F.when(F.size(naming) > 0, F.concat(F.lit("rename on the way in: "), F.array_join(F.slice(naming, 1, 3), ", "))), F.when(high_licence, "settle licences before code"), F.lit("integrate one feature at a time, with its tests"),
    ))
    return F.when(selected > 0, lines).otherwise(F.expr("cast(array() as array<string>)"))


def build_steps(tasks: DataFrame, group: str, key: str, place: str, chosen: str, strategy: str) -> DataFrame:
    """(group, step, text): in build order what to do for each task: adapt what was chosen, study it, or build from scratch."""
    text = F.when(F.col(strategy) == "build-from-scratch", F.concat(F.lit("build "), key)).when(F.col(chosen).isNull(), F.concat(F.lit("build "), F.col(key), F.lit(" (nothing found)"))).when(F.col(strategy) == "study-reference", F.concat(F.lit("study "), F.col(chosen), F.lit(" for "), F.col(key))).otherwise(F.concat(F.lit("adapt "), F.col(chosen), F.lit(" for "), F.col(key)))
    return tasks.select(group, F.row_number().over(Window.partitionBy(group).orderBy(place, key)).cast("long").alias("step"), text.alias("text"))


def degradations(rows: DataFrame, group: str, order: str, most: int = 8) -> DataFrame:
    """(group, stage, reason): each once, in order of the first, the first most."""
    first = rows.groupBy(group, "stage", "reason").agg(F.min(order).alias("_o"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_o", "stage", "reason"))).filter(F.col("_n") <= most).select(group, "stage", "reason")


def largest_first(rows: DataFrame, group: str, name: str, size: str) -> DataFrame:
    """rows with place: the largest parts of each group first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(size), name)).cast("long"))


def score_report(rows: DataFrame, key: str, total: str, confidence: str, reasons: str) -> DataFrame:
    """(key, report): a score as lines of text."""
    return rows.select(key, F.concat(F.lit("SCORE "), F.col(total).cast("string"), F.lit("/100  confidence "), F.col(confidence).cast("string"), F.lit("%\n"), F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("- "), r)), "\n")).alias("report"))


# Signs of a check's status.
SIGNS = {"pass": "✓", "partial": "~", "fail": "✗", "unknown": "?"}


def verification_report(found: DataFrame, key: str) -> DataFrame:
    """(key, report): the checks of each plan as lines of text, by name."""
    sign = F.coalesce(*[F.when(F.col("status") == s, v) for s, v in SIGNS.items()])
    line = F.concat(sign, F.lit(" "), "check", F.lit(" "), F.col("found").cast("string"), F.lit("/"), F.col("wanted").cast("string"))
    return found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("check", line.alias("line")))).getField("line"), "\n").alias("report"))
