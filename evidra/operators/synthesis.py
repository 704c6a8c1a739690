"""What several chosen entities do to one another: overlaps, version and name conflicts, families, shared choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import major_version


def overlaps(deps: DataFrame, name: str, entity: str, version: str | None = None, most: int = 20) -> DataFrame:
    """(name, n_entities, n_versions): dependencies of more than one entity, the most shared first. Sets are counted before they are dealt."""
    aggs = [F.countDistinct(entity).alias("n_entities")]
    if version:
        aggs.append(F.countDistinct(version).alias("n_versions"))
    return deps.groupBy(name).agg(*aggs).filter("n_entities > 1").orderBy(F.desc("n_entities"), name).limit(most)


def version_conflicts(deps: DataFrame, name: str, version: str, most: int = 15) -> DataFrame:
    """(name, n_majors, majors): resolved versions of one name with more than one major."""
    rows = deps.withColumn("major", major_version(F.col(version))).filter("major is not null")
    got = rows.groupBy(name).agg(F.countDistinct("major").alias("n_majors"), F.array_join(F.array_sort(F.collect_set(F.col("major").cast("int"))).cast("array<string>"), ",").alias("majors"))
    return got.filter("n_majors > 1").orderBy(F.desc("n_majors"), name).limit(most)


def naming_conflicts(symbols: DataFrame, name: str, entity: str, most: int = 12) -> DataFrame:
    """(name, n_entities): names that more than one entity declares."""
    return symbols.groupBy(name).agg(F.countDistinct(entity).alias("n_entities")).filter("n_entities > 1").orderBy(F.desc("n_entities"), name).limit(most)


def first_match(text: Column, rules: dict[str, str]) -> Column:
    """The name of the first pattern that fits, or null."""
    case = F.lit(None).cast("string")
    for name, pattern in reversed(rules.items()):
        case = F.when(text.rlike(pattern), name).otherwise(case)
    return case


# How code waits for other work, the first that fits.
CONCURRENCY = {"coroutines": r"(?i)coroutine|kotlinx|suspend|async/await|asyncio", "reactive": r"(?i)rx(java|js|swift|kotlin)|reactor|combine", "threads": r"(?i)thread|executor", "callbacks": r"(?i)callback|listener"}


def models(rows: DataFrame, entity: str, text: str, rules: dict[str, str] = CONCURRENCY) -> DataFrame:
    """(model, n_entities, conflict): entities by model; more than one model is a conflict."""
    found = rows.select(entity, first_match(F.col(text), rules).alias("model")).filter("model is not null").groupBy("model").agg(F.countDistinct(entity).alias("n_entities"))
    return found.join(F.broadcast(found.agg((F.count("*") > 1).alias("conflict"))))  # one row


def shared_selection(choices: DataFrame, entity: str, feature: str) -> DataFrame:
    """(entity, n_features): entities chosen for more than one feature."""
    return choices.groupBy(entity).agg(F.countDistinct(feature).alias("n_features")).filter("n_features > 1")


def families(keys: DataFrame, member: str, key: str) -> DataFrame:
    """(member, family): members that share a key, directly or through others, by the least member."""
    from evidra.operators.clusters import connected, star_links

    links = star_links(keys, F.col(key), member, "key")
    named = connected(links).select(F.col("v").alias(member), F.col("label").alias("family"))
    return keys.select(member).distinct().join(named, member, "left").select(member, F.coalesce("family", F.col(member)).alias("family"))


def violations(rules: list[tuple[str, Column]]) -> Column:
    """The reason of the first constraint that a row breaks, or null."""
    case = F.lit(None).cast("string")
    for reason, test in reversed(rules):
        case = F.when(test, reason).otherwise(case)
    return case


# What a rejection is about, the first that fits.
REJECTIONS = {
    "licence": r"(?i)licen[cs]e|gpl|copyleft", "language": r"(?i)\b(language|written in|rust|kotlin|java|python|go|typescript)\b", "dependency": r"(?i)depend|pulls in|requires", "maintenance": r"(?i)maintain|abandon|stale|outdated|archived",
    "size": r"(?i)too (big|large|heavy)|bloat", "architecture": r"(?i)architecture|coupl|monolith", "tests": r"(?i)\btests?\b|untested", "incomplete": r"(?i)missing|lacks|does ?n.t (have|support)|incomplete",
}


def rejection(reason: Column) -> Column:
    """struct(kind, subject) of why something was turned down."""
    subject = F.regexp_extract(reason, r"(?i)(?:depends on|pulls in|requires|missing|lacks|support for|written in|uses)\s+([A-Za-z0-9@/._-]+)", 1)
    return F.struct(F.coalesce(first_match(reason, REJECTIONS), F.lit("other")).alias("kind"), F.nullif(subject, F.lit("")).alias("subject"))


def checks(rows: DataFrame, entity: str, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(entity, check, status): pass if all that is wanted is found, partial if some is, fail if none; unknown if nothing is wanted. tests: name -> (found, wanted)."""
    made = [F.struct(F.lit(n).alias("check"), F.when(w == 0, "unknown").when(f >= w, "pass").when(f > 0, "partial").otherwise("fail").alias("status")) for n, (f, w) in tests.items()]
    return rows.select(entity, F.explode(F.array(*made)).alias("c")).select(entity, "c.*")


def verification(found: DataFrame, entity: str) -> DataFrame:
    """(entity, known, confidence): 80 % of the mean of pass 1, partial half, fail 0 over what is known, in hundredths."""
    points = F.when(F.col("status") == "pass", 2).when(F.col("status") == "partial", 1).when(F.col("status") == "fail", 0)
    got = found.groupBy(entity).agg(F.count(points).alias("known"), F.coalesce(F.sum(points), F.lit(0)).alias("p"))
    return got.select(entity, "known", F.when(F.col("known") > 0, F.floor((80 * F.col("p") + F.col("known")) / (2 * F.col("known")))).otherwise(0).cast("long").alias("confidence"))
