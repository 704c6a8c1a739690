"""Whether a project holds what a plan asked for: components, symbols, dependencies, tests, edge cases, obligations; constraints of a rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import dependency_name, half_up
from evidra.operators.containment import contained, grams
from evidra.operators.lineage import cut

# Patterns of test files and of files that name their authors and terms.
TEST_FILE = r"(?i)(^|/)(test|tests|spec|__tests__)/|\.(test|spec)\.\w+$"
NOTICE_FILE = r"(?i)(^|/)(NOTICE|LICENSE|LICENCE|THIRD.?PARTY|ATTRIBUTION)[^/]*$"
ROLE_WORDS = r"\b(manager|coordinator|controller|service|engine|worker|handler|queue|scheduler|client|repository|store|policy|strategy|state)\b"


def mentions(haystack: Column, phrase: Column) -> Column:
    """Whether a word of four letters or more of a phrase is in a lower-case text."""
    return F.exists(F.filter(F.split(F.lower(phrase), r"\W+"), lambda w: F.length(w) >= 4), lambda w: F.contains(haystack, w))


def _spaced(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]", " "))


def mentions_identifier(haystack: Column, name: Column) -> Column:
    """Whether at least half of a name's words of four letters or more are in a lower-case text (without a last s will do), or its longest, of six or more; a name without such words has to be there itself."""
    ws = F.filter(F.split(_spaced(name), r"\s+"), lambda w: F.length(w) >= 4)
    met = F.filter(ws, lambda w: F.contains(haystack, w) | F.contains(haystack, F.regexp_replace(w, "s$", "")))
    longest = F.element_at(F.array_sort(F.transform(ws, lambda w, k: F.struct((-F.length(w)).alias("l"), k.alias("k"), w.alias("w")))), 1)["w"]
    return F.when(F.size(ws) == 0, F.contains(haystack, F.lower(name))).otherwise((F.size(met) > 0) & ((2 * F.size(met) >= F.size(ws)) | ((F.length(longest) >= 6) & F.array_contains(met, longest))))


def traced(haystack: Column, cases: Column) -> Column:
    """Those cases a word of which, of four letters or more, is in a lower-case text."""
    return F.filter(cases, lambda e: F.exists(F.split(e, r"[\s/]+"), lambda w: (F.length(w) >= 4) & F.contains(haystack, F.lower(w))))


def declared(required: DataFrame, entity: str, name: str, have: DataFrame, other: str) -> DataFrame:
    """(entity, name, present): required dependencies, and whether the entity declares one that is equal or holds the other's name.

    First by an equal join; what is left is looked up within its entity, in both directions, by the rarest of the
    shorter name's three-letter pieces (see containment.contained), so an entity may have any number of names.
    """
    want = cut(required.select(entity, name, dependency_name(F.col(name)).alias("_need")).distinct())
    own = cut(have.select(F.col(entity).alias("_e"), dependency_name(F.col(other)).alias("_have")).filter("_have <> ''").distinct())
    equal = want.join(own, (F.col(entity) == F.col("_e")) & (F.col("_need") == F.col("_have")), "left_semi")
    left = cut(want.join(equal, [entity, name], "left_anti"))
    asked, there = left.select(F.col(entity).alias("form"), F.col("_need")).distinct(), own.select(F.col("_e").alias("form"), "_have")
    longer = contained(there.withColumnRenamed("_have", "s"), asked.withColumnRenamed("_need", "phrase"), grams, F.contains).select("form", F.col("phrase").alias("_need"))
    shorter = contained(asked.withColumnRenamed("_need", "s"), there.withColumnRenamed("_have", "phrase"), grams, F.contains).select("form", F.col("s").alias("_need"))
    met = longer.union(shorter).distinct().select(F.col("form").alias("_e"), F.col("_need").alias("_met_need"), F.lit(True).alias("_met"))
    rest = left.join(met, (F.col(entity) == F.col("_e")) & (F.col("_need") == F.col("_met_need")), "left")
    present = F.coalesce("_met", F.lit(False)).alias("present")
    return equal.select(entity, name, F.lit(True).alias("present")).union(rest.select(entity, name, present))


def verify(plans: DataFrame, key: str) -> DataFrame:
    """(key, check, status, found, wanted): the six checks of each plan against its target.

    plans (key, files, symbols, components, core, required, libraries, feature, edge_cases,
    obligations, reference_only); arrays of strings but for feature and reference_only. A check of
    which nothing is wanted has no row.
    """
    text = F.concat(F.lower(F.array_join("files", "\n")), F.lit("\n"), F.lower(F.array_join(F.coalesce("symbols", F.array().cast("array<string>")), "\n")))
    rows = plans.withColumn("_t", text)
    names = F.transform("libraries", dependency_name)
    tests = F.filter("files", lambda f: f.rlike(TEST_FILE))
    terms = F.filter(F.split(F.lower("feature"), r"\W+"), lambda w: F.length(w) >= 4)
    own = F.filter(tests, lambda f: F.exists(terms, lambda t: F.contains(F.lower(f), t)))
    got = {
        "components": (F.size(F.filter("components", lambda c: mentions(F.col("_t"), c))), F.size("components")),
        "symbols": (F.size(F.filter("core", lambda s: mentions_identifier(F.col("_t"), s))), F.size("core")),
        "dependencies": (F.size(F.filter("required", lambda d: F.exists(names, lambda t: (t == dependency_name(d)) | F.contains(t, dependency_name(d)) | F.contains(dependency_name(d), t)))), F.size("required")),
        "tests": (F.size(own), F.size(tests)),
        "edge-cases": (F.size(traced(F.col("_t"), F.col("edge_cases"))), F.size("edge_cases")),
        "obligations": (F.size(F.filter("files", lambda f: f.rlike(NOTICE_FILE))), F.size("obligations")),
    }
    every = lambda f, w: F.when(f == w, "pass").when(f > 0, "partial").otherwise("fail")
    most = lambda share, last: lambda f, w: F.when(f >= F.ceil(w * share), "pass").when(f > 0, "partial").otherwise(last)
    status = {
        "components": every, "symbols": most(0.6, "fail"), "dependencies": every, "tests": lambda f, w: F.when(f > 0, "pass").when(w > 0, "partial").otherwise("fail"),
        "edge-cases": most(0.5, "unknown"), "obligations": lambda f, w: F.when(f > 0, "pass").otherwise("fail"),
    }
    asked = {n: F.col("_w") > 0 for n in got} | {"tests": F.lit(True), "edge-cases": (F.col("_w") > 0) & (F.size(tests) > 0), "obligations": (F.col("_w") > 0) & ~F.col("reference_only")}
    parts = None
    for n, (f, w) in got.items():
        part = rows.withColumn("_f", f).withColumn("_w", w).filter(asked[n]).select(key, F.lit(n).alias("check"), status[n](F.col("_f"), F.col("_w")).alias("status"), F.col("_f").cast("long").alias("found"), F.col("_w").cast("long").alias("wanted"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


# Levels of difficulty that are too much, and categories of licences that are one class of problem.
TOO_HARD, COPYLEFT = ("high", "very-high"), ("strong-copyleft", "network-copyleft", "proprietary")


def violates(kind: Column, subject: Column) -> Column:
    """Why a candidate breaks a constraint too, or null.

    Columns of the candidate: reuse_mode, license_category, license_spdx, dependencies (array),
    stack_match (0 to 1), difficulty, archived, days_since_push, items (array of (requirement, status)).
    A build failure or another reason is nothing that can be looked up.
    """
    low = F.lower(subject)
    dep = F.element_at(F.filter("dependencies", lambda d: F.contains(F.lower(d), low)), 1)
    dep = F.when(F.size(F.filter("dependencies", lambda d: F.contains(F.lower(d), low))) > 0, dep)
    wanted = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 4)
    item = F.get(F.filter("items", lambda i: F.exists(wanted, lambda w: F.contains(F.lower(i["requirement"]), w))), F.lit(0))
    licence = (
        F.when(F.col("reuse_mode") == "DO_NOT_USE", F.concat(F.lit("licence "), F.coalesce("license_spdx", F.lit("unknown")), F.lit(" is incompatible")))
        .when(F.col("license_category").isin(*COPYLEFT), F.concat(F.lit("licence "), F.coalesce("license_spdx", F.lit("unknown")), F.lit(" is "), "license_category"))
        .when(F.contains(F.lower("license_spdx"), low), F.concat(F.lit("also "), "license_spdx"))
    )
    return (
        F.when(kind == "license-incompatible", licence)
        .when(kind == "dependency-incompatible", F.concat(F.lit("also depends on "), dep))
        .when(kind == "stack-mismatch", F.when(F.coalesce("stack_match", F.lit(1.0)) < 0.6, F.concat(F.lit("stack match is only "), F.floor(F.col("stack_match") * 100 + 0.5).cast("string"), F.lit("%"))))
        .when(kind == "too-complex", F.when(F.col("difficulty").isin(*TOO_HARD), F.concat(F.lit("integration difficulty is "), "difficulty")))
        .when(kind == "unmaintained", F.when(F.col("archived"), "also archived").when(F.col("days_since_push") > 365, F.concat(F.lit("also stale (last activity "), F.col("days_since_push").cast("string"), F.lit("d ago)"))))
        .when(kind == "missing-capability", F.when(item["status"] == "absent", F.concat(F.lit('also lacks "'), item["requirement"], F.lit('"'))))
    )


# What a constraint is called.
CONSTRAINTS = {
    "license-incompatible": "licence incompatibility", "dependency-incompatible": "an incompatible dependency", "stack-mismatch": "a technology-stack mismatch", "too-complex": "excessive integration complexity",
    "unmaintained": "lack of maintenance", "missing-capability": "a missing capability", "build-failure": "a build failure", "other": "an unclassified problem",
}


def described(kind: Column, subject: Column) -> Column:
    name = F.coalesce(*[F.when(kind == k, v) for k, v in CONSTRAINTS.items()])
    return F.when(subject.isNotNull(), F.concat(name, F.lit(" ("), subject, F.lit(")"))).otherwise(name)


def without(rows: DataFrame, entity: str, excluded: DataFrame, name: str) -> DataFrame:
    """rows but those whose entity is excluded, whatever the case."""
    return rows.join(excluded.select(F.lower(name).alias("_x")).distinct(), F.lower(entity) == F.col("_x"), "left_anti")


def architecture_fit(names: Column, terms: Column) -> Column:
    """0.7 of the share of terms (four letters or more) that a symbol's name holds, 0.3 of how many names have a role word (a fifth of them, three at least, is all); 0.5 with nothing to go by."""
    low = F.transform(names, lambda n: F.lower(F.regexp_replace(n, "([a-z0-9])([A-Z])", "$1 $2")))
    wanted = F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: F.length(t) >= 4))
    covered = F.size(F.filter(wanted, lambda t: F.exists(low, lambda n: F.contains(n, t)))) / F.size(wanted)
    structured = F.least(F.lit(1.0), F.size(F.filter(low, lambda n: n.rlike(ROLE_WORDS))) / F.greatest(F.lit(3.0), F.size(low) * 0.2))
    return F.when((F.size(low) == 0) | (F.size(wanted) == 0), 0.5).otherwise(half_up(F.least(F.lit(1.0), covered * 0.7 + structured * 0.3), 2))


def feature_test_confidence(terms: Column, symbols: Column, files: Column, corpus: Column) -> Column:
    """How far the tests are about the feature: the share of its terms in their texts and paths, less without named tests."""
    wanted = F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: F.length(t) >= 4))
    text = F.lower(F.concat_ws(" ", corpus, F.array_join(files, " ")))
    met = F.size(F.filter(wanted, lambda t: F.contains(text, t)))
    value = met / F.size(wanted) * F.when(symbols > 0, 1.0).otherwise(0.7) + F.when(met > 0, 0.15).otherwise(0.0)
    some = (symbols > 0) | (F.size(files) > 0)
    return F.when(F.size(terms) == 0, F.when(some, 0.5).otherwise(0.0)).when(F.size(wanted) == 0, 0.5).otherwise(half_up(F.least(F.lit(1.0), value), 2))
