"""Scores of one entity as column expressions: each is a projection, in 0..1 at two digits unless said otherwise.

Inputs that were not measured are null and give null, never a low score.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.text import clamp01, half_up

# Points of what a match is worth, and the most of each kind.
TOPIC_HIT, TOPIC_MOST = 0.18, 0.45
NAME_HIT, NAME_MOST = 0.12, 0.35
BODY_HIT, BODY_MOST = 0.06, 0.30
PRODUCT_MISSING, PRODUCT_IN_BODY, EXCLUDED = 0.35, 0.6, 0.2
RELATED = {"kotlin": ("java",), "java": ("kotlin",), "typescript": ("javascript",), "javascript": ("typescript",), "c": ("c++",), "c++": ("c",), "swift": ("objective-c",), "objective-c": ("swift",)}


def _hits(terms: Column, body: Column) -> Column:
    return F.size(F.filter(terms, lambda t: (F.length(t) >= 4) & F.contains(F.lower(body), F.lower(t))))


def feature_relevance(terms: Column, topics: Column, name: Column, body: Column, products: Column, excluded: Column) -> Column:
    """Terms met in topics, name and body; a named product that is missing, or only in the body, and excluded words take from it."""
    joined = F.array_join(topics, " ")
    points = F.least(F.lit(TOPIC_MOST), TOPIC_HIT * _hits(terms, joined)) + F.least(F.lit(NAME_MOST), NAME_HIT * _hits(terms, name)) + F.least(F.lit(BODY_MOST), BODY_HIT * _hits(terms, F.coalesce(body, F.lit(""))))
    declared = F.lower(F.concat_ws(" ", joined, name))
    wanted = F.size(products) > 0
    told = F.exists(products, lambda p: F.contains(declared, F.lower(p)))
    mentioned = F.exists(products, lambda p: F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lower(p)))
    gate = F.when(wanted & ~told & ~mentioned, PRODUCT_MISSING).when(wanted & ~told, PRODUCT_IN_BODY).otherwise(1.0)
    out = F.when(F.exists(excluded, lambda x: F.contains(declared, F.lower(x))), EXCLUDED).otherwise(1.0)
    return clamp01(points * gate * out)


def stack_match(language: Column, target: Column, secondary: Column, frameworks_found: Column, frameworks_wanted: Column, host_penalty: Column | None = None, side_penalty: Column | None = None) -> Column:
    """Three quarters language, one quarter frameworks, times penalties for a foreign host or the wrong side."""
    own, goal = F.lower(language), F.lower(target)
    related = F.lit(False)
    for a, bs in RELATED.items():
        related = related | ((own == a) & goal.isin(*bs))
    lang = F.when(target.isNull(), 0.6).when(own == goal, 1.0).when(related, 0.6).when(F.array_contains(F.transform(secondary, F.lower), goal), 0.45).otherwise(0.1)
    ratio = F.when(F.size(frameworks_wanted) > 0, F.size(F.array_intersect(frameworks_found, frameworks_wanted)) / F.size(frameworks_wanted)).otherwise(0.5)
    value = 0.75 * lang + 0.25 * ratio
    for penalty in (host_penalty, side_penalty):
        if penalty is not None:
            value = value * F.coalesce(penalty, F.lit(1.0))
    return clamp01(value)


def _as(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def implementation_quality(ci: Column, releases: Column, docs: Column, contributing: Column, changelog: Column, readme: Column | None = None) -> Column:
    """CI, five releases, documentation (a readme alone is half of it), a guide, a changelog. Releases that weren't counted are null and make the whole unmeasured."""
    told = F.greatest(_as(docs), 0.5 * _as(readme)) if readme is not None else _as(docs)
    return clamp01(0.30 * _as(ci) + 0.25 * F.least(F.lit(1.0), releases / 5.0) + 0.20 * told + 0.10 * _as(contributing) + 0.15 * _as(changelog))


def test_evidence(has_tests: Column, files: Column) -> Column:
    return F.when(has_tests.isNull(), None).when(~has_tests, 0.05).otherwise(clamp01(0.35 + F.least(F.lit(0.65), files / 25.0 * 0.65)))


def documentation(readme: Column, docs: Column, changelog: Column) -> Column:
    return clamp01(0.6 * readme + 0.25 * _as(docs) + 0.15 * _as(changelog))


def popularity(stars: Column) -> Column:
    return clamp01(F.log10(stars + 1) / 4.5)


def dependency_simplicity(count: Column) -> Column:
    return F.when(count <= 3, 1.0).otherwise(clamp01(1 - F.log10(count / 3.0) / F.log10(F.lit(20.0))))


def maintenance(days: Column, commits_90: Column, age_days: Column, archived: Column) -> Column:
    """Steps of the days since the last push, refined by recent commits, under the ceiling of a young age; archived is 0."""
    step = F.when(days <= 30, 1.0).when(days <= 90, 0.85).when(days <= 180, 0.7).when(days <= 365, 0.5).when(days <= 730, 0.25).otherwise(0.08)
    refined = F.when((days <= 180) & commits_90.isNotNull(), step * 0.8 + F.least(F.lit(1.0), commits_90 / 30.0) * 0.2).otherwise(step)
    ceiling = F.when(age_days <= 30, 0.45).when(age_days <= 90, 0.6).when(age_days <= 365, 0.8).otherwise(1.0)
    return F.when(archived, 0.0).otherwise(clamp01(F.least(refined, ceiling)))


def completeness_penalty(satisfied: Column, decidable: Column) -> Column:
    return F.when((satisfied == 0) & (decidable >= 5), 0.45).when((satisfied == 0) & (decidable >= 3), 0.55).otherwise(1.0)


def completeness_axis(satisfied: Column, undetermined: Column, total: Column) -> Column:
    """struct(value, confidence) of a checklist: the share of what could be decided; null if nothing could."""
    decidable = total - undetermined
    return F.when((total > 0) & (decidable > 0), F.struct(clamp01(satisfied / decidable).alias("value"), clamp01(0.4 + 0.5 * (decidable / total)).alias("confidence")))


def architecture_axis(fit: Column) -> Column:
    """struct(value, confidence) of how well the structure fits; null if it wasn't measured."""
    return F.when(fit.isNotNull(), F.struct(clamp01(fit).alias("value"), F.lit(0.7).alias("confidence")))


def surface_axis(surface: Column) -> Column:
    return F.when(surface.isNotNull(), F.struct(clamp01(surface["score"]).alias("value"), F.lit(0.75).alias("confidence")))


def reusability_axis(assessed: Column) -> Column:
    """struct(value, confidence); an unknown kind is no measurement."""
    return F.when(assessed["kind"] != "unknown", F.struct(assessed["score"].alias("value"), assessed["confidence"].alias("confidence")))


def ramp_down(x: Column, low: float, high: float) -> Column:
    """1 up to low, 0 from high on, at two digits between."""
    return F.when(x <= low, 1.0).when(x >= high, 0.0).otherwise(half_up(1 - (x - low) / (high - low), 2))


# Frameworks that code is hard to take out of.
HEAVY = ("spring", "hibernate", "angular", "nestjs", "rails", "django", "laravel", "unity")


def coupling(dependencies: Column, target: Column, mean_depth: Column, heavy: tuple[str, ...] = HEAVY) -> Column:
    """0 to 1: heavy frameworks that the target doesn't use, containers that put objects together, deep folders."""
    deps, own = F.transform(dependencies, F.lower), F.transform(target, F.lower)
    used = sum((F.when(F.exists(deps, _holds(fw)) & ~F.exists(own, _either(fw)), 0.3).otherwise(0.0) for fw in heavy), F.lit(0.0))
    wired = F.when(F.exists(deps, lambda d: d.rlike("dagger|hilt|guice|inversify|tsyringe")), 0.15).otherwise(0.0)
    return half_up(F.least(F.lit(1.0), used + wired + F.when(mean_depth > 6, 0.15).otherwise(0.0)), 2)


def _holds(word: str):
    return lambda d: F.contains(d, F.lit(word))


def _either(word: str):
    return lambda t: F.contains(t, F.lit(word)) | F.contains(F.lit(word), t)


def integration_surface(symbols: Column, dependencies: Column, points: Column, config: Column, coupling: Column) -> Column:
    """struct(score, difficulty): how little there is to connect; coupling is 0 (none) to 1."""
    score = half_up(0.22 * ramp_down(symbols, 6, 40) + 0.24 * ramp_down(dependencies, 2, 20) + 0.16 * ramp_down(points, 1, 10) + 0.10 * ramp_down(config, 0, 8) + 0.28 * (1 - coupling), 2)
    difficulty = F.when(score >= 0.85, "trivial").when(score >= 0.68, "low").when(score >= 0.45, "medium").when(score >= 0.25, "high").otherwise("very-high")
    return F.struct(score.alias("score"), difficulty.alias("difficulty"))


def size_proxy(size_kb: Column) -> Column:
    """Symbols to expect of a code base of that size."""
    return F.when(size_kb.isNull() | (size_kb == 0), 12).when(size_kb < 500, 8).when(size_kb < 5000, 15).when(size_kb < 50000, 30).otherwise(50)


def reuse(licence_ok: Column, licence_known: Column, abandoned: Column, kind: Column, kind_confidence: Column, copyleft: Column, open_source: Column, stack: Column, architecture: Column, licence: Column) -> Column:
    """struct(verdict, confidence) by the first gate that closes: licence, age, kind, copyleft, stack, then how much is to adapt."""
    gate = lambda verdict, confidence: F.struct(F.lit(verdict).alias("verdict"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))
    direct = F.least(F.lit(0.95), (licence + stack + architecture) / 3.0 + 0.15)
    return (
        F.when(licence_known & ~licence_ok, gate("DO_NOT_USE", 0.95))
        .when(~licence_known, gate("REFERENCE_ONLY", 0.9))
        .when(abandoned, gate("REFERENCE_ONLY", 0.8))
        .when(kind.isin("application", "example") & (kind_confidence >= 0.4), gate("REFERENCE_ONLY", kind_confidence))
        .when(kind.isin("mixed", "unknown"), gate("ADAPT", 0.6))
        .when(copyleft & ~open_source, gate("REFERENCE_ONLY", 0.8))
        .when(stack < 0.35, gate("REFERENCE_ONLY", 0.85))
        .when((architecture < 0.55) | (stack < 0.7), gate("ADAPT", 0.75))
        .otherwise(gate("DIRECT_REUSE", half_up(direct, 2)))
    )


def reusability(library_points: Column, application_points: Column, signals: Column, example: Column) -> Column:
    """struct(kind, score, confidence): one side has to have twice the points of the other."""
    none = (library_points == 0) & (application_points == 0)
    kind = F.when(none, "unknown").when(library_points >= 2 * application_points, "library").when((application_points >= 2 * library_points) & example, "example").when(application_points >= 2 * library_points, "application").otherwise("mixed")
    score = F.when(kind == "library", 1.0).when(kind == "mixed", 0.6).when(kind == "example", 0.2).when(kind == "application", 0.15).otherwise(0.5)
    confidence = F.when(signals == 0, 0.1).otherwise(F.least(F.lit(0.9), 0.35 + 0.15 * signals))
    return F.struct(kind.alias("kind"), score.alias("score"), half_up(confidence, 2).alias("confidence"))


def readme_quality(readme: Column) -> Column:
    """What a readme covers: length, code, how to install and to use it, structure; null is no readme."""
    has = lambda p: readme.rlike(p).cast("double")
    points = (
        0.2 * (F.length(readme) > 400).cast("double") + 0.15 * (F.length(readme) > 2000).cast("double") + 0.25 * has("```")
        + 0.2 * has(r"(?i)#{1,3}\s*(install|installation|getting started|setup|quick ?start)") + 0.15 * has(r"(?i)#{1,3}\s*(usage|example|api|documentation)")
        + 0.05 * (F.regexp_count(readme, F.lit(r"(?m)^#{1,6}\s")) >= 3).cast("double")
    )
    return F.when(readme.isNull() | (readme == ""), 0.0).otherwise(clamp01(points))


def quality_score(tests: Column, ci: Column, readme: Column, docs: Column, changelog: Column, contributing: Column, releases: Column, stars: Column, days: Column, archived: Column) -> Column:
    """0 to 100, whole: tests, CI, readme, documents, releases; popularity adds ten at most; age and archives take away."""
    points = (
        F.when(tests > 0, F.least(F.lit(25), 10 + tests)).otherwise(0) + 15 * _as(ci) + 15 * readme + 8 * _as(docs) + 5 * _as(changelog) + 2 * _as(contributing)
        + F.least(F.lit(10), releases) + F.least(F.lit(10.0), 2.5 * F.log10(stars + 1))
        + F.when(archived, -25).when(days <= 90, 10).when(days <= 365, 5).when(days > 730, -10).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(points + 0.5))).cast("long")


def difficulty(efforts: Column, penalty: Column) -> Column:
    """Band of the summed efforts (small 1, moderate 2, large 4) and a penalty for a foreign stack."""
    total = F.aggregate(efforts, F.lit(0.0), lambda t, e: t + F.when(e == "small", 1.0).when(e == "moderate", 2.0).when(e == "large", 4.0).otherwise(0.0)) + penalty
    return F.when(total <= 1, "trivial").when(total <= 3, "easy").when(total <= 6, "moderate").when(total <= 10, "hard").otherwise("very-hard")


# Words of a name that tell what shape of thing a symbol is.
ROLE = r"(?i)\b(manager|coordinator|controller|service|engine|worker|handler|queue|scheduler|client|repository|store|session|policy|strategy|state|machine)\b"
TEST_PLACE = r"(?i)(^|/)(test|tests|spec|specs|__tests__|androidTest|testing)/|(^|/)(test_[^/]+|[^/]+_test)\.\w+$|\.(test|spec)\.\w+$"
# Files that implement nothing, and names that are infrastructure, each with the reason, the first that fits.
NOISE_PATHS = (
    (r"(?i)(^|/)\.github/", "CI configuration, not implementation"),
    (r"(?i)(^|/)\.(gitlab-ci|circleci|travis|drone)", "CI configuration, not implementation"),
    (r"(?i)\.(ya?ml|json|toml|ini|cfg|conf|lock|properties|gradle|xml|plist)$", "configuration file, not implementation"),
    (r"(?i)(^|/)(docs?|documentation|website|examples?|samples?|demos?|fixtures?|benchmarks?)/", "documentation or example, not implementation"),
    (r"(?i)\.(md|rst|txt|adoc|html|css|scss)$", "documentation or markup, not implementation"),
    (r"(?i)(^|/)(node_modules|vendor|third_party|dist|build|target|\.venv)/", "vendored or generated code"),
    (r"(?i)(^|/)(sample|samples|sampleapp|demo|demos|example|examples|playground)([A-Z]|/|$)", "sample or demo module, not the library"),
    (r"(?i)(^|/)[A-Za-z]*(Strings|Constants?|Consts?|Messages|ErrorCodes|Keys|Defaults)\.\w+$", "string/constant table, not behaviour"),
    (TEST_PLACE, "a test"),
)
CONSTANT = "a constant: it names something and does nothing"
NOISE_NAMES = (
    (r"(?i)\b(logger|logging|log)\b", "logging infrastructure"), (r"(?i)\b(analytics|telemetry|tracking|metrics)\b", "analytics/telemetry"), (r"(?i)\b(mapper|converter|adapter|dto|transformer)\b", "data mapping boilerplate"),
    (r"(?i)\b(constants?|config|settings|properties)\b", "configuration constants"), (r"(?i)\b(util|utils|helper|helpers|extensions?)\b", "generic utilities"), (r"(?i)\b(exception|error)\b", "error type"),
    (r"^(get|set|is|has)[A-Z]", "accessor"), (r"(?i)\b(builder|factory)\b", "construction boilerplate"),
)


def _role(name: Column) -> Column:
    from evidra.functions.text import split_identifier

    return split_identifier(name).rlike(ROLE)


def noise(name: Column, path: Column, kind: Column) -> Column:
    """Why a symbol is no implementation, or null. What its path says stands; what its name says doesn't if the name has a role, but for logging and tracking."""
    from evidra.functions.text import split_identifier

    words = split_identifier(name)
    always = words.rlike(r"(?i)\b(logger|logging|analytics|telemetry|tracking)\b")
    named = F.coalesce(*[F.when((name if p.startswith("^") else words).rlike(p), why) for p, why in NOISE_NAMES])
    constant = kind.isin("constant", "enum") | name.rlike("^[A-Z0-9_]{6,}$")
    return F.coalesce(
        *[F.when(path.rlike(p), why) for p, why in NOISE_PATHS],
        F.when(constant & ~_role(name), CONSTANT),
        F.when(~_role(name) | always, named),
    )


def structural_bonus(name: Column, path: Column, kind: Column) -> Column:
    return (
        F.when(_role(name), 0.15).otherwise(0.0) + F.when(kind.isin("class", "interface"), 0.1).otherwise(0.0) - F.when(kind.isin("constant", "enum"), 0.3).otherwise(0.0) - F.when(name.rlike("^[A-Z0-9_]{6,}$"), 0.3).otherwise(0.0)
        - F.when(path.rlike("(?i)(^|/)(test|tests|spec|__tests__|androidTest)/"), 0.45).otherwise(0.0) - F.when(path.rlike("(?i)(^|/)(example|examples|sample|samples|demo)/"), 0.35).otherwise(0.0)
    )


def symbol_score(terms: Column, name: Column, purpose: Column, path: Column, signature: Column, kind: Column, relevance: Column | None = None) -> Column:
    """Each term of three letters or more counts once, where it is found first: as a word of the name, in it, in purpose, path or signature; then what kind of symbol it is, and where. A relevance that an index gives counts 0.7."""
    from evidra.functions.text import split_identifier

    words = F.split(split_identifier(name), " ")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))

    def worth(t: Column) -> Column:
        return F.when(F.length(t) < 3, 0.0).when(F.array_contains(words, t), 0.35).when(F.contains(low(name), t), 0.25).when(F.contains(low(purpose), t), 0.12).when(F.contains(low(path), t), 0.10).when(F.contains(low(signature), t), 0.06).otherwise(0.0)

    bonus = structural_bonus(name, path, kind)
    own = clamp01(F.aggregate(terms, F.lit(0.0), lambda s, t: s + worth(F.lower(t))) + bonus)
    return own if relevance is None else F.when(relevance > 0, clamp01(relevance * 0.7 + bonus * 0.3)).otherwise(own)
