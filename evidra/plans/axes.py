"""Queries about scores of one entity and what kind of thing it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import scores as sc
from evidra.operators import verifying
from evidra.plans.reads import _at, _pick
from evidra.sources.tables import table


def _n() -> Column:
    return F.col("p_size")


def _whole(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("long")


def quality_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of a part as a repository, in hundredths: its size stands for what is counted."""
    yes = lambda k: _n() % k == 0
    checklist = sc.completeness_axis(_n() % 4, _n() % 3, _n() % 8)
    fit = sc.architecture_axis(F.when(yes(2), _n() / 50.0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", _whole(sc.implementation_quality(yes(2), _n() % 7, yes(3), yes(5), yes(4), F.lit(True))).alias("quality"), _whole(sc.test_evidence(_n() > 5, _n())).alias("tests"), _whole(sc.documentation((_n() % 11) / 10.0, yes(3), yes(4))).alias("documentation"),
        _whole(sc.popularity(F.col("p_partkey"))).alias("popularity"), _whole(sc.dependency_simplicity(_n())).alias("simplicity"), _whole(checklist["value"]).alias("completeness"), _whole(checklist["confidence"]).alias("sure"), _whole(fit["value"]).alias("fit"),
    )


def surface_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = sc.integration_surface(_n(), _n() % 25, _n() % 12, _n() % 9, (_n() % 5) / 10.0)
    kind = sc.reusability(_n() % 4, _n() % 3, _n() % 3, _n() % 2 == 0)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", surface.alias("s"), kind.alias("k"))
    return rows.select("p_partkey", _whole(sc.surface_axis(F.col("s"))["value"]).alias("surface"), F.col("s.difficulty").alias("difficulty"), F.col("k.kind").alias("kind"), _whole(sc.reusability_axis(F.col("k"))["value"]).alias("reusability"), _whole(sc.reusability_axis(F.col("k"))["confidence"]).alias("sure"), sc.size_proxy(F.col("p_size") * 2000).cast("long").alias("proxy"))


def relevance_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark-like terms against parts: type as topic, name as name, brand as body."""
    arr = lambda *xs: F.array(*map(F.lit, xs))
    value = sc.feature_relevance(arr("brown", "steel", "tiny", "prom", "brand"), F.array("p_type"), F.col("p_name"), F.concat(F.col("p_brand"), F.lit(" acme")), F.array(_pick(_n(), "acme", "brown", "zzz")), F.array(_pick(_n(), "red", "qqq")))
    return table(spark, sf_dir, "part").select("p_partkey", _whole(value).alias("relevance"))


LANGUAGES = ("Kotlin", "Java", "TypeScript", "Go", None)


def stack_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.coalesce(*[F.when(F.pmod("s_suppkey", F.lit(5)) == k, v) for k, v in enumerate(LANGUAGES) if v])
    none = F.expr("cast(array() as array<string>)")
    wanted = F.when(F.col("s_nationkey") > 12, F.array(F.lit("compose"), F.lit("room"))).otherwise(none)
    value = sc.stack_match(lang, _pick(F.col("s_nationkey"), "kotlin", "javascript", "rust"), F.array(F.lit("Rust")), F.array(F.lit("room")), wanted)
    return table(spark, sf_dir, "supplier").select("s_suppkey", _whole(value).alias("stack"))


def reuse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _pick(_n(), "library", "application", "mixed", "library", "unknown")
    got = sc.reuse(_n() % 11 != 0, _n() % 7 != 0, _n() % 13 == 0, kind, F.lit(0.5), _n() % 17 == 0, F.lit(False), _n() / 50.0, (50 - _n()) / 50.0, F.lit(0.9))
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("r")).select("p_partkey", F.col("r.verdict").alias("verdict"), _whole(F.col("r.confidence")).alias("confidence"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = lambda k: _n() % k == 0
    readme = F.concat(F.repeat(F.lit("# Install\n```x```\n## Usage\n### More\n"), _n() % 3), F.repeat(F.lit("words "), 40 * (_n() % 9)))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", sc.readme_quality(readme).alias("readme"))
    return rows.select("p_partkey", _whole(F.col("readme")).alias("readme"), sc.quality_score(_n() % 30, yes(2), F.col("readme"), yes(3), yes(4), yes(5), _n() % 12, F.col("p_partkey"), _n() * 20, yes(9)).alias("score"))


def fit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the names of a brand's parts fit a few terms, and how far tests named so are about them."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), _pick(_n(), "", " Manager", " Queue")))).alias("names"))
    terms = F.array(*map(F.lit, ("steel", "Brown", "tiny", "abc", "qqqq")))
    return rows.select("p_brand", _whole(verifying.architecture_fit(F.col("names"), terms)).alias("fit"), _whole(verifying.feature_test_confidence(terms, F.size("names") % 3, F.slice("names", 1, 4), F.array_join("names", " "))).alias("tests"))



QUERIES = {f.__name__: f for f in (quality_axes, surface_axes, relevance_axis, stack_axis, reuse_verdicts, quality_scores, fit_scores)}


def _c(x: str) -> str:
    return f"(floor(greatest(0e0, least(1e0, {x})) * 100e0 + 0.5e0) / 100e0)"


def _w(x: str) -> str:
    return f"cast(floor({x} * 100e0 + 0.5e0) as bigint)"


def _b(k: int) -> str:
    return f"(case when p_size % {k} = 0 then 1e0 else 0e0 end)"


def _ramp(x: str, low: int, high: int) -> str:
    return f"(case when {x} <= {low} then 1e0 when {x} >= {high} then 0e0 else floor((1 - ({x} - {low}) / ({high}e0 - {low}e0)) * 100e0 + 0.5e0) / 100e0 end)"


_HIT = lambda t, where: f"case when contains({where}, '{t}') then 1 else 0 end"
_TERMS = ("brown", "steel", "tiny", "prom", "brand")
SQL = {
    "quality_axes": f"""select p_partkey, {_w(_c(f"0.30e0 * {_b(2)} + 0.25e0 * least(1e0, (p_size % 7) / 5e0) + 0.20e0 * greatest({_b(3)}, 0.5e0) + 0.10e0 * {_b(5)} + 0.15e0 * {_b(4)}"))} as quality,
        {_w(f"case when p_size > 5 then {_c('0.35e0 + least(0.65e0, p_size / 25e0 * 0.65e0)')} else 0.05e0 end")} as tests, {_w(_c(f"0.6e0 * ((p_size % 11) / 10e0) + 0.25e0 * {_b(3)} + 0.15e0 * {_b(4)}"))} as documentation,
        {_w(_c("log10(p_partkey + 1) / 4.5e0"))} as popularity, {_w(f"case when p_size <= 3 then 1e0 else {_c('1 - log10(p_size / 3e0) / log10(20e0)')} end")} as simplicity,
        case when p_size % 8 > p_size % 3 then {_w(_c("(p_size % 4) / cast(p_size % 8 - p_size % 3 as double)"))} end as completeness,
        case when p_size % 8 > p_size % 3 then {_w(_c("0.4e0 + 0.5e0 * ((p_size % 8 - p_size % 3) / cast(p_size % 8 as double))"))} end as sure,
        case when p_size % 2 = 0 then {_w(_c("p_size / 50e0"))} end as fit from part""",
    "surface_axes": f"""with s as (select p_partkey, p_size, floor((0.22e0 * {_ramp('p_size', 6, 40)} + 0.24e0 * {_ramp('p_size % 25', 2, 20)} + 0.16e0 * {_ramp('p_size % 12', 1, 10)} + 0.10e0 * {_ramp('p_size % 9', 0, 8)} + 0.28e0 * (1 - (p_size % 5) / 10e0)) * 100e0 + 0.5e0) / 100e0 as s,
        case when p_size % 4 = 0 and p_size % 3 = 0 then 'unknown' when p_size % 4 >= 2 * (p_size % 3) then 'library' when p_size % 3 >= 2 * (p_size % 4) then case when p_size % 2 = 0 then 'example' else 'application' end else 'mixed' end as kind from part)
        select p_partkey, {_w(_c('s'))} as surface, case when s >= 0.85e0 then 'trivial' when s >= 0.68e0 then 'low' when s >= 0.45e0 then 'medium' when s >= 0.25e0 then 'high' else 'very-high' end as difficulty, kind,
               cast(case kind when 'library' then 100 when 'mixed' then 60 when 'example' then 20 when 'application' then 15 end as bigint) as reusability, case when kind <> 'unknown' then cast(case p_size % 3 when 0 then 10 when 1 then 50 else 65 end as bigint) end as sure,
               cast(case when p_size = 0 then 12 when p_size * 2000 < 500 then 8 when p_size * 2000 < 5000 then 15 when p_size * 2000 < 50000 then 30 else 50 end as bigint) as proxy from s""",
    "relevance_axis": f"""with t as (select p_partkey, p_size, lower(p_type) as topic, lower(p_name) as name, lower(p_brand) || ' acme' as body, {_at('p_size', 'acme', 'brown', 'zzz')} as product, {_at('p_size', 'red', 'qqq')} as excluded from part),
        s as (select *, least(0.45e0, 0.18e0 * ({' + '.join(_HIT(t, 'topic') for t in _TERMS)})) + least(0.35e0, 0.12e0 * ({' + '.join(_HIT(t, 'name') for t in _TERMS)})) + least(0.30e0, 0.06e0 * ({' + '.join(_HIT(t, 'body') for t in _TERMS)})) as points, topic || ' ' || name as declared from t)
        select p_partkey, {_w(_c("points * case when contains(declared, product) then 1e0 when contains(body, product) then 0.6e0 else 0.35e0 end * case when contains(declared, excluded) then 0.2e0 else 1e0 end"))} as relevance from s""",
    "stack_axis": f"""with l as (select s_suppkey, s_nationkey, [['kotlin'], ['java'], ['typescript'], ['go'], [null]][s_suppkey % 5 + 1][1] as own, {_at('s_nationkey', 'kotlin', 'javascript', 'rust')} as goal from supplier)
        select s_suppkey, {_w(_c("0.75e0 * case when own = goal then 1e0 when (own = 'java' and goal = 'kotlin') or (own = 'typescript' and goal = 'javascript') then 0.6e0 when goal = 'rust' then 0.45e0 else 0.1e0 end + 0.25e0 * 0.5e0"))} as stack from l""",
    "reuse_verdicts": f"""with k as (select *, p_size % 7 <> 0 as known, {_at('p_size', 'library', 'application', 'mixed', 'library', 'unknown')} as kind from part),
        v as (select p_partkey, p_size, case when known and p_size % 11 = 0 then 'DO_NOT_USE95' when not known then 'REFERENCE_ONLY90' when p_size % 13 = 0 then 'REFERENCE_ONLY80' when kind = 'application' then 'REFERENCE_ONLY50' when kind in ('mixed', 'unknown') then 'ADAPT60' when p_size % 17 = 0 then 'REFERENCE_ONLY80'
              when p_size / 50e0 < 0.35e0 then 'REFERENCE_ONLY85' when (50 - p_size) / 50e0 < 0.55e0 or p_size / 50e0 < 0.7e0 then 'ADAPT75' end as v from k)
        select p_partkey, coalesce(v[:-3], 'DIRECT_REUSE') as verdict, coalesce(cast(v[-2:] as bigint), {_w("floor(least(0.95e0, (0.9e0 + p_size / 50e0 + (50 - p_size) / 50e0) / 3e0 + 0.15e0) * 100e0 + 0.5e0) / 100e0")}) as confidence from v""",
    "quality_scores": f"""with r as (select p_partkey, p_size, 36 * (p_size % 3) + 240 * (p_size % 9) as n, p_size % 3 > 0 as coded, p_size % 3 as times from part),
        q as (select *, case when n = 0 then 0e0 else {_c("0.2e0 * cast(n > 400 as int) + 0.15e0 * cast(n > 2000 as int) + 0.25e0 * cast(coded as int) + 0.2e0 * cast(coded as int) + 0.15e0 * cast(coded as int) + 0.05e0 * cast(coded as int)")} end as readme from r)
        select p_partkey, {_w('readme')} as readme, cast(greatest(0, least(100, floor(case when p_size % 30 > 0 then least(25, 10 + p_size % 30) else 0 end + 15 * {_b(2)} + 15 * readme + 8 * {_b(3)} + 5 * {_b(4)} + 2 * {_b(5)} + least(10, p_size % 12) + least(10e0, 2.5e0 * log10(p_partkey + 1))
            + case when p_size % 9 = 0 then -25 when p_size * 20 <= 90 then 10 when p_size * 20 <= 365 then 5 when p_size * 20 > 730 then -10 else 0 end + 0.5e0))) as bigint) as score from q""",
    "fit_scores": f"""with b as (select p_brand, list_sort(list(distinct replace(p_name, ' ', '_') || {_at('p_size', '', ' Manager', ' Queue')})) as names from part group by 1),
        c as (select *, list_transform(names, lambda n: lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))) as low, lower(array_to_string(names, ' ') || ' ' || array_to_string(names[1:4], ' ')) as text from b),
        d as (select *, len(list_filter(['steel', 'brown', 'tiny', 'qqqq'], lambda t: len(list_filter(low, lambda n: contains(n, t))) > 0)) as covered, len(list_filter(low, lambda n: regexp_matches(n, '\\b(manager|queue)\\b'))) as structured, len(list_filter(['steel', 'brown', 'tiny', 'qqqq'], lambda t: contains(text, t))) as met from c)
        select p_brand, {_w("floor(least(1e0, covered / 4e0 * 0.7e0 + least(1e0, structured / greatest(3e0, len(names) * 0.2e0)) * 0.3e0) * 100e0 + 0.5e0) / 100e0")} as fit,
               {_w("floor(least(1e0, met / 4e0 * case when len(names) % 3 > 0 then 1e0 else 0.7e0 end + case when met > 0 then 0.15e0 else 0e0 end) * 100e0 + 0.5e0) / 100e0")} as tests from d""",
}
