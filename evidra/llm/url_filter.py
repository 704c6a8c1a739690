"""URL filter: host and path rules first, then the ratio of two variable-order character models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path); a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Characters in a gram: a context of up to three and what follows it.
ORDER = 4
#: Pseudo-counts that a context takes from the next shorter one.
PRIOR = 4.0
#: Grams over the folded alphabet are few; beyond this many rows the model is joined by shuffle instead of broadcast.
BROADCAST_GRAMS = 200_000
#: Log ratios are held in integer millionths: sums don't depend on their order.
UNIT = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def split_url(url: Column) -> tuple[Column, Column]:
    rest = after_scheme(url)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    found = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def folded(url: Column) -> Column:
    """The url for the models: no scheme, lower case, digits as one symbol, rare characters as another, ends marked."""
    text = F.coalesce(after_scheme(url), url, F.lit(""))
    text = F.regexp_replace(F.regexp_replace(ascii_lower(text), "[0-9]", "0"), r"[^a-z0./?#=&%_:\-]", "~")
    return F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))


def grams(df: DataFrame, text: str) -> DataFrame:
    """A row for each place in text, with the gram that ends there."""
    places = F.explode(F.sequence(F.lit(1), F.length(text) - (ORDER - 1)))
    return df.select("*", places.alias("at")).withColumn("gram", F.substring(F.col(text), F.col("at"), F.lit(ORDER)))


def model(counted: DataFrame) -> DataFrame:
    """(gram, weight): the log ratio of the two smoothed models, from (gram, a, r) counts.

    Each order adds its counts to PRIOR times the shorter order's probability; a context that was
    never seen has no counts and so falls back to the longest one that was.
    """
    symbols = counted.agg(F.countDistinct(F.right("gram", F.lit(1)))).first()[0]
    even = F.lit(1.0 / max(1, symbols))
    out = counted.select("gram", even.alias("pa"), even.alias("pr"))
    for k in range(ORDER):
        part = counted.groupBy(F.right("gram", F.lit(k + 1)).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = part.groupBy(F.substring("g", 1, k).alias("x")).agg(F.sum("a").alias("xa"), F.sum("r").alias("xr"))
        out = out.withColumn("g", F.right("gram", F.lit(k + 1))).withColumn("x", F.substring("g", 1, k))
        out = out.join(part, "g", "left").join(context, "x", "left")
        for m in "ar":
            out = out.withColumn(f"p{m}", (F.col(m) + PRIOR * F.col(f"p{m}")) / (F.col(f"x{m}") + PRIOR))
        out = out.select("gram", "pa", "pr")
    return out.select("gram", F.round(F.log(F.col("pa") / F.col("pr")) * UNIT).cast("long").alias("weight"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, url, host, path, rule, verdict, score) for every row of pages.

    Urls that a rule decides teach the two models: allowed and blocked, all of them but a fifth
    (by crc32 of the url), on which the threshold is set where the two kinds are told apart best
    (equal weights). score is the mean log ratio per character; at or above the threshold is
    allow. With no allowed or no blocked url to learn from, every score is judged allow.

    Null urls and those without :// have empty host and path, fit no rule and are judged by the
    models as they are; null ids are kept; repeated rows give repeated rows; an empty table gives
    an empty result; further columns are not read. Grams of a url are summed where it is read:
    only the url and its sums are shuffled.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path")).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("held", F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(5)) == 0)
    taught = lambda v: F.sum(F.when(~F.col("held") & (F.col("hit.verdict") == v), 1).otherwise(0))
    text = rows.select("hit", "held", folded(F.col("url")).alias("t"))
    counted = cut(grams(text, "t").groupBy("gram").agg(taught("allow").alias("a"), taught("block").alias("r")))
    weights = cut(model(counted))
    weights = F.broadcast(weights) if weights.count() <= BROADCAST_GRAMS else weights
    placed = grams(rows.select("id", "url", folded(F.col("url")).alias("t")), "t").join(weights, "gram")
    summed = placed.groupBy("id", "url").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.sum((F.col("at") == 1).cast("int")).alias("copies"))
    scored = summed.select("id", "url", (F.col("w") / F.col("n") / UNIT).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("one")).drop("one")
    scored = cut(scored.withColumn("held", F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(5)) == 0))
    host, path = split_url(F.col("url"))
    scored = scored.withColumn("host", host).withColumn("path", path).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    level = threshold(scored)
    judged = F.when(F.col("score") >= level, "allow").otherwise("block") if level is not None else F.lit("allow")
    return scored.select("id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", judged).alias("verdict"), "score")


def threshold(scored: DataFrame) -> float | None:
    """The score at which held-out allowed and blocked urls part best; counts by hundredths, so at most 2001 rows are read."""
    held = scored.filter("held and hit is not null").groupBy(F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100))).alias("at"))
    count = lambda v: F.sum((F.col("hit.verdict") == v).cast("long"))
    rows = sorted(tuple(r) for r in held.agg(count("allow"), count("block")).collect())
    allowed, blocked = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not blocked:
        return None
    best, over, under = (allowed / allowed, 0.0, rows[0][0]), allowed, 0
    for i, (at, a, b) in enumerate(rows):
        over, under = over - a, under + b
        level = (rows[i + 1][0] + at + 1) / 2 if i + 1 < len(rows) else at + 1
        best = max(best, (over / allowed + under / blocked, -abs(level), level))
    return best[2] / 100


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")
