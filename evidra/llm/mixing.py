"""Mixing sources: temperature weights by bisection, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.operators.lineage import numbered

from .common import cut, documents

#: Entropy of the weights to reach, as a share of the entropy of equal weights; the most often a source may be repeated; tokens to give, as a share of all there are.
ENTROPY_SHARE, MAX_REPEATS, BUDGET_SHARE = 0.95, 4.0, 1.0
#: Tokens of a block, and blocks of a source at most (which bounds the table of blocks).
BLOCK_TOKENS, MAX_BLOCKS = 100_000, 4096
#: A table of more sources than this is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000
#: A table of more block placements than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000
SEED = 42


def weights_at(shares: dict, power: float, times: dict | None = None) -> dict:
    """Normalised powers of shares; times tells how many sources have a share (one, if it isn't given)."""
    raw = {s: p**power if p > 0 else 0.0 for s, p in shares.items()}
    total = math.fsum(r * _times(times, s) for s, r in raw.items()) or 1.0
    return {s: r / total for s, r in raw.items()}


def _times(times: dict | None, source) -> int:
    return times[source] if times else 1


def entropy(weights: dict, times: dict | None = None) -> float:
    return -math.fsum(w * math.log(w) * _times(times, s) for s, w in weights.items() if w > 0)


def bisect_power(shares: dict, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_share: float = BUDGET_SHARE, times: dict | None = None) -> float:
    """The exponent in [0, 1]: 1 keeps the shares, 0 makes them equal.

    Entropy falls and repeats fall as the exponent rises. The greatest exponent that reaches the
    entropy is taken; if a source would be repeated more than allowed, the least that allows it.
    """
    used = sum(_times(times, s) for s, p in shares.items() if p > 0)
    if used < 2:
        return 1.0
    goal = entropy_share * math.log(used)
    at = lambda power: weights_at(shares, power, times)
    repeats = lambda power: max(w / shares[s] for s, w in at(power).items() if shares[s] > 0) * budget_share

    def bisect(good_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good_low(mid) else (low, mid)
        return (low + high) / 2

    power = 1.0 if entropy(at(1.0), times) >= goal else bisect(lambda a: entropy(at(a), times) >= goal)
    if repeats(power) > max_repeats:
        power = 1.0 if repeats(1.0) > max_repeats else bisect(lambda a: repeats(a) > max_repeats)
    return power


def budgets(tokens: dict[int, int], weights: dict[int, float], total: int) -> tuple[dict[int, int], set[int], int]:
    """(whole tokens for each source with so many, those of which some get one more, how many of these do).

    tokens tells how many sources have a number of tokens. The budgets of all sources sum to total: largest remainders get
    what is left; of equal ones the first in order of their names. A source without tokens gets none.
    """
    exact = {t: w * total for t, w in weights.items() if t > 0}
    out = {t: int(x) for t, x in exact.items()}
    left = total - sum(n * tokens[t] for t, n in out.items())
    for _, equal in groupby(sorted(exact, key=lambda t: out[t] - exact[t]), key=lambda t: out[t] - exact[t]):
        some = set(equal)
        if left < sum(tokens[t] for t in some):
            return out, some, max(0, left)
        left -= sum(tokens[t] for t in some)
        for t in some:
            out[t] += 1
    return out, set(), 0


def planned(sources: DataFrame, entropy_share: float, max_repeats: float, budget_share: float) -> DataFrame:
    """(_src, _weight, _blocks, full, rest) for sources (_src, t): weight, blocks, whole epochs, tokens of the last one.

    Sources with the same number of tokens share weight and budget, so the exponent is bisected over the
    distinct numbers; of n tokens in all there are sqrt(2 n) at most, however many sources there are.
    """
    rows = sources.groupBy("t").count().collect()
    times = {r["t"]: r["count"] for r in rows}
    total = sum(t * n for t, n in times.items())
    shares = {t: t / total if total else 0.0 for t in times}
    weights = weights_at(shares, bisect_power(shares, entropy_share, max_repeats, budget_share, times), times)
    spend, some, more = budgets(times, weights, int(total * budget_share))
    made = [(t, weights[t], max(1, min(MAX_BLOCKS, -(-t // BLOCK_TOKENS))), spend.get(t, 0), t in some) for t in sorted(times)]
    known = sources.sparkSession.createDataFrame(made, "t long, _weight double, _blocks long, spend long, some boolean")
    got = sources.join(F.broadcast(known) if len(made) <= BROADCAST_SOURCES else known, "t")
    if more:
        first = numbered(got.filter("some").select("_src"), [F.col("_src")], "place").filter(F.col("place") <= more).select(F.col("_src").alias("s"))
        got = got.join(first, F.col("_src") == F.col("s"), "left").withColumn("spend", F.col("spend") + F.col("s").isNotNull().cast("long"))
    each = F.greatest(F.lit(1), F.col("t"))
    return cut(got.select("_src", "_weight", "_blocks", F.floor(F.col("spend") / each).cast("long").alias("full"), (F.col("spend") % each).cast("long").alias("rest")))


def few(rows: DataFrame, most: int) -> DataFrame:
    """rows, to be broadcast if they are no more than that; their number is looked at."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> DataFrame:
    """docs, each row as often as it is drawn, with _tokens, _weight, _epoch, _slot (the block's place in that epoch's permutation).

    Tokens are runs of characters between ASCII white space. A source's budget is first spent on
    whole epochs, each a permutation of its blocks; then on a last one, in which blocks are taken
    while they fit and the block that doesn't is taken by document, in a random order, while they
    fit. So a source misses its budget by less than one document. Placement depends on hashes of
    id and text alone.

    Only narrow counts are shuffled; texts stay where they are read while the table of blocks is
    small (it has MAX_BLOCKS rows for each source and epoch at most). There may be any number of sources.

    A null source is a source of its own; null texts have no tokens, and documents without tokens
    come with the block that they are in; null ids are kept; rows with the same id and text are
    drawn together; an empty table gives an empty result; other columns pass through, whatever
    their names (those named above are replaced).
    """
    added = ["_tokens", "_weight", "_epoch", "_slot"]
    names = [c for c in docs.columns if c not in added]
    if any(c.startswith("_") or c in ("end", "room") for c in names):  # names that are used below: other ones meanwhile
        safe = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
        at = {c: f"c{k}" for k, c in enumerate(names)}
        got = mix(safe, at[source_col], at[id_col], at[text_col], entropy_share, max_repeats, budget_share, seed)
        return got.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *added)
    src = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    placed = docs.withColumn("_src", src).withColumn("_u", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).withColumn("_tokens", token_count(F.col(text_col)))
    narrow = cut(placed.select("_src", "_u", "_tokens"))
    sources = planned(cut(narrow.groupBy("_src").agg(F.sum("_tokens").alias("t"))), entropy_share, max_repeats, budget_share)
    sources = few(sources, BROADCAST_SOURCES)

    block = F.pmod("_u", "_blocks")
    sized = narrow.join(sources, "_src").withColumn("_block", block)
    sums = cut(sized.groupBy("_src", "_block", "_weight", "full", "rest").agg(F.sum("_tokens").alias("t")))
    epochs = sums.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    order = Window.partitionBy("_src", "_epoch").orderBy(F.xxhash64(F.lit(seed), "_src", "_epoch", "_block"), "_block")
    ranked = epochs.withColumn("_slot", F.row_number().over(order) - 1).withColumn("upto", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole, last = F.col("_epoch") < F.col("full"), F.col("_epoch") == F.col("full")
    room = F.col("rest") - (F.col("upto") - F.col("t"))
    taken = ranked.withColumn("room", F.when(last & (F.col("upto") > F.col("rest")), room)).filter(whole | (last & (room > 0)))
    taken = cut(taken.select("_src", "_block", "_weight", "_epoch", "_slot", "room"))
    parts = few(taken.filter("room is not null").select("_src", "_block", "room"), BROADCAST_SOURCES)  # one block for each source
    inside = Window.partitionBy("_src", "_block").orderBy("_u")
    running = sized.select("_src", "_block", "_u", "_tokens").join(parts, ["_src", "_block"]).withColumn("upto", F.sum("_tokens").over(inside))
    ends = running.filter("upto <= room").groupBy("_src", "_block").agg(F.max("_u").alias("end"))
    least = F.lit(-(2**63)).cast("long")
    table = cut(taken.join(few(cut(ends), BROADCAST_SOURCES), ["_src", "_block"], "left").withColumn("end", F.when(F.col("room").isNotNull(), F.coalesce("end", least))))
    table = few(table, BROADCAST_ROWS)
    counts = sources.select("_src", "_blocks")
    got = placed.join(counts, "_src").withColumn("_block", block).drop("_blocks").join(table, ["_src", "_block"])
    got = got.filter(F.col("end").isNull() | ((F.col("_u") <= F.col("end")) & (F.col("end") > least)))
    return got.select(*names, *added)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return got.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_epoch").alias("epoch"), F.col("_slot").cast("long").alias("slot"))
