"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_text

#: Labelled rows that the classifier learns from at most (those with the least hash of their id).
MAX_TRAINING_ROWS = 12_000
TREES, DEPTH, SHRINK, BINS, LEAST_ROWS = 30, 3, 0.3, 32, 20
#: Weight of the lasso, and its steps.
PENALTY, STEPS = 0.0015, 250
_FUNCTION_WORDS = "the of and to in is that for with on de la le les et des en un une der die das und ist nicht ein zu el los las que por con una"
STATISTICS = (
    "chars", "words", "word_chars", "distinct_words", "long_words", "lines", "distinct_lines", "line_words", "digits", "upper", "symbols", "marks", "stops",
    "function_words", "wide", "runs", "capital_words", "one_letter",
)


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text; each is defined (0) for the empty one."""
    return {
        "chars": F.length(text),
        "words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")) / F.greatest(F.size("_words"), F.lit(1)),
        "distinct_words": F.size(F.array_distinct("_words")) / F.greatest(F.size("_words"), F.lit(1)),
        "long_words": F.size(F.filter("_words", lambda w: F.length(w) > 14)) / F.greatest(F.size("_words"), F.lit(1)),
        "lines": F.size("_lines"),
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "line_words": F.size("_words") / F.greatest(F.size("_lines"), F.lit(1)),
        "digits": _share(text, "[0-9]"),
        "upper": _share(text, r"\p{Lu}"),
        "symbols": _share(text, r"[#$%&*+/<=>@\\^_`|~{}\[\]]"),
        "marks": _share(text, "[,;:'\"()-]"),
        "stops": F.regexp_count(text, F.lit("[.!?]")) / F.greatest(F.size("_words"), F.lit(1)),
        "function_words": F.regexp_count(F.lower(text), F.lit(r"(?<![\p{L}])(?:" + "|".join(_FUNCTION_WORDS.split()) + r")(?![\p{L}])")) / F.greatest(F.size("_words"), F.lit(1)),
        "wide": _share(text, r"[^\x00-\x7F]"),
        "runs": _share(text, r"(.)\1\1"),
        "capital_words": F.size(F.filter("_words", lambda w: w.rlike(r"^\p{Lu}{2,}"))) / F.greatest(F.size("_words"), F.lit(1)),
        "one_letter": F.size(F.filter("_words", lambda w: F.length(w) == 1)) / F.greatest(F.size("_words"), F.lit(1)),
    }


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def measured(docs: DataFrame, text: str) -> DataFrame:
    """docs with a struct column _s of the statistics of column text."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    got = docs.withColumn("_words", words).withColumn("_lines", lines)
    return got.withColumn("_s", F.struct(*[c.cast("double").alias(n) for n, c in statistics(F.col(text)).items()])).drop("_words", "_lines")


# ---------------------------------------------------------------- learning, on the driver

Rule = tuple[tuple[int, float, bool], ...]  # (statistic, bound, whether above it)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, each from the root to every node below it."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        level = [(np.arange(len(y)), ())]
        for _ in range(DEPTH):
            after = []
            for rows, path in level:
                best = None
                g, h = grad[rows].sum(), hess[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k)
                if best is None:
                    margin[rows] += SHRINK * g / (h + 1)
                    continue
                _, j, k = best
                low = binned[rows, j] <= k
                for side, above in ((rows[low], False), (rows[~low], True)):
                    longer = (*path, (j, float(edges[j][k]), above))
                    rules.setdefault(tuple(sorted(longer)))
                    after.append((side, longer))
            level = after
        for rows, _ in level:
            margin[rows] += SHRINK * grad[rows].sum() / (hess[rows].sum() + 1)
    return list(rules)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for j, bound, above in rule:
            out[:, k] *= (x[:, j] > bound) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, weights) of logistic regression with an L1 penalty, by accelerated proximal steps."""
    n, k = z.shape
    w, v, b, vb, t = np.zeros(k, np.float32), np.zeros(k, np.float32), 0.0, 0.0, 1.0
    start = np.random.default_rng(0).normal(size=k).astype(np.float32)
    for _ in range(20):  # power iteration: the step is one over the greatest curvature
        start = z.T @ (z @ start)
        start /= np.linalg.norm(start) + 1e-12
    step = 1.0 / (0.25 * (np.linalg.norm(z @ start) ** 2 / n + 1) + 1e-9)
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        moved = v - step * (z.T @ r.astype(np.float32)) / n
        nw = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        nb = vb - step * r.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


class RuleEnsemble:
    """Weighted rules; expression() is its score as a Spark column over _s."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            return cls(float(3 if len(y) and y[0] else -3) if len(y) else 0.0, [])
        rules = tree_rules(x, y)
        if not rules:
            return cls(float(np.log(y.mean() / (1 - y.mean()))), [])
        intercept, weights = lasso(holds(rules, x), y)
        return cls(intercept, [(r, round(float(w), 6)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4])

    def expression(self) -> Column:
        total = F.lit(round(self.intercept, 6))
        for rule, weight in self.rules:
            test = None
            for j, bound, above in rule:
                value = F.col(f"_s.{STATISTICS[j]}")
                part = value > bound if above else value <= bound
                test = part if test is None else test & part
            total = total + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """An ensemble from the labelled rows that aren't held out.

    Of those with a label, MAX_TRAINING_ROWS at most are taken, in order of a hash of their id: that
    bounds what is broadcast to find their texts; so many distinct rows at most reach the driver. Null labels and labels of
    unknown ids teach nothing; with no label every text scores 0.5.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y is not null").filter(~held_out(F.col("_id")))
    chosen = cut(known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(MAX_TRAINING_ROWS))
    texts = id_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    # rows that are the same teach once, and there are no more of them than labels, whatever rows an id has
    distinct = measured(texts, "text").select("id", "_y", "_s.*").distinct()
    rows = distinct.orderBy(F.xxhash64(*distinct.columns), *distinct.columns).limit(MAX_TRAINING_ROWS).collect()
    data = np.array(sorted(tuple(r) for r in rows), float).reshape(len(rows), 2 + len(STATISTICS))
    return RuleEnsemble.fit(data[:, 2:], data[:, 1])


def scored(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", name: str = "_score") -> DataFrame:
    """docs with a column name from 0 to 1: how likely the label 1 is; a projection, nothing is shuffled.

    Null text counts as empty and has a score like any other; ids are not read; repeated rows score
    alike; an empty table gives an empty result; other columns (but those of name and _text, _s,
    which are replaced) pass through.
    """
    got = measured(docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))), "_text")
    return got.withColumn(name, model.expression()).drop("_text", "_s")


def op8_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = scored(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
