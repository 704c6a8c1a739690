"""Small document tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("th", "re", "on", "ti", "es", "an", "qu", "é") for b in ("e", "ing", "ion", "at", "ou", "er", "ly")]


def prose(rng: random.Random, words: int) -> str:
    out = []
    for k in range(words):
        out.append(rng.choice(VOCABULARY) + (".\n" if rng.random() < 0.08 and k < words - 1 else ""))
    return " ".join(out).replace("\n ", "\n")


def documents(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice((3, 20, 60, 200))) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5].replace(" ", "\t\n ", 3), texts[8].upper(), texts[10] + " extra", texts[11][: len(texts[11]) // 2] + texts[12]]
    texts += ["", None, None, " \n\t ", "one", "one two", "x" * 3000, "word " * 3000, "日本語 🎉\x00 ​ end", "\n".join(["same line of words that repeats itself over and over"] * 6)]
    rows = [(k * 3 if k % 5 else k * 3 - 1, t, rng.choice(("en", "fr", None)), rng.choice(("a", "b", "hot", "hot", None)), len(t) if t else None) for k, t in enumerate(texts)]
    return rows + [rows[4], (rows[6][0], "another text under the same id", "en", "b", 1), (None, texts[3], None, None, None), (None, "no id", "en", "a", 5)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def clashing(df):
    """df with columns named like those that operators make."""
    from pyspark.sql import functions as F

    for name in ("id", "h", "fp", "key", "path", "keep_id", "kept", "component", "digest", "count", "n", "term", "ids", "spans", "score", "words", "i", "a", "b", "v", "label"):
        df = df.withColumn(name, F.lit(1))
    return df
