"""Phrases in texts against a look at each pair."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from evidra.functions.text import contains_phrase
from evidra.operators import containment


def rows(seed=3):
    rng = random.Random(seed)
    letters = "abcde é\n"
    texts = [(k % 2, "".join(rng.choices(letters, k=rng.choice((0, 2, 10, 60, 300)))), k) for k in range(80)] + [(0, None, 99), (0, "common " * 50, 100)]
    phrases = [(f, "".join(rng.choices(letters[:6], k=rng.choice((1, 2, 3, 4, 5))))) for f in (0, 1) for _ in range(120)] + [(0, "mon com"), (1, "absent!"), (0, "ab")]
    return texts, phrases


def test_parts_of_texts(spark):
    texts, phrases = rows()
    got = containment.contained(spark.createDataFrame(texts, "form int, s string, k int"), spark.createDataFrame(phrases, "form int, phrase string"), containment.grams, F.contains)
    want = {(k, f, p) for f, s, k in texts for g, p in phrases if f == g and s is not None and p in s}
    found = [(r["k"], r["form"], r["phrase"]) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_whole_words(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    texts = [(0, " ".join(rng.choices(words, k=rng.randint(1, 40))), k) for k in range(60)]
    phrases = [(0, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for _ in range(100)]
    got = containment.contained(spark.createDataFrame(texts, "form int, s string, k int"), spark.createDataFrame(phrases, "form int, phrase string"), containment.words, contains_phrase)
    want = {(k, p) for _, s, k in texts for _, p in phrases if f" {p} " in f" {s} "}
    assert {(r["k"], r["phrase"]) for r in got.collect()} == want


def test_no_phrases_and_no_texts(spark):
    texts, phrases = "form int, s string, k int", "form int, phrase string"
    empty = lambda schema: spark.createDataFrame([], schema)
    some = spark.createDataFrame([(0, "abc", 1)], texts)
    assert containment.contained(some, empty(phrases), containment.grams, F.contains).count() == 0
    assert containment.contained(empty(texts), spark.createDataFrame([(0, "abc")], phrases), containment.grams, F.contains).count() == 0


def test_names_within_names_of_an_entity_with_many(spark):
    from evidra.operators import verifying

    rng = random.Random(8)
    names = [(1, "".join(rng.choices("abcdefghij", k=rng.randint(4, 12)))) for _ in range(10_000)] + [(2, "room"), (2, "x")]
    wanted = [(1, names[5][1]), (1, names[6][1][1:4]), (1, names[7][1] + "-more"), (1, "zzzzz"), (2, "room-ktx"), (2, "hex"), (2, "abc"), (3, "room")]
    got = verifying.declared(spark.createDataFrame(wanted, "e int, n string"), "e", "n", spark.createDataFrame(names, "e int, t string"), "t").collect()
    want = {(e, n): any(n in t or t in n for f, t in names if f == e) for e, n in wanted}
    assert {(r["e"], r["n"]): r["present"] for r in got} == want


def test_across_words(spark):
    rng = random.Random(5)
    parts = ("a", "b", "ab", "ba", "abc", "é", "aé,b", ",", "cab", "bcaba")
    texts = [(k % 2, "".join(rng.choice(parts) + rng.choice((" ", "_", ". -", "\n", "")) for _ in range(rng.choice((0, 1, 3, 40)))), k) for k in range(60)] + [(0, None, 99), (1, " ab - c a b ", 100)]
    phrases = sorted({(f, "".join(rng.choices("abc", k=rng.randint(4, 9)))) for f in (0, 1) for _ in range(150)})
    got = containment.across(spark.createDataFrame(texts, "form int, s string, k int"), spark.createDataFrame(phrases, "form int, phrase string"))
    squash = re.compile(r"[\s_.\-]+")

    def over(s, p):  # some place of p in the text without separators goes over the end of a word
        ends = set(itertools.accumulate(len(w) for w in squash.split(s)))
        whole = squash.sub("", s)
        return any(whole.startswith(p, i) and any(i < e < i + len(p) for e in ends) for i in range(len(whole)))

    want = {(k, f, p) for f, s, k in texts for g, p in phrases if f == g and s is not None and over(s, p)}
    assert {(r["k"], r["form"], r["phrase"]) for r in got.collect()} == want and len(want) > 100
    assert containment.across(spark.createDataFrame(texts, "form int, s string, k int"), spark.createDataFrame(phrases, "form int, phrase string").limit(0)).count() == 0
