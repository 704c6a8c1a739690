"""Near-duplicates of the pipeline against brute force on sets of five-word shingles."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from evidra.llm import near_sets, simhash
from tests.llm import rows as R


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, least.get(root(k))) for k, (i, *_) in enumerate(rows)), key=str)


def edited(seed=5):
    """Texts with copies in which more and more words are others, so that similarities lie on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for k in range(12):
        words = R.prose(rng, rng.choice((12, 60, 300))).split()
        for edits in range(7):
            copy = list(words)
            for _ in range(edits * len(words) // 150 + (edits > 0)):
                copy[rng.randrange(len(copy))] = f"other{rng.random()}"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    for n in (500, 520, 1030, 3000):  # maps of several sizes, and sets on both sides of a step between two
        words = [f"q{n}x{x}" for x in range(n)]
        rows += [(len(rows) + k, " ".join(words[: n - cut] + [f"z{n}"] * add), "en", "s", 0) for k, (cut, add) in enumerate(((0, 0), (n // 20, 0), (0, 1), (n // 6, 0), (n // 3, 0)))]
    passage = " ".join(f"w{x}" for x in range(40))
    return rows + [(1000 + k, f"{passage} {R.prose(rng, 30 if k % 2 else 5)}", "en", "s", 0) for k in range(30)]


def test_equals_brute_force(spark):
    rows = edited() + [(i + 5000 if i is not None else None, *rest) for i, *rest in R.documents()]
    got = near_sets.near_duplicates(R.clashing(R.frame(spark, rows))).collect()
    assert sorted(((r["id"], r["component"]) for r in got), key=str) == brute(rows)


def test_levels_tell_frequencies(spark):
    rows = spark.createDataFrame([("a b c d e f",), ("a b c d e g",), ("a b c d e a b c d e",), ("",), ("x",)], "text string")
    levels = near_sets.Levels(near_sets.frequency_levels(rows, 5), near_sets.SLOTS)
    level = lambda text: int(levels.of(simhash.shingle_hashes(text, 5)[:1])[0])
    assert [level("a b c d e"), level("b c d e f"), level("x"), level("not there at all x")] == [3, 1, 1, 0]
    assert np.count_nonzero(levels.table) == 8


def test_a_table_of_few_slots_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "SLOTS", 1 << 16)
    monkeypatch.setattr(near_sets, "ROW_SLOTS", 1 << 10)
    monkeypatch.setattr(near_sets, "MOST_GATHERED", 100)
    rows = edited(6)
    got = near_sets.near_duplicates(R.frame(spark, rows)).collect()
    assert sorted(((r["id"], r["component"]) for r in got), key=str) == brute(rows)


def test_the_stage_drops_edited_copies(spark, sf_dir):
    words = [f"w{k}" for k in range(300)]
    copy = ["other" if k in (50, 120, 190, 260) else w for k, w in enumerate(words)]  # similarity 276 / 316
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(copy), "en", "s", 0), (3, " ".join(words[150:]), "en", "s", 0)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, R.frame(spark, rows), sf_dir).collect()) == [1, 3]


def test_texts_under_one_id_are_judged_on_their_own(spark, sf_dir):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words), "en", "s", 0), (5, " ".join(words[::-1]), "en", "s", 0), (5, " ".join(words) + " end", "en", "s", 0), (7, None, None, None, None), (7, "", None, None, 0), (None, "", None, None, 0)]
    got = [tuple(r)[:2] for r in corpus_pipeline.near_copies(spark, R.clashing(R.frame(spark, rows)), sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(1, rows[0][1]), (5, rows[1][1]), (7, None), (7, "")], key=str)


def test_empty_table(spark):
    assert near_sets.near_duplicates(R.frame(spark, [])).count() == 0
