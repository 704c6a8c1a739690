"""Like names and components against brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from evidra.operators import clusters


def dice(a, b):
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    both = x.total() + y.total()
    return 2 * (x & y).total() / both if both else 0.0


def names(seed=4):
    rng = random.Random(seed)
    words = ["http", "client", "json", "parser", "mini", "fast", "aa", "core", "kit", "été"]
    out = ["-".join(rng.sample(words, rng.randint(1, 4))) + rng.choice(["", "2", "-js", "x"]) for _ in range(150)]
    return out + ["", "a", "b", "ab", "AB", "abc", "abab", "aaaa", "aaaaa", "aaaaaaaa", None]


@pytest.mark.parametrize("over", [0.4, 0.6, 0.85])
def test_like_names_are_all_pairs_above(spark, over):
    rows = [(k, "x" if k % 2 else "y", n) for k, n in enumerate(names())] + [(900, None, "http-client"), (901, "x", "http-client"), (902, "x", "HTTP-client")]
    got = clusters.dice_links(spark.createDataFrame(rows, "id int, owner string, name string"), "id", ["owner"], "name", over).collect()
    want = {}
    for owner in ("x", "y"):
        least = {}
        for i, o, n in rows:
            if o == owner and n is not None:
                least[n.lower()] = min(i, least.get(n.lower(), i))
        want |= {(owner, a, b, least[a], least[b]): dice(a, b) for a, b in combinations(sorted(least), 2) if dice(a, b) > over}
    assert {(r["owner"], r["name"], r["name2"], r["entity"], r["entity2"]): pytest.approx(r["score"]) for r in got} == want
    assert want


def test_few_pairs_are_compared(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrst"
    made = ["".join(rng.choices(letters, k=rng.randint(10, 30))) for _ in range(400)]
    rows = [(k, "awesome-" + n) for k, n in enumerate(made)] + [(1000 + k, "awesome-" + n + "s") for k, n in enumerate(made[:50])]
    sets = clusters.piece_sets(spark.createDataFrame(rows, "id int, name string"), "id", [], "name")
    compared = clusters.dice_candidates(sets, [], 0.85).count()
    assert 50 <= compared < len(rows) * (len(rows) - 1) // 2 // 20


def least_members(n, edges):
    label = list(range(n))
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("over", [0.4, 0.6, 0.85])
def test_classes_join_as_by_all_like_pairs(spark, over):
    made = sorted({n.lower() for n in names() if n})
    rng = random.Random(9)
    rows = [(k, rng.choice("xyz"), n, rng.randint(0, k) if rng.random() < 0.3 else k) for k, n in enumerate(made)]
    sets = clusters.piece_sets(spark.createDataFrame(rows, "id int, owner string, name string, of int"), "id", ["owner"], "name")
    sets = sets.join(spark.createDataFrame([(k, of) for k, _, _, of in rows], "entity int, label int"), "entity")
    got = [tuple(r) for r in clusters.dice_classes(sets, ["owner"], over).collect()]
    alike = [(p[3], q[3]) for p, q in combinations(rows, 2) if p[1] == q[1] and dice(p[2], q[2]) > over]
    assert least_members(len(rows), got) == least_members(len(rows), alike)
    assert any(a != b for a, b in alike)


def test_names_that_are_all_alike_give_few_links(spark, monkeypatch):
    """300 names of one owner, all alike: their pairs, 44850, are not what is joined."""
    met = []
    monkeypatch.setattr(clusters, "connected", lambda links, *more, connected=clusters.connected: (met.append(links.count()), connected(links, *more))[1])
    rows = [(k, "o", f"a-remarkably-long-project-name-{k:03d}", None, False, False, k, k, None) for k in range(300)] + [(900, "o", "other", None, False, False, 1, 1, None), (901, "p", "a-remarkably-long-project-name", None, False, False, 1, 1, None)]
    got = clusters.folded(spark.createDataFrame(rows, "id int, owner string, name string, parent int, is_fork boolean, archived boolean, days int, stars int, description string")).collect()
    assert {(r["id"], r["cluster"], r["members"]) for r in got} == {(k, 0, 300) for k in range(300)} | {(900, 900, 1), (901, 901, 1)}
    assert sum(met) < 3000


def path(n):
    """1-2-...-n-0: the least vertex is at the far end."""
    return [(k, k + 1) for k in range(1, n)] + [(n, 0)]


def test_long_paths_take_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(clusters, "cut", lambda df, cut=clusters.cut: (cuts.append(1), cut(df))[1])
    edges = [*path(1000), (2000, 3000), (3000, 2500)]
    got = {r["v"]: r["label"] for r in clusters.connected(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {k: 0 for k in range(1001)} | {2000: 2000, 2500: 2000, 3000: 2000}
    assert len(cuts) < 60, "rounds grow with the path's length"


def test_no_links(spark):
    assert clusters.connected(spark.createDataFrame([], "a int, b int")).count() == 0
