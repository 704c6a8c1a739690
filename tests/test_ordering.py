"""Orders of tasks against a walk in plain Python."""

from __future__ import annotations

import random

import pytest

from evidra.operators import ordering

SCHEMA = "plan int, task string, priority int, needs array<string>"


def walked(rows):
    """(plan, task) to place, by recursion."""
    places = {}
    for plan in {r[0] for r in rows}:
        needs = {t: ns or [] for p, t, _, ns in rows if p == plan}
        urgent = {t: u for p, t, u, _ in rows if p == plan}
        seen, out = set(), []

        def visit(t, needs=needs, seen=seen, out=out):
            if t in seen:
                return
            seen.add(t)
            for n in needs[t]:
                if n in needs:
                    visit(n)
            out.append(t)

        for t in sorted(needs, key=lambda t: (-(urgent[t] if urgent[t] is not None else -(2**62)), t)):
            visit(t)
        places |= {(plan, t): k + 1 for k, t in enumerate(out)}
    return places


def graph(seed, n=24, plans=3):
    rng = random.Random(seed)
    rows = []
    for plan in range(plans):
        names = [f"t{k}" for k in range(n)]
        for name in names:
            needs = rng.choice([None, [], rng.sample(names, rng.randint(1, 4)), [rng.choice(names), "gone"]])
            rows.append((plan, name, rng.choice([None, 1, 2, 3, 50]), needs))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_places_are_those_of_a_walk(spark, seed):
    rows = graph(seed)
    got = ordering.topological(spark.createDataFrame(rows, SCHEMA), "plan", "task", "priority", "needs").collect()
    assert {(r["plan"], r["task"]): r["place"] for r in got} == walked(rows)


def test_a_chain_longer_than_any_depth(spark):
    n = 14
    tasks = spark.createDataFrame([(k, k % 5) for k in range(n)], "k int, u int")
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, n)], "a int, b int")
    got = {r["k"]: (r["level"], r["place"]) for r in ordering.build_order(tasks, edges, "k", "u").collect()}
    assert got == {k: (k, k + 1) for k in range(n)}


def test_cycles_are_broken_where_the_walk_closes_them(spark):
    tasks = spark.createDataFrame([(1, 9), (2, 5), (3, 7), (4, 1), (5, 1)], "k int, u int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 3), (2, 77)], "a int, b int")
    got = {r["k"]: r["level"] for r in ordering.build_order(tasks, edges, "k", "u").collect()}
    assert got == {3: 0, 2: 1, 1: 2, 4: 0, 5: 1}  # 3 -> 1 and 4 -> 4 don't count


def test_no_tasks(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordering.topological(none, "plan", "task", "priority", "needs").count() == 0
