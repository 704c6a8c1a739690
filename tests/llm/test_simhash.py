from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from evidra.llm import simhash
from tests.llm import rows as R


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(prints, distance=3):
    """label of each fingerprint: the least of its component."""
    values = sorted(prints)
    unsigned = np.array(values, np.int64).view(np.uint64)
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(unsigned[i + 1 :] ^ unsigned[i]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return {v: values[root(k)] for k, v in enumerate(values)}


@pytest.mark.parametrize("text", ["", "one", "one two", "A b C d", "ÉÀ mixed\x85case words here now", "x " * 5000, "\x0ba\x0cb\tc d e f"])
def test_fingerprint(text):
    assert simhash.simhash(text) == brute_print(text)


def test_rows_equal_brute_force(spark):
    rows = R.documents()
    got = simhash.near_duplicates(R.clashing(R.frame(spark, rows))).collect()
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    labels = brute_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[labels[p]] = min(i, least.get(labels[p], i))
    assert sorted(((r["id"], r["fp"], r["component"]) for r in got), key=str) == sorted(((i, p, least.get(labels[p])) for i, p in prints), key=str)


@pytest.mark.parametrize("bucket", [150])
def test_no_link_is_lost_however_hot_the_buckets(spark, bucket):
    """A dense ball of near copies, chains, and scattered values; small buckets make hot ones split again and again."""
    rng = random.Random(bucket)
    base = rng.getrandbits(64)
    values = {base}
    for _ in range(400):
        values.add(base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(1, 4))))
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.add(chain)
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket=bucket)
    pairs = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    got = {r["v"]: r["label"] for r in simhash.components(edges).collect()}
    assert {v: got.get(v, v) for v in values} == brute_components(values)
    assert len(pairs) <= 40 * len(values)


def test_thresholds_meet_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for parts in (2, 3, 4, 5):
        groups = simhash.grouped_bits(np.eye(64), parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        cost, thresholds = simhash.allocate(sample, 10**6, groups)
        assert sum(thresholds) == 3 - parts + 1 and cost < float("inf")


def test_skewed_parts_are_left_out():
    sample = np.arange(2000, dtype=np.uint64) << np.uint64(40)  # the low bits are all alike
    parts = [list(range(0, 16)), list(range(16, 32)), list(range(32, 48)), list(range(48, 64))]
    _, thresholds = simhash.allocate(sample, 10**6, parts)
    assert sum(thresholds) == 0 and thresholds[0] == thresholds[1] == -1 or thresholds[0] == -1


def test_empty_table(spark):
    assert simhash.near_duplicates(R.frame(spark, [])).count() == 0
