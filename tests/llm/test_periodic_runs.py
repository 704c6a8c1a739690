from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from evidra.llm import periodic_runs, registry
from tests.llm import rows as R


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """All maximal stretches of a least period, by looking at each period in turn."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        at = 0
        while at + p < n:
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end > at and end + p - at >= max(6, 4 * p):
                found.setdefault((at, end + p - at), p)
            at = end + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words: list[str]) -> str:
    gone = {i for s, length, p in brute(words) for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edited(doc_id, text):
    words = split(text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def awkward():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.choice((5, 6, 7, 30, 90)))) for _ in range(60)]
    texts += [" ".join(list("abc") * 5 + list("abcd") * 4 + list("ab") * 9), "a " * 6, "a " * 5, "é x " * 7, "ab ab\nab\tab ab ab", " x y " * 400]
    return [(k, t) for k, t in enumerate(texts)]


def test_names_tell_equal_stretches():
    rng = np.random.default_rng(3)
    words = np.concatenate([rng.integers(0, 3, 90), np.tile([7, 8, 9], 30)])
    for k, names in enumerate(periodic_runs.naming(words)):
        for i in range(0, 180 - (1 << k), 3):
            for j in range(i + 1, 180 - (1 << k)):
                assert (names[i] == names[j]) == (words[i : i + (1 << k)] == words[j : j + (1 << k)]).all()


@pytest.mark.parametrize("part", [1, 1 << 21])
def test_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(periodic_runs, "PART_BYTES", part)  # in this process: the workers' own value is tested by the table
    rows = awkward()
    of, start, length, period, out = periodic_runs._found([t.encode() for _, t in rows])
    for k, t in rows:
        assert [x[1:] for x in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True) if x[0] == k] == brute(split(t))
        assert out[k].decode() == collapsed(split(t))


def test_rows_of_any_kind(spark):
    rows = R.documents() + [(1000 + k, t, None, None, None) for k, t in awkward()]
    got = periodic_runs.periodic_runs(R.clashing(R.frame(spark, rows))).collect()
    want = sorted(((i, brute(split(t)), collapsed(split(t))) for i, t, *_ in rows), key=str)
    assert sorted(((r["id"], [tuple(x) for x in r["runs"]], r["text"]) for r in got), key=str) == want


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(R.frame(spark, [])).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [r for r in R.documents() if r[0] is not None] + [(2000 + k, R.prose(rng, 80), None, None, None) for k in range(200)] + [(3000, "w " * 100, None, None, 1)]
    R.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want, sha = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, *_ in rows:
        words = edited(i, t)
        found = brute(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((i, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed(words))))
    assert sum(w[1] for w in want) > 10
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
