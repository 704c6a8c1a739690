from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from evidra.llm import exact_dedup, registry
from tests.held import spark_rows, sql_rows
from tests.llm import rows as R


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep if len(ids) > 1 else i, len(ids), i == keep if len(ids) > 1 else True, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force_with_awkward_rows(spark):
    rows = R.documents()
    got = exact_dedup.exact_groups(R.clashing(R.frame(spark, rows)), digest_all=True).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_a_saturated_filter_changes_nothing(spark):
    rows = R.documents()
    got = exact_dedup.exact_groups(R.frame(spark, rows), digest_all=True, filter_bits=32768, prefix_chars=1).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_only_survivors_are_hashed(spark):
    got = exact_dedup.exact_groups(R.frame(spark, [(1, "abc", None, None, 3), (2, "abcd", None, None, 4), (3, "abcd", None, None, 4)])).collect()
    assert {r["id"]: r["digest"] is None for r in got} == {1: True, 2: False, 3: False}


def test_empty_table(spark):
    assert exact_dedup.exact_groups(R.frame(spark, [])).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(registry.QUERIES["op10_exact_dedup"](spark, sf_dir)) == sql_rows(registry.SQL["op10_exact_dedup"], sf_dir)
