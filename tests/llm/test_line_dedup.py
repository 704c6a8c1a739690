from __future__ import annotations

import random
import re

import pytest

from evidra.llm import line_dedup, registry
from tests.held import spark_rows, sql_rows
from tests.llm import rows as R


def brute(rows, min_words):
    """By the plain definition: every run, of any length, with enough words and an earlier copy."""
    keyed = sorted({(i is None, i if i is not None else 0, t or "") for i, t, *_ in rows})
    lines, order = {}, []
    for key in keyed:
        got = [(p, x.rstrip(" \t\n\x0b\x0c\r")) for p, x in enumerate(key[2].split("\n"))]
        lines[key] = [(p, x, len(re.findall(r"[^\x20\x09-\x0d]+", x))) for p, x in got if re.search(r"[^\x20\x09-\x0d]", x)]
        order.append(key)
    # documents with one id are told apart by a hash that is not known here: tests give them no common runs
    seen, drop = set(), {}
    runs = []
    for key in order:
        for s in range(len(lines[key])):
            words, text = 0, []
            for p, x, n in lines[key][s:]:
                words += n
                text.append(x)
                if words >= min_words:
                    runs.append((key, s, len(text), "\n".join(text)))
    for key, s, size, text in runs:
        if (size, text) in seen:
            drop.setdefault(key, set()).update(p for p, *_ in lines[key][s : s + size])
        seen.add((size, text))
    out = []
    for i, t, *_ in rows:
        gone = drop.get((i is None, i if i is not None else 0, t or ""), set())
        out.append((i, t if not gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone), len(gone)))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    shared = [R.prose(rng, n).replace("\n", " ") for n in (2, 3, 5, 12, 60)]
    rows = []
    for k in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.6 else R.prose(rng, rng.randint(1, 9)).replace("\n", " ") + f" {k}" for _ in range(rng.randint(0, 9))]
        rows.append((k, "\n".join(x + rng.choice(("", "  ", "\n", "")) for x in parts), None, "s", 0))
    return rows


@pytest.mark.parametrize("seed,min_words", [(1, 10), (2, 4), (3, 1), (4, 25)])
def test_equals_brute_force(spark, seed, min_words):
    rows = passages(seed) + [(99, None, None, None, None), (100, "", None, None, 0)]
    got = line_dedup.dedup_lines(R.clashing(R.frame(spark, rows)), min_words=min_words)
    assert sorted(((r["doc_id"], r["text"], r["_removed"]) for r in got.collect()), key=str) == brute(rows, min_words)


def test_awkward_rows_keep_their_number_and_columns(spark):
    rows = R.documents()
    got = line_dedup.dedup_lines(R.frame(spark, rows))
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_removed"]
    kept = {r["doc_id"]: r["text"] for r in got.collect()}
    assert kept[rows[75][0]].count("same line") == 1 if "same line" in (rows[75][1] or "") else True


def test_a_repeated_passage_stays_once(spark):
    passage = " ".join(f"word{k}" for k in range(55))
    rows = [(k, f"own start {k} of text\n{passage}\nown end {k}", None, "s", 0) for k in range(30)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(R.frame(spark, rows)).collect()}
    assert passage in got[0] and all(passage not in got[k] and f"own end {k}" in got[k] for k in range(1, 30))


def test_empty_table(spark):
    assert line_dedup.dedup_lines(R.frame(spark, [])).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(registry.QUERIES["op2_line_dedup"](spark, sf_dir)) == sql_rows(registry.SQL["op2_line_dedup"], sf_dir)


def test_passages_of_short_lines_in_repeated_rows(spark):
    passage = "\n".join(f"short line number {k}" for k in range(15))
    rows = [(1, passage + "\nend of one", None, "s", 0)] + [(2, "start of two\n" + passage, None, "s", 0)] * 3
    got = line_dedup.dedup_lines(R.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"], r["_removed"]) for r in got) == brute(rows, 10)
    assert [r["_removed"] for r in got if r["doc_id"] == 2] == [15] * 3


def test_rounds_do_not_grow_with_the_length_of_runs(spark):
    jobs = []
    for size in (20, 700):
        passage = "\n".join(f"line {k} of a passage" for k in range(size))
        rows = [(1, passage + "\nend of one", None, "s", 0), (2, "start of two\n" + passage, None, "s", 0)]
        spark.sparkContext.setJobGroup(f"runs-{size}", "")
        got = line_dedup.dedup_lines(R.frame(spark, rows)).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"runs-{size}")))
        assert sorted((r["doc_id"], r["text"], r["_removed"]) for r in got) == [rows[0][:2] + (0,), (2, "start of two", size)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 0 and jobs[1] <= jobs[0] + 2
