from __future__ import annotations

from evidra.operators import profiles, report


RULES = (("clean", r"(^|/)domain/", 1.0, True), ("clean", r"(^|/)data/", 1.0, True), ("mvc", r"(^|/)controllers?/", 1.0, True), ("mvc", r"(^|/)models?/", 1.0, True))


def test_kinds_need_their_required_rules(spark):
    rows = [("a", "src/domain/x.kt"), ("a", "src/data/y.kt"), ("b", "src/domain/x.kt"), ("c", "app/controllers/a.rb"), ("c", "app/models/b.rb"), ("d", "x.py")]
    files = spark.createDataFrame(rows, "e string, path string")
    got = {r["e"]: (r["kind"], r["points"]) for r in profiles.detect(files, "e", "path", RULES).collect()}
    assert got == {"a": ("clean", 2.0), "c": ("mvc", 2.0)}


def test_quality_tests_and_directories(spark):
    rows = [("a", ".github/workflows/ci.yml", ""), ("a", "README.md", ""), ("a", "tests/test_retry.py", "import pytest\ndef test_timeout(): pass"), ("a", "src/a.py", "pytest"), ("a", "src/b.py", "")]
    files = spark.createDataFrame(rows, "e string, path string, content string")
    q = profiles.quality(files, "e", "path").first()
    assert q["has_ci"] and q["has_readme"] and not q["has_docs"] and q["test_files"] == 1
    t = profiles.tests(files, "e", "path", "content").first()
    assert t["frameworks"] == ["pytest"] and t["edge_cases"] == ["timeouts and expiry"]
    assert [(r["directory"], r["n"]) for r in profiles.directories(files, "e", "path", 1).collect()] == [("src", 2)]


def test_substitutions_and_reports(spark):
    deps = spark.createDataFrame([("com.squareup.okhttp3:okhttp",), ("x:moshi",)], "name string")
    target = spark.createDataFrame([("io.ktor:ktor-client",), ("g:gson",)], "name string")
    groups = {"http": ("ktor", "okhttp"), "json": ("moshi", "gson")}
    got = {(r["group"], r["source"], r["replacement"]) for r in profiles.substitutions(deps, target, groups).collect()}
    assert got == {("http", "okhttp", "ktor"), ("json", "moshi", "gson")}
    rows = spark.createDataFrame([("fetch", "no key", k) for k in range(3)] + [("parse", f"r{k}", 10 + k) for k in range(6)], "stage string, reason string, ord int")
    lines, more = report.limitations(rows)
    assert lines[0] == "fetch: no key" and len(lines) == 5 and more == 2
    assert report.table(deps, ["name"]).splitlines()[0] == "name"
