from __future__ import annotations

from evidra.plans import discover

REPOS = [
    ("acme/download-manager", "Resumable download queue library", ["download"], "Kotlin", 900, False, None, False, "2025-01-01", "2025-05-20", "MIT"),
    ("fork/download-manager", "Resumable download queue library", ["download"], "Kotlin", 3, True, "acme/download-manager", False, "2025-01-01", "2025-05-25", "MIT"),
    ("old/resume-download", "resume download in the background", [], "Java", 9000, False, None, True, "2015-01-01", "2018-01-01", "GPL-3.0"),
    ("other/cooking", "recipes", [], "Python", 50000, False, None, False, "2015-01-01", "2025-05-01", "MIT"),
]
FILES = [("acme/download-manager", p) for p in ("README.md", "src/A.kt", "src/test/ATest.kt", ".github/workflows/ci.yml")] + [("other/cooking", "README.md")]


def test_discovery(spark):
    repos = spark.createDataFrame(REPOS, "full_name string, description string, topics array<string>, language string, stars long, is_fork boolean, parent string, archived boolean, created_at string, pushed_at string, license_spdx string")
    files = spark.createDataFrame(FILES, "full_name string, path string")
    tasks = spark.createDataFrame([("t1", "resume a download after pause", "kotlin"), ("t2", "cooking recipes", None)], "task string, requirement string, target_language string")
    queries = spark.createDataFrame([("t1", 0, "resumable download zebra"), ("t1", 1, "resume download"), ("t2", 0, "recipes")], "task string, ord int, query string")
    rows = discover.discover(tasks, queries, repos, files, "2025-06-01").orderBy("task", "rank").collect()
    assert [(r["task"], r["full_name"]) for r in rows] == [("t1", "acme/download-manager"), ("t1", "old/resume-download"), ("t2", "other/cooking")]
    best, old, _ = rows
    assert best["folded"] == 2 and best["verdict"] == "DIRECT_REUSE" and old["verdict"] == "DO_NOT_USE" and best["total"] > old["total"]
    assert best["discovered_via"] == ["resumable download zebra"] and "testEvidence" not in best["unmeasured"] and "completeness" in best["unmeasured"]


MANIFEST = '{"dependencies":{"react":"1","got":"2","left-pad":"3","nestjs":"4"},"devDependencies":{"vitest":"1"},"private": false}'
CONTENT = [
    ("a/queue", "package.json", MANIFEST),
    ("a/queue", "src/DownloadManager.ts", "export class DownloadManager {}\nexport interface Store {}\nexport function resume() {}\n"),
    ("a/queue", "README.md", "# Queue\n## Installation\n```\nnpm install queue\n```\n## Usage\n" + "words " * 80),
    ("a/queue", "tests/queue.test.ts", "import 'vitest'\n"),
    ("b/app", "Dockerfile", "FROM x"),
    ("b/app", "app/build.gradle", 'android { applicationId "x" }'),
    ("c/other", "README.md", "download"),
]


def test_axes_of_the_shortlist_are_measured_from_files(spark):
    def repo(name, said):
        return (name, said, said.split()[:1], "TypeScript", 900, False, None, False, "2020-01-01", "2025-05-20", "MIT", 3000, 10)

    schema = "full_name string, description string, topics array<string>, language string, stars long, is_fork boolean, parent string, archived boolean, created_at string, pushed_at string, license_spdx string, size_kb long, releases long"
    repos = spark.createDataFrame([repo("a/queue", "download queue"), repo("b/app", "download something"), repo("c/other", "cooking")], schema)
    checklist = ["download manager", "left-pad", "store", "zebra crossing"]
    tasks = spark.createDataFrame([("t", "resume the download manager", "typescript", checklist), ("u", "cooking", None, ["cooking"])], "task string, requirement string, target_language string, checklist array<string>")
    queries = spark.createDataFrame([("t", 0, "download"), ("u", 0, "cooking")], "task string, ord int, query string")
    files = spark.createDataFrame(CONTENT, "full_name string, path string, content string")
    rows = {(r["task"], r["full_name"]): r for r in discover.discover(tasks, queries, repos, files, "2025-06-01").collect()}
    assert set(rows) == {("t", "a/queue"), ("t", "b/app"), ("u", "c/other")}
    best, app = rows["t", "a/queue"], rows["t", "b/app"]
    assert best["completeness"] == 75 and app["completeness"] == 25  # three of four items; what is said of the app holds half of the first
    assert best["dependencySimplicity"] == 90  # four run: 1 - log10(4 / 3) / log10(20)
    # three symbols 1, four dependencies 0.89, two places to come in 0.89, no settings 1, one heavy framework 0.7
    assert best["integrationSurface"] == round(100 * (0.22 + 0.24 * 0.89 + 0.16 * 0.89 + 0.10 + 0.28 * 0.7))
    assert best["reusability"] == 100 and app["reusability"] == 15 and app["verdict"] == "REFERENCE_ONLY"  # published and installed; built as an app
    assert best["architectureMatch"] == round(100 * (0.7 * 3 / 3 + 0.3 * 2 / 3))  # resume, download and manager; two names of three have a role
    assert best["testEvidence"] == round(100 * (0.35 + 0.65 / 25)) and best["implementationQuality"] == round(100 * (0.25 + 0.2 * 0.5))
    assert best["unmeasured"] == "" and app["architectureMatch"] is None and "architectureMatch" in app["unmeasured"]
    assert best["verdict"] == "DIRECT_REUSE" and best["rank"] == 1 and best["total"] > app["total"]
