"""Rules over symbols, projects, tests, constraints and roles against cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import scores as sc
from evidra.operators import bundling, planning, profiles, verifying
from evidra.plans.literals import vocabulary

SYMBOLS = (
    ("DownloadManager", "src/net/DownloadManager.kt", "class", None, None), ("resumeDownload", "src/net/Download.kt", "function", "continues a download", None), ("HttpLogger", "src/log/HttpLogger.kt", "class", None, None),
    ("DownloadStoreBuilder", "src/DownloadStoreBuilder.kt", "class", None, None), ("getName", "src/a.kt", "function", None, "fun getName()"), ("test_resume", "tests/test_resume.py", "function", None, None), ("MAX_RETRIES", "src/a.kt", "constant", None, None),
    ("name", ".github/workflows/ci.yml", "constant", None, None), ("DownloadClient", "sample/App.kt", "class", None, None), ("ErrorMapper", "src/x.kt", "class", None, None), ("RetryPolicy", "src/resume/RetryPolicy.kt", "interface", None, None), ("AnalyticsService", "src/s.kt", "class", None, None),
)
JUDGED = (
    ("DownloadManager", None, 60), ("resumeDownload", None, 70), ("HttpLogger", "logging infrastructure", 10), ("DownloadStoreBuilder", None, 60), ("getName", "accessor", 0), ("test_resume", "a test", 0),
    ("MAX_RETRIES", "a constant: it names something and does nothing", 0), ("name", "CI configuration, not implementation", 0), ("DownloadClient", "documentation or example, not implementation", 25), ("ErrorMapper", "data mapping boilerplate", 10), ("RetryPolicy", None, 35), ("AnalyticsService", "analytics/telemetry", 25),
)
PROJECTS = (
    ("queue", ["src/JobQueue.kt", "src/retry/Backoff.kt"], ["download queue", "upload worker", "task store"], "react-native-queue", ["queue"], "A react native job queue", ["react-native"], "Kotlin"),
    ("clean", ["app/domain/a.kt", "app/data/b.kt", "app/ui/c.kt", "app/src/main/AndroidManifest.xml"], ["get user use case"], "clean-app", ["android", "kotlin"], "android library for clean code", ["androidx.core:core"], "Kotlin"),
    ("server", ["src/main/resources/application.yml"], ["user service", "user controller", "user model"], "backend-kit", ["backend"], "server-side kit", ["org.springframework:spring-web", "org.postgresql:postgresql"], "Java"),
    ("bare", ["x.py"], ["thing"], "thing", [], "", [], None),
    ("both", ["pubspec.yaml", "lib/a.dart"], ["event bus", "event listener"], "flutter_bus", ["flutter"], "bus", ["express", "vue"], "Dart"),
)
PROFILED = (
    ("queue", "queue + worker + persistent state", 150, "react-native", "client", 70, 55), ("clean", "clean architecture (domain / data / presentation)", 125, "native", "client", 90, 100), ("server", "layered service architecture", 125, "native", "server", 90, 100),
    ("bare", None, None, "unknown", "unknown", 10, 100), ("both", "event-driven / observer", 125, "flutter", "universal", 50, 55),
)
_PROJECT = "id string, paths array<string>, names array<string>, name string, topics array<string>, description string, dependencies array<string>, language string"
TARGETS = (
    ("web", ["next", "react", "@prisma/client", "ky", "zustand"], ["next.config.js", "src/index.ts"], [("app", "presentation"), ("lib", "source root"), ("db", "data access"), ("x", "2 files")]),
    ("phone", ["androidx.room:room", "com.squareup.okhttp3:okhttp"], ["app/src/main/AndroidManifest.xml"], [("domain", "domain model"), ("data", "data access"), ("ui", "presentation")]),
    ("py", ["Django", "requests", "SQLAlchemy"], ["manage.py"], [("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")]),
    ("empty", [], [], []),
)
TARGETED = (("web", "Next.js,React", "ky", "Prisma", "Zustand", "MVVM / layered"), ("phone", "Android", "OkHttp", "Room", None, "clean architecture (domain / data / presentation)"), ("py", "Django", "requests", "SQLAlchemy", None, "Django MTV"), ("empty", "", None, None, None, "flat / single-module"))
TESTED = (("a", "tests/test_retry.py", "import pytest\ndef test_timeout_and_empty(): pass"), ("a", "src/a.py", "jest"), ("a", "src/__tests__/x.test.ts", "vitest  mocha offline"), ("b", "src/b.py", "junit"), ("c", "FooTest.kt", "junit mockk unicode conflict"))
FRAGMENTED = ((1, "Build the of downloads, csv import with retry and a plain question"), (2, "it is; internationalisation · say where it is"), (3, "Short question and that, 99 bottles"))
LEFT_OVER = ((1, "csv import"), (1, "retry"), (2, "internationalisation"))
MENTIONED = (("ResumeHandler", "src/downloadresumer.kt", True), ("resume_handler", "x/resumeservice.ts", True), ("Foo", "src/foo.py", True), ("Foo", "src/bar.py", False), ("CacheEvictionPolicy", "src/policy.py", False), ("VeryDistinctiveThingHere", "distinctive.py", True), ("tokens", "a/token.py", True))
CANDIDATES = (
    ("license-incompatible", "gpl", "ADAPT", "strong-copyleft", "GPL-3.0", [], 1.0, "low", False, 3, [], "licence GPL-3.0 is strong-copyleft"), ("license-incompatible", "mit", "ADAPT", "permissive", "MIT", [], 1.0, "low", False, 3, [], "also MIT"),
    ("license-incompatible", None, "DO_NOT_USE", "unknown", None, [], 1.0, "low", False, 3, [], "licence unknown is incompatible"), ("dependency-incompatible", "OkHttp", "ADAPT", "permissive", "MIT", ["x:okhttp"], 1.0, "low", False, 3, [], "also depends on x:okhttp"),
    ("dependency-incompatible", None, "ADAPT", "permissive", "MIT", ["x:okhttp"], 1.0, "low", False, 3, [], None), ("stack-mismatch", None, "ADAPT", "permissive", "MIT", [], 0.42, "low", False, 3, [], "stack match is only 42%"), ("too-complex", None, "ADAPT", "permissive", "MIT", [], 1.0, "very-high", False, 3, [], "integration difficulty is very-high"),
    ("unmaintained", None, "ADAPT", "permissive", "MIT", [], 1.0, "low", True, 3, [], "also archived"), ("unmaintained", None, "ADAPT", "permissive", "MIT", [], 1.0, "low", False, 400, [], "also stale (last activity 400d ago)"),
    ("missing-capability", "retry support", "ADAPT", "permissive", "MIT", [], 1.0, "low", False, 3, [("has a retry policy", "absent")], 'also lacks "has a retry policy"'), ("missing-capability", "retry", "ADAPT", "permissive", "MIT", [], 1.0, "low", False, 3, [("retry", "evidenced")], None), ("other", "x", "DO_NOT_USE", "unknown", None, [], 0.1, "high", True, 999, [], None),
)
ROLE_CASES = (("DownloadManager", "orchestration"), ("UploadWorker", "execution"), ("JobQueue", "work scheduling"), ("RetryHandler", "behaviour policy"), ("UserStore", "persistence"), ("HttpAdapter", "external interface"), ("Thing", "core implementation"), ("CacheThing", "Cache layer"))
FOLDERS = (("src", "source root"), ("Models", "domain model"), ("db", "data access"), ("views", "presentation"), ("api", "networking"), ("di", "dependency injection"), ("utils", "shared utilities"), ("jobs", "background work"), ("usecase", "business logic"), ("settings", "configuration"), ("spec", "tests"), ("zzz", None))
DEPS = (("r1", "com.squareup.okhttp3:okhttp"), ("r1", "com.squareup.retrofit2:retrofit"), ("r2", "io.ktor:ktor-client-core"), ("r1", "org.slf4j:slf4j-api"), ("r2", "ch.qos.logback:logback-classic"), ("r3", "androidx.room:room-runtime"), ("r3", "androidx.room:room-ktx"), ("r2", "io.realm:realm"))
ADAPTED = (
    (1, 0.2, "Kotlin", ["x:realm", "g:gson"], ["androidx.room:room"], "queue worker pattern", "layered queue worker"), (2, 0.9, None, ["okhttp"], ["ktor"], "state machine", "clean domain data"), (3, 0.5, "Go", [], None, None, None),
)
ADAPTATIONS = (
    (1, 1, "port into Kotlin", "large"), (1, 2, "replace local database", "medium"), (1, 3, "decide on serialisation", "medium"), (1, 4, "test what was adapted", "small"), (2, 1, "replace HTTP client", "medium"), (2, 2, "reshape into clean domain data", "medium"),
    (2, 3, "test what was adapted", "small"), (3, 1, "test what was adapted", "small"),
)


def hundredths(c):
    return F.floor(c * 100 + 0.5).cast("int")


def test_symbols(spark):
    rows = spark.createDataFrame(list(SYMBOLS), "name string, path string, kind string, purpose string, signature string")
    score = sc.symbol_score(F.array(F.lit("download"), F.lit("resume")), F.col("name"), F.col("purpose"), F.col("path"), F.col("signature"), F.col("kind"))
    got = rows.select("name", sc.noise(F.col("name"), F.col("path"), F.col("kind")).alias("reason"), hundredths(score).alias("score")).collect()
    assert sorted(map(tuple, got)) == sorted(JUDGED)


def test_projects(spark):
    rows = spark.createDataFrame([tuple(r) for r in PROJECTS], _PROJECT)
    host = profiles.host(F.col("name"), F.col("topics"), F.col("description"), F.col("dependencies"), F.col("paths"), F.col("language"))
    side = profiles.deployment(F.concat_ws(" ", "name", "description"), F.col("topics"), F.col("dependencies"), F.col("paths"))
    rows = rows.select("id", profiles.architecture(F.col("paths"), F.col("names")).alias("a"), host.alias("h"), side.alias("d"))
    kept = hundredths(profiles.host_multiplier(F.col("h.framework"), F.lit("some phone")))
    got = rows.select("id", "a.pattern", hundredths(F.col("a.score")), "h.framework", "d.target", hundredths(F.col("d.confidence")), kept).collect()
    assert sorted(map(tuple, got)) == sorted(PROFILED)


def test_targets(spark):
    rows = spark.createDataFrame(list(TARGETS), "id string, deps array<string>, files array<string>, dirs array<struct<path:string,role:string>>")
    rows = rows.select("id", profiles.project(F.col("deps"), F.col("files"), F.col("dirs")).alias("p"))
    got = rows.select("id", F.array_join("p.frameworks", ","), "p.network", "p.database", "p.state", "p.architecture").collect()
    assert sorted(map(tuple, got)) == sorted(TARGETED)


def test_tests(spark):
    got = profiles.tests(spark.createDataFrame(list(TESTED), "e string, path string, content string"), "e", "path", "content").collect()
    found = sorted((r["e"], r["test_files"], ",".join(r["frameworks"]), ",".join(r["edge_cases"])) for r in got)
    assert found == [("a", 2, "Mocha,Vitest,pytest", "empty/null input,network failure,timeouts and expiry"), ("c", 1, "JUnit,MockK", "conflict handling,encoding and unicode")]


def test_mentions(spark):
    rows = spark.createDataFrame([r[:2] for r in MENTIONED], "name string, haystack string")
    got = rows.select("name", "haystack", verifying.mentions_identifier(F.col("haystack"), F.col("name"))).collect()
    assert sorted(map(tuple, got)) == sorted(MENTIONED)


def test_constraints(spark):
    schema = "id int, kind string, subject string, reuse_mode string, license_category string, license_spdx string, dependencies array<string>, stack_match double, difficulty string, archived boolean, days_since_push int, items array<struct<requirement:string,status:string>>"
    rows = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(CANDIDATES)], schema)
    got = {r["id"]: r["v"] for r in rows.select("id", verifying.violates(F.col("kind"), F.col("subject")).alias("v")).collect()}
    assert got == {k: r[-1] for k, r in enumerate(CANDIDATES)}


def test_roles(spark):
    own = spark.createDataFrame([r[:1] for r in ROLE_CASES], "name string").select("name", bundling.symbol_role(F.col("name"), F.array(F.lit("Cache layer"))))
    places = spark.createDataFrame([r[:1] for r in FOLDERS], "name string").select("name", bundling.directory_role(F.col("name")))
    assert list(map(tuple, own.collect())) == list(ROLE_CASES) and list(map(tuple, places.collect())) == list(FOLDERS)


def test_duplicates(spark):
    got = bundling.duplicate_abstractions(spark.createDataFrame(list(DEPS), "repo string, name string"), "repo", "name").collect()
    assert {r["concept"]: (r["families"], r["entities"]) for r in got} == {"HTTP client": (3, 2), "local database": (2, 2)}


def test_adaptations(spark):
    rows = spark.createDataFrame([tuple(r) for r in ADAPTED], "id int, stack_match double, language string, dependencies array<string>, target_libraries array<string>, pattern string, target_pattern string")
    assert sorted(map(tuple, bundling.adaptation(rows, "id").select("id", "step", "action", "effort").collect())) == sorted(ADAPTATIONS)


def test_fragments(spark):
    rows = spark.createDataFrame(list(FRAGMENTED), "id int, text string")
    assert sorted(map(tuple, planning.decompose(rows, "id", "text", vocabulary(spark))[2].collect())) == sorted(LEFT_OVER)


def test_texts_are_read_once_for_what_is_recognised(spark):
    rows = spark.createDataFrame([(1, "It is the place for the reader, with the rest in the other"), (2, "nothing"), (3, "for the and in the")], "id int, text string")
    units, main, _ = planning.decompose(rows, "id", "text", vocabulary(spark))
    for made in (units, main):
        assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["id"], r["capability"]) for r in main.collect()} == {(1, "order"), (3, "order")}


def test_coverage_looks_up_words_not_texts(spark, monkeypatch):
    """Copies of texts don't grow what terms are looked up in, and seams of words, plurals and weights count as in a look at each pair."""
    import re

    from evidra.operators import containment, matching

    seen, plain = [], containment.contained
    monkeypatch.setattr(containment, "contained", lambda texts, *more: seen.append(texts.count()) or plain(texts, *more))
    items = [(1, "login cache retries"), (2, "offline storage engine"), (3, "tokens walks")]
    bodies = [("a", "log_in of-fl.ine xcachex", 100), ("a", "re tr ies; stor,age token", 35), ("b", "en\ngi  ne LOGIN walk", 35), ("b", None, 90), ("c", "cache login", 30)] * 40
    items_, bodies_ = spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(bodies, "entity string, body string, w int")
    got = matching.coverage(items_, "item", "text", bodies_, "entity", "body", "w").collect()
    squash = lambda s: re.sub(r"[\s_.\-]+", "", s)
    inside = lambda t, b: t in b or (len(t) >= 4 and t in squash(b)) or (t[-1] == "s" and len(t) > 3 and t[:-1] in b)
    want = set()
    for e in "abc":
        for item, text in items:
            ws = [[w for x, b, w in bodies if x == e and b and inside(t, b.lower())] for t in text.split()]
            want.add((e, item, sum(map(bool, ws)), len(ws), max(map(max, filter(None, ws)), default=0)))
    assert {(r["entity"], r["requirement"], r["covered"], r["terms"], r["best"]) for r in got} == want and len(got) == 9
    assert max(seen) < 40
