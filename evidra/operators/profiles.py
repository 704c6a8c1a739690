"""What kind of thing a set of files is: rules with points over paths and text, the best kind by entity.

A rule is (kind, pattern, points, required). Rules are a short list and become columns; a file is
read once, and only points are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Rules = tuple[tuple[str, str, float, bool], ...]

# Architectures: name, what all has to be there, what supports it; the first of the best.
ARCHITECTURES = (
    ("queue + worker + persistent state", (r"\b(queue|scheduler)\b", r"\b(worker|job|task|executor)\b"), (r"\b(repository|dao|store|database|persist)\b", r"\b(retry|backoff)\b")),
    ("clean architecture (domain / data / presentation)", (r"(^|/)(domain)/", r"(^|/)(data)/"), (r"(^|/)(presentation|ui|app)/", r"\b(usecase|use_case|interactor)\b")),
    ("repository pattern over a local database", (r"\b(repository|repositories)\b",), (r"\b(dao|entity|room|realm|coredata|sqlite|orm)\b",)),
    ("MVVM / unidirectional state", (r"\b(viewmodel|view_model)\b",), (r"\b(state|uistate|reducer|intent|action)\b", r"\b(flow|livedata|observable|publisher)\b")),
    ("layered service architecture", (r"\b(service|services)\b", r"\b(controller|handler|resource|route)\b"), (r"\b(repository|dao|model)\b", r"(^|/)(middleware)/")),
    ("client + interceptor pipeline", (r"\b(client)\b", r"\b(interceptor|middleware|filter|plugin)\b"), (r"\b(request|response)\b", r"\b(auth|retry|logging)\b")),
    ("event-driven / observer", (r"\b(event|events)\b", r"\b(listener|observer|subscriber|handler|emitter)\b"), (r"\b(bus|dispatcher|publisher|channel)\b",)),
    ("plugin / strategy registry", (r"\b(plugin|strategy|provider)\b", r"\b(registry|factory|resolver)\b"), ()),
    ("state machine", (r"\b(state.?machine|statemachine)\b",), (r"\b(transition|state|event)\b",)),
)
# Host frameworks: name, patterns of a repository's name, of texts, of dependencies and files (or none), and what a target calls itself.
HOSTS = (
    ("react-native", r"(^|/)(react-native-|rn-)|(-react-native)$", r"\breact[\s-]?native\b", r"^react-native($|[-/])|@react-native/", r"(^|/)react-native\.config\.js$", r"\breact[\s-]?native\b|\brn\b|\bexpo\b"),
    ("flutter", r"(^|/)flutter[_-]|[_-]flutter$", r"\bflutter\b|\bdart\s+package\b", r"^flutter($|[-_/])", r"(^|/)pubspec\.ya?ml$", r"\bflutter\b|\bdart\b"),
    ("cordova", r"(^|/)cordova-plugin-|(^|/)phonegap-", r"\bcordova\b|\bphonegap\b", r"^cordova($|[-/])", r"(^|/)plugin\.xml$", r"\bcordova\b|\bphonegap\b|\bionic\b"),
    ("capacitor", r"(^|/)capacitor-|@capacitor/", r"\bcapacitor\b", r"^@capacitor/", None, r"\bcapacitor\b|\bionic\b"),
    ("nativescript", r"(^|/)nativescript-|@nativescript/", r"\bnativescript\b", r"^@?nativescript($|[-/])", None, r"\bnativescript\b"),
    ("xamarin", r"(^|/)xamarin[.-]|\.forms$", r"\bxamarin\b|\bmaui\b", r"^Xamarin\.", None, r"\bxamarin\b|\bmaui\b|\bdotnet\b|\b\.net\b"),
    ("unity", r"(^|/)unity-|-unity$", r"\bunity\s?(3d|engine|package|plugin)\b", None, r"(^|/)Assets/.*\.unity$", r"\bunity\b"),
    ("tauri", r"(^|/)tauri-plugin-|(^|/)tauri-", r"\btauri\b", r"^@tauri-apps/|^tauri($|[-_])", r"(^|/)tauri\.conf\.json$", r"\btauri\b"),
    ("electron", r"(^|/)electron-", r"\belectron\b", r"^electron($|[-/])", None, r"\belectron\b"),
)
NAMED_STACK = r"\b(android|ios|swiftui|jetpack|compose|spring|django|rails|next|nuxt|laravel)\b"
# What tells the side of the wire that code runs on: dependencies, files, phrases, topics.
CLIENT = {"deps": r"^androidx[.:]|^com\.google\.android|^com\.android\.tools|compose[.-]?(ui|foundation|material|runtime)|jetbrains\.compose|^com\.google\.firebase:firebase-(messaging|analytics|crashlytics)|\b(swiftui|uikit|alamofire|kingfisher|snapkit)\b|^react($|[-/])|^react-dom$|^vue$|^@angular/|^(coil|glide|picasso)\b",
          "files": r"AndroidManifest\.xml$|\.xcodeproj/|Info\.plist$", "phrases": r"\b(for android|android library|ios library|mobile app|on-device|client.?side|in your app)\b",
          "topics": r"\b(android|androidx|ios|swiftui|jetpack-compose|mobile|flutter|react-native|browser|frontend)\b", "target": r"\b(android|ios|swiftui|jetpack|compose|mobile|react native|flutter|browser|frontend|web app)\b"}
SERVER = {"deps": r"\bnetty\b|\bundertow\b|\btomcat\b|\bjetty\b|^org\.postgresql|\bpostgresql\b|\bmysql-connector\b|\bjdbc\b|\bhikari\b|spring-boot|spring-web|\bmicronaut\b|\bquarkus\b|\bvertx\b|\bjavalin\b|\bhttp4k\b|ktor-server|\bexposed-core\b|\bkafka-clients\b|\brabbitmq\b|\bjedis\b|\blettuce-core\b|\bmongodb-driver\b|prometheus-metrics-exporter|opentelemetry-exporter|^express$|^fastify$|^koa$|^nestjs/|^django$|^flask$|^fastapi$|^gunicorn$|^celery$",
          "files": r"(^|/)src/main/resources/application\.(ya?ml|properties)$", "phrases": r"\b(jvm library|server.?side|backend|micro.?service|self.?hosted|for your server|server library)\b",
          "topics": r"\b(backend|server|microservice|microservices|spring-boot|postgres|postgresql|mysql|kafka|redis|jvm-server)\b", "target": r"\b(spring|django|flask|fastapi|express|nestjs|rails|laravel|ktor server|backend|server|microservice)\b"}
TEST_PATHS = r"(^|/)(tests?|spec|__tests__|androidTest)/|[._-](test|spec)\.[a-z]+$|(^|/)test_[^/]+\.py$|[A-Za-z]Tests?\.(java|kt|swift|cs)$"
# Test frameworks and conditions that tests are about, with their patterns.
TEST_FRAMEWORKS = {
    "JUnit": r"(?i)\b(junit|junit-jupiter|junit5)\b", "Mockito": r"(?i)\bmockito\b", "Robolectric": r"(?i)\brobolectric\b", "Espresso": r"(?i)\bespresso\b", "Kotest": r"(?i)\bkotest\b", "MockK": r"(?i)\bmockk\b", "Truth": r"(?i)\btruth\b",
    "AssertJ": r"(?i)\bassertj\b", "Jest": r"(?i)\b(jest|@types/jest)\b", "Vitest": r"(?i)\bvitest\b", "Mocha": r"(?i)\bmocha\b", "Jasmine": r"(?i)\bjasmine\b", "Testing Library": r"(?i)\b(testing-library|@testing-library)\b",
    "Playwright": r"(?i)\bplaywright\b", "Cypress": r"(?i)\bcypress\b", "pytest": r"(?i)\bpytest\b", "unittest": r"(?i)\bunittest2?\b", "Hypothesis": r"(?i)\bhypothesis\b", "testify": r"(?i)\btestify\b", "Ginkgo": r"(?i)\bginkgo\b",
    "RSpec": r"(?i)\brspec\b", "XCTest": r"(?i)\bxctest\b", "Quick/Nimble": r"(?i)\bquick/nimble\b", "xUnit": r"(?i)\bxunit\b", "NUnit": r"(?i)\bnunit\b", "Criterion": r"(?i)\bcriterion\b", "proptest": r"(?i)\bproptest\b",
}
EDGE_CASES = {
    "empty/null input": r"(?i)\b(empty|blank|null|nil|none|undefined|missing)\b", "malformed input": r"(?i)\b(invalid|malformed|corrupt|bad|garbage|unparseable)\b", "timeouts and expiry": r"(?i)\b(timeout|timed?.?out|deadline|expire[ds]?|expiry)\b",
    "retry behaviour": r"(?i)\b(retry|retries|backoff|transient)\b", "cancellation": r"(?i)\b(cancel|abort|interrupt|stop|shutdown)\b", "concurrency": r"(?i)\b(concurrent|parallel|race|thread.?safe|atomic|lock)\b",
    "size limits and boundaries": r"(?i)\b(large|huge|big|overflow|limit|boundary|max|oversize)\b", "network failure": r"(?i)\b(offline|disconnect|network.?(error|failure)|unreachable|connection.?(reset|refused|lost))\b",
    "resumption and recovery": r"(?i)\b(resume|restart|reconnect|recover|restore)\b", "idempotency and duplicates": r"(?i)\b(duplicate|idempotent|repeat|twice|reentrant)\b", "authorisation failure": r"(?i)\b(permission|unauthoriz|forbidden|denied|auth.?(fail|error))\b",
    "encoding and unicode": r"(?i)\b(unicode|utf|encoding|charset|special.?char|emoji)\b", "numeric boundaries": r"(?i)\b(negative|zero|one|single|boundary|off.?by.?one)\b", "conflict handling": r"(?i)\b(conflict|collision|clash|merge)\b",
    "partial data": r"(?i)\b(partial|incomplete|truncat|chunk)\b", "resource exhaustion": r"(?i)\b(disk.?full|out.?of.?(memory|space)|quota|exhaust)\b",
}
QUALITY_FILES = {"ci": r"^\.github/workflows/|^\.gitlab-ci\.yml$|^\.circleci/|^Jenkinsfile$|^\.travis\.yml$", "readme": r"(?i)^readme(\.|$)", "docs": r"(?i)^(docs?|documentation|website)/", "changelog": r"(?i)^(changelog|changes)(\.\w+)?$", "contributing": r"(?i)^contributing(\.\w+)?$", "licence": r"(?i)^(licen[cs]e|copying)(\.|$)"}
# Frameworks and libraries of a project by its dependencies (and files), the first that fits of each kind but frameworks.
FRAMEWORKS = (
    ("Next.js", r"^next$", r"^next\.config\."), ("React", r"^react$", None), ("Vue", r"^vue$", None), ("Angular", r"^@angular/core$", None), ("Svelte", r"^svelte$", None), ("Express", r"^express$", None), ("NestJS", r"^@nestjs/core$", None),
    ("Android", None, r"(^|/)AndroidManifest\.xml$"), ("Jetpack Compose", r"androidx\.compose", None), ("SwiftUI", None, r"\.swift$"), ("Django", r"(?i)^django$", r"(^|/)manage\.py$"), ("Flask", r"(?i)^flask$", None), ("FastAPI", r"(?i)^fastapi$", None),
    ("Spring Boot", r"org\.springframework\.boot", None), ("Flutter", None, r"(^|/)pubspec\.yaml$"), ("Rails", r"^rails$", None),
)
MARKERS = {
    "network": ((r"^axios$", "axios"), (r"^ky$", "ky"), (r"^got$", "got"), (r"@trpc/", "tRPC"), (r"(?i)okhttp", "OkHttp"), (r"(?i)retrofit", "Retrofit"), (r"(?i)ktor-client", "Ktor"), (r"(?i)^httpx$", "httpx"), (r"(?i)^requests$", "requests"), (r"(?i)^aiohttp$", "aiohttp"), (r"(?i)^alamofire$", "Alamofire"), (r"^dio$", "dio"), (r"^reqwest$", "reqwest")),
    "database": ((r"^prisma$|@prisma/client", "Prisma"), (r"^drizzle-orm$", "Drizzle"), (r"^typeorm$", "TypeORM"), (r"^knex$", "Knex"), (r"^mongoose$", "Mongoose"), (r"^sequelize$", "Sequelize"), (r"(?i)androidx\.room", "Room"), (r"(?i)^realm", "Realm"), (r"(?i)sqldelight", "SQLDelight"), (r"(?i)^sqlalchemy$", "SQLAlchemy"), (r"(?i)^psycopg2?$", "PostgreSQL"), (r"(?i)^pymongo$", "MongoDB"), (r"(?i)hibernate", "Hibernate"), (r"(?i)^gorm\.io", "GORM"), (r"^diesel$", "Diesel")),
    "state": ((r"^redux$|@reduxjs/toolkit", "Redux Toolkit"), (r"^zustand$", "Zustand"), (r"^jotai$", "Jotai"), (r"^mobx$", "MobX"), (r"@tanstack/react-query|^react-query$", "TanStack Query"), (r"(?i)androidx\.lifecycle.*viewmodel", "ViewModel"), (r"(?i)io\.insert-koin|dagger|hilt", "DI-managed state"), (r"^riverpod$|flutter_riverpod", "Riverpod"), (r"^flutter_bloc$|^bloc$", "BLoC")),
}


def _any(items: Column, pattern: str | None) -> Column:
    return F.exists(items, lambda x: x.rlike(pattern)) if pattern else F.lit(False)


def architecture(paths: Column, names: Column) -> Column:
    """struct(pattern, score): the architecture all of whose signs are in paths or spaced names (lower case), with 0.25 for each supporting sign; the first of the best, or null."""
    text = F.concat(F.lower(F.array_join(paths, "\n")), F.lit("\n"), F.lower(F.array_join(names, " ")))
    found = []
    for k, (name, needs, supports) in enumerate(ARCHITECTURES):
        ok = F.lit(True)
        for p in needs:
            ok = ok & text.rlike(f"(?im){p}")
        score = sum((F.when(text.rlike(f"(?im){p}"), 0.25).otherwise(0.0) for p in supports), F.lit(1.0))
        found.append(F.when(ok, F.struct((-score).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("pattern"))))
    best = F.array_min(F.array_compact(F.array(*found)))
    return F.when(best.isNotNull(), F.struct(best["pattern"].alias("pattern"), (-best["s"]).alias("score")))


def architecture_confidence(found: Column, named: Column, modules: Column) -> Column:
    base = F.when(found.isNotNull(), 0.4 + F.least(F.lit(0.25), (found["score"] - 1) * 0.25)).otherwise(0.15)
    return F.least(F.lit(1.0), F.floor((base + F.when(named, 0.25).otherwise(0.0) + F.when(modules >= 3, 0.15).otherwise(0.0)) * 100 + 0.5) / 100)


def host(name: Column, topics: Column, description: Column, dependencies: Column, files: Column, language: Column) -> Column:
    """struct(framework, points): the host framework of most points (name 3, topic 2, description 1.5, dependency 2, file 2), two at least, the first listed of the best; else native where language and topics are known, else unknown."""
    found = []
    for k, (framework, named, said, depends, file, _) in enumerate(HOSTS):
        points = F.when(F.lower(name).rlike(f"(?i){named}"), 3.0).otherwise(0.0) + F.when(_any(F.transform(topics, F.lower), f"(?i){said}"), 2.0).otherwise(0.0) + F.when(F.lower(description).rlike(f"(?i){said}"), 1.5).otherwise(0.0)
        points = points + (F.when(_any(dependencies, f"(?i){depends}"), 2.0).otherwise(0.0) if depends else 0.0) + (F.when(_any(files, f"(?i){file}"), 2.0).otherwise(0.0) if file else 0.0)
        found.append(F.struct((-points).alias("p"), F.lit(k).alias("k"), F.lit(framework).alias("framework")))
    best = F.array_min(F.array(*found))
    known = language.isNotNull() & (F.size(topics) > 0)
    return F.when(best["p"] <= -2, F.struct(best["framework"].alias("framework"), (-best["p"]).alias("points"))).otherwise(F.struct(F.when(known, "native").otherwise("unknown").alias("framework"), F.lit(0.0).alias("points")))


def host_multiplier(framework: Column, target: Column) -> Column:
    """What a host that the target isn't takes from the match: 0.2 if the target names another, 0.55 if it is vague; target is a text of its stack."""
    low = F.lower(F.coalesce(target, F.lit("")))
    own = F.coalesce(*[F.when(framework == f, low.rlike(f"(?i){alias}")) for f, *_, alias in HOSTS])
    other = low.rlike(f"(?i){NAMED_STACK}")
    for f, *_, alias in HOSTS:
        other = other | ((framework != f) & low.rlike(f"(?i){alias}"))
    return F.when(own.isNull() | (low == "") | own, 1.0).when(other, 0.2).otherwise(0.55)


def deployment(prose: Column, topics: Column, dependencies: Column, files: Column) -> Column:
    """struct(target, confidence): client, server, universal or unknown, by points of dependencies (3), files (2), phrases (2), topics (1); one side has to have twice the other's."""

    def points(side: dict[str, str]) -> Column:
        return F.when(_any(dependencies, f"(?i){side['deps']}"), 3).otherwise(0) + F.when(_any(files, f"(?i){side['files']}"), 2).otherwise(0) + F.when(prose.rlike(f"(?i){side['phrases']}"), 2).otherwise(0) + F.when(F.array_join(topics, " ").rlike(f"(?i){side['topics']}"), 1).otherwise(0)

    c, s = points(CLIENT), points(SERVER)
    told = lambda name, sure: F.struct(F.lit(name).alias("target"), sure.alias("confidence"))
    sure = lambda n: F.least(F.lit(0.9), F.floor((0.4 + n * 0.1) * 10 + 0.5) / 10)
    return (
        F.when(c + s == 0, told("unknown", F.lit(0.1))).when((c >= 3) & (s >= 3), told("universal", F.lit(0.5))).when((c >= 2 * s) & (c >= 2), told("client", sure(c)))
        .when((s >= 2 * c) & (s >= 2), told("server", sure(s))).otherwise(told("unknown", F.lit(0.2)))
    )


def target_side(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(CLIENT["target"]), "client").when(low.rlike(SERVER["target"]), "server").otherwise("unknown")


def side_multiplier(found: Column, side: Column) -> Column:
    known = found["target"].isin("client", "server") & side.isin("client", "server")
    return F.when(known & (found["target"] != side) & (found["confidence"] >= 0.5), 0.25).otherwise(1.0)


def project(dependencies: Column, files: Column, directories: Column) -> Column:
    """struct(frameworks, network, database, state, architecture): what a target project is made of; directories are (path, role) in order of size."""
    frameworks = F.array_compact(F.array(*[F.when(_any(dependencies, d) | _any(files, f), n) for n, d, f in FRAMEWORKS]))
    first = {kind: F.coalesce(*[F.when(_any(dependencies, p), n) for p, n in marks]) for kind, marks in MARKERS.items()}
    roles = F.transform(directories, lambda d: d["role"])
    has = lambda r: F.array_contains(roles, r)
    shape = (
        F.when(has("domain model") & has("data access") & has("presentation"), "clean architecture (domain / data / presentation)").when(has("business logic") & has("data access"), "layered service architecture")
        .when(has("data access") & has("presentation"), "MVVM / layered").when(F.array_contains(frameworks, "Next.js"), "Next.js app structure").when(F.array_contains(frameworks, "Django"), "Django MTV")
        .when(F.array_contains(frameworks, "Rails"), "Rails MVC").when(F.size(directories) <= 3, "flat / single-module")
    )
    return F.struct(frameworks.alias("frameworks"), *[c.alias(n) for n, c in first.items()], shape.alias("architecture"))


def detect(files: DataFrame, entity: str, path: str, rules: Rules, least: float = 1.0, support: float = 0.25) -> DataFrame:
    """(entity, kind, points, margin): the kind with most points, all of whose required rules are met by some file.

    A rule counts once for an entity however many files meet it; of equal kinds the one listed
    first wins; below least points an entity has no row. margin is the lead over the next kind.
    """
    met = [F.max(F.col(path).rlike(p).cast("int")).alias(f"r{k}") for k, (_, p, _, _) in enumerate(rules)]
    seen = files.groupBy(entity).agg(*met)
    kinds = list(dict.fromkeys(k for k, *_ in rules))
    scores = []
    for n, kind in enumerate(kinds):
        own = [(k, points, needed) for k, (name, _, points, needed) in enumerate(rules) if name == kind]
        total = sum((F.col(f"r{k}") * points for k, points, _ in own), F.lit(0.0))
        ok = F.lit(True)
        for k, _, needed in own:
            if needed:
                ok = ok & (F.col(f"r{k}") == 1)
        scores.append(F.struct(F.when(ok, total).otherwise(0.0).alias("points"), F.lit(-n).alias("ord"), F.lit(kind).alias("kind")))
    best = F.reverse(F.array_sort(F.array(*scores)))
    got = seen.select(entity, best.alias("b"))
    return got.select(entity, F.col("b")[0]["kind"].alias("kind"), F.col("b")[0]["points"].alias("points"), (F.col("b")[0]["points"] - F.coalesce(F.get("b", F.lit(1))["points"], F.lit(0.0))).alias("margin")).filter(F.col("points") >= least)


def quality(files: DataFrame, entity: str, path: str) -> DataFrame:
    """(entity, files, test_files, has_...): what accompanies the code, by where files lie."""
    has = [F.max(F.col(path).rlike(p)).alias(f"has_{n}") for n, p in QUALITY_FILES.items()]
    return files.groupBy(entity).agg(F.count("*").alias("files"), F.count_if(F.col(path).rlike(TEST_PATHS)).alias("test_files"), *has)


def tests(files: DataFrame, entity: str, path: str, content: str) -> DataFrame:
    """(entity, test_files, frameworks, edge_cases): from files that look like tests; names are sorted."""
    rows = files.filter(F.col(path).rlike(TEST_PATHS))
    spaced = F.regexp_replace(F.regexp_replace(content, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]+", " ")  # names are read word by word
    named = lambda rules, text: [F.when(text.rlike(p), n) for n, p in rules.items()]
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy(entity).agg(F.count("*").alias("test_files"), flat(F.array_compact(F.array(*named(TEST_FRAMEWORKS, F.col(content))))).alias("frameworks"), flat(F.array_compact(F.array(*named(EDGE_CASES, spaced)))).alias("edge_cases"))


def directories(files: DataFrame, entity: str, path: str, most: int = 10) -> DataFrame:
    """(entity, directory, n): the directories with most files."""
    top = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    counted = files.groupBy(entity, top.alias("directory")).agg(F.count("*").alias("n")).filter("directory <> ''")
    order = Window.partitionBy(entity).orderBy(F.desc("n"), "directory")
    return counted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def mean_depth(files: DataFrame, entity: str, path: str) -> DataFrame:
    return files.groupBy(entity).agg(F.avg(F.size(F.split(path, "/"))).alias("mean_depth"))


def substitutions(deps: DataFrame, target: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(group, source, replacement): a dependency that does what a library of the target does already."""
    rows = [(g, m, k) for g, ms in groups.items() for k, m in enumerate(ms)]
    table = F.broadcast(deps.sparkSession.createDataFrame(rows, "grp string, member string, ord int"))  # as long as the rules
    mine = deps.join(table, F.contains(F.lower("name"), F.col("member"))).select("grp", F.col("member").alias("source"))
    theirs = target.join(table, F.contains(F.lower("name"), F.col("member"))).groupBy("grp").agg(F.min_by("member", "ord").alias("replacement"))
    return mine.join(theirs, "grp").filter("source <> replacement").select(F.col("grp").alias("group"), "source", "replacement").distinct()
