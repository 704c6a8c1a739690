"""Queries by rules over names, symbols, tests and constraints that are written from parts; their SQL computes from the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import scores as sc
from evidra.operators import bundling as bd
from evidra.operators import matching, planning, profiles, verifying
from evidra.plans.files import _FILLS, _filled, _filled_sql
from evidra.plans.literals import values, vocabulary
from evidra.plans.names import _IDENT
from evidra.plans.reads import _at, _pick
from evidra.sources.tables import table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def implication_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation leads to, by two edges each, in six steps at most."""
    key = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(key.alias("s"), F.explode(F.array((key * 2) % 25, (key * 3 + 1) % 25)).alias("d"))
    return matching.closure(edges, "s", "d", 6)


#: What a symbol's name ends with, and what a folder is called.
ENDS = ("Manager", "Worker", "Queue", "Handler", "Store", "Adapter", "", "CacheThing", "Logger", "Builder", "Error", "Policy")
FOLDERS = ("src", "Models", "db", "views", "api", "di", "utils", "jobs", "usecase", "settings", "spec", "{b}")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of a symbol by its name, and of a folder by its own."""
    key = F.col("p_partkey")
    name = F.concat(_filled(F.lit("{c}")), _pick(key, *ENDS))
    rows = _part(spark, sf_dir).select("p_partkey", name.alias("name"), _filled(_pick(key, *FOLDERS)).alias("folder"))
    return rows.select("p_partkey", bd.symbol_role(F.col("name"), F.array(F.lit("Cache layer"))).alias("symbol"), bd.directory_role(F.col("folder")).alias("folder"))


def identifier_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a symbol's name is in the path of a file of another part's kind."""
    name = _filled(F.concat(_pick(F.col("p_partkey"), "{c}", "{u}_", "Old{c}"), _pick(F.col("p_size"), "Handler", "Things", "")))
    path = _filled(F.concat(F.lit("src/"), _pick(F.col("p_size"), "{b}/ring", "{a}", "thing/{b}", "handlers"), F.lit(".kt")))
    return _part(spark, sf_dir).select("p_partkey", verifying.mentions_identifier(F.lower(path), name).alias("there"))


_KINDS = tuple(verifying.CONSTRAINTS)


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a part, as a candidate, breaks what another was rejected for."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = _part(spark, sf_dir).select(
        "p_partkey", _pick(key, *_KINDS).alias("kind"), _pick(size, "gpl", "mit", "Ring", "bolt policy", None).alias("subject"), _pick(size, "ADAPT", "DO_NOT_USE", "ADAPT").alias("reuse_mode"),
        _pick(key, "permissive", "strong-copyleft", "unknown").alias("license_category"), _pick(size, "MIT", "GPL-3.0", None).alias("license_spdx"), F.array(_filled(F.lit("x:{a}")), F.lower("p_type")).alias("dependencies"),
        ((size % 10) / 10.0).alias("stack_match"), _pick(size, "low", "high", "very-high").alias("difficulty"), (key % 7 == 0).alias("archived"), (size * 20).alias("days_since_push"),
        F.array(F.struct(F.concat("p_name", F.lit(" policy")).alias("requirement"), _pick(size, "absent", "evidenced").alias("status"))).alias("items"),
    )
    return rows.select("p_partkey", verifying.violates(F.col("kind"), F.col("subject")).alias("violation"), verifying.described(F.col("kind"), F.col("subject")).alias("constraint"))


#: Libraries, the concept that each serves, and its family.
LIBRARIES = (
    ("com.squareup.okhttp3:okhttp", "HTTP client", "square"), ("com.squareup.retrofit2:retrofit", "HTTP client", "retrofit"), ("io.ktor:ktor-client-core", "HTTP client", "ktor"),
    ("org.slf4j:slf4j-api", "logging", "log"), ("ch.qos.logback:logback-classic", "logging", "log"), ("androidx.room:room-runtime", "local database", "room"),
    ("androidx.room:room-ktx", "local database", "room"), ("io.realm:realm", "local database", "realm"), ("one:thing", None, None),
)


def duplicate_abstractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' libraries by what they deliver: concepts that several families serve."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", _pick(F.col("l_partkey"), *[n for n, _, _ in LIBRARIES]).alias("name")).distinct()
    return bd.duplicate_abstractions(rows, "l_suppkey", "name")


#: A library, its concept, and its place among those that do the same; null does nothing that counts.
OWN = (("x:realm", "local database", 1), ("g:gson", "serialisation", 0), ("okhttp", "HTTP client", 0), ("plain", None, None))
THEIRS = (("androidx.room:room", "local database", 0), ("ktor", "HTTP client", 2), ("moshi", "serialisation", 1), (None, None, None))
SHAPES = (("queue worker pattern", "layered queue worker", False), ("state machine", "clean domain data", True), ("state machine", None, False))


def adaptation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = _part(spark, sf_dir).select(
        "p_partkey", (size / 50.0).alias("stack_match"), _pick(size, "Kotlin", None).alias("language"), F.array(_pick(key, *[n for n, _, _ in OWN])).alias("dependencies"),
        F.array_compact(F.array(_pick(size, *[n for n, _, _ in THEIRS]))).alias("target_libraries"), _pick(key, *[a for a, _, _ in SHAPES]).alias("pattern"), _pick(key, *[b for _, b, _ in SHAPES]).alias("target_pattern"),
    )
    return bd.adaptation(rows, "p_partkey")


#: Where a symbol is, and what kind it is said to be.
PATHS = ("src/{b}/{c}.kt", "src/{u}/{c}.kt", "tests/test_{u}.py", ".github/workflows/{u}.yml", "docs/{a}.kt", "sample{c}/App.kt", "vendor/{a}.js", "src/{c}Strings.kt", "conf/{a}.toml")
SYMBOL_KINDS = ("class", "function", "constant", "interface", "enum")


def symbol_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a part's symbol is no implementation, and its score against two words."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = _filled(F.concat(_pick(size, "{c}", "get{c}", "MAX_RETRIES", "{u}_"), F.when(size % 4 != 2, _pick(key, *ENDS)).otherwise("")))
    rows = _part(spark, sf_dir).select("p_partkey", name.alias("name"), _filled(_pick(key, *PATHS)).alias("path"), _pick(size, *SYMBOL_KINDS).alias("kind"), F.lower("p_type").alias("purpose"), _filled(_pick(key, "fun {u}()", None)).alias("signature"))
    score = sc.symbol_score(F.array(F.lit("ring"), F.lit("economy")), F.col("name"), F.col("purpose"), F.col("path"), F.col("signature"), F.col("kind"))
    return rows.select("p_partkey", sc.noise(F.col("name"), F.col("path"), F.col("kind")).alias("reason"), F.floor(score * 100 + 0.5).cast("long").alias("score"))


TEST_FILES = ("tests/test_{u}.py", "src/{a}.py", "src/__tests__/{a}.test.ts", "{c}Test.kt", "spec/{u}.rb")
TEST_TEXTS = ("import pytest\ndef test_timeout_and_empty_{u}(): pass", "vitest  mocha offline {b}", "junit mockk unicode conflict {c}", "unittest retryLimit {a} isMissing", "def go_{u}")


def test_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' test files: with what, and what about."""
    rows = _part(spark, sf_dir).select("p_brand", _filled(_pick(F.col("p_partkey"), *TEST_FILES)).alias("path"), _filled(_pick(F.col("p_size"), *TEST_TEXTS)).alias("content"))
    got = profiles.tests(rows, "p_brand", "path", "content")
    return got.select("p_brand", F.col("test_files").cast("long").alias("test_files"), F.array_join("frameworks", ",").alias("frameworks"), F.array_join("edge_cases", ",").alias("edge_cases"))


DEPENDENCIES = ("next", "@prisma/client", "zustand", "androidx.room:{a}", "com.squareup.okhttp3:okhttp", "Django", "requests", "express", "{a}")
TARGET_FILES = ("next.config.js", "src/index.ts", "app/src/main/AndroidManifest.xml", "manage.py", "{u}.swift", "pubspec.yaml")
DIRECTORY_ROLES = ("presentation", "data access", "domain model", "business logic", "{b}")


def target_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as target projects of three dependencies, two files and up to four directories each."""
    key, size = F.col("p_partkey"), F.col("p_size")
    role = lambda c: _filled(_pick(c, *DIRECTORY_ROLES))
    dirs = F.slice(F.array(*[F.struct(F.lit(f"d{k}").alias("path"), role(size + k * key).alias("role")) for k in range(4)]), F.lit(1), (key % 5).cast("int"))
    rows = _part(spark, sf_dir).select(
        "p_partkey", profiles.project(F.array(*[_filled(_pick(key + k * size, *DEPENDENCIES)) for k in (0, 1, 4)]), F.array(*[_filled(_pick(size + k, *TARGET_FILES)) for k in (0, 3)]), dirs).alias("p")
    )
    return rows.select("p_partkey", F.array_join("p.frameworks", ",").alias("frameworks"), "p.network", "p.database", "p.state", "p.architecture")


#: A requirement, and of it what no trigger is in and no found capability's words cover.
ASKS = (
    ("Build the of {u}, {b} import with retry {b} and a plain question", ("{b} import", "retry {b}")),
    ("it is {b}; export of {b} things · say where it is", ("export of {b} things",)),
    ("Short question and that, 99 {b}s, and {b} reports plus the {b} queue", ("{b} reports", "{b} queue")),
)


def unrecognised_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select("p_partkey", _filled(_pick(F.col("p_partkey"), *[a for a, _ in ASKS])).alias("text"))
    return planning.decompose(rows, "p_partkey", "text", vocabulary(spark))[2]


#: What a project is made of: paths, names of symbols in words, its own name, topics, description, dependencies and language.
PROJECT_PATHS = ("src/JobQueue.kt", "app/domain/{u}.kt", "app/src/main/AndroidManifest.xml", "src/main/resources/application.yml", "pubspec.yaml", "lib/{u}.dart", "app/data/{b}.kt")
PROJECT_NAMES = ("download queue", "upload worker", "user service", "user controller", "event bus", "event listener", "{a} store", "state machine", "plugin registry")
PROJECT_SAID = ("{a}", "react-native-{a}", "flutter_{u}", "electron-{a}", "backend for {b}", "an android library for {b}")
PROJECT_TOPICS = ("{b}", "android", "backend", "react-native", "flutter")
PROJECT_DEPENDENCIES = ("androidx.core:core", "org.springframework:spring-web", "org.postgresql:postgresql", "react-native", "vue", "{a}")


def project_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as projects: the architecture that their names and paths show, what they are made for, and on which side of the wire."""
    key, size = F.col("p_partkey"), F.col("p_size")
    put = lambda k, items: _filled(_pick(k, *items))
    rows = _part(spark, sf_dir).select(
        "p_partkey", F.array(put(key, PROJECT_PATHS), put(key + size, PROJECT_PATHS)).alias("paths"), F.array(put(size, PROJECT_NAMES), put(size + key, PROJECT_NAMES)).alias("names"), put(size, PROJECT_SAID).alias("name"),
        F.array(put(key, PROJECT_TOPICS)).alias("topics"), put(key, PROJECT_SAID).alias("description"), F.array(put(size + key, PROJECT_DEPENDENCIES)).alias("dependencies"), _pick(key, "Kotlin", None).alias("language"),
    )
    host = profiles.host(F.col("name"), F.col("topics"), F.col("description"), F.col("dependencies"), F.col("paths"), F.col("language"))
    side = profiles.deployment(F.concat_ws(" ", "name", "description"), F.col("topics"), F.col("dependencies"), F.col("paths"))
    rows = rows.select("p_partkey", profiles.architecture(F.col("paths"), F.col("names")).alias("a"), host.alias("h"), side.alias("d"))
    whole = lambda c: F.floor(c * 100 + 0.5).cast("int")
    return rows.select("p_partkey", F.col("a.pattern").alias("pattern"), whole(F.col("a.score")).alias("score"), F.col("h.framework").alias("host"), F.col("d.target").alias("side"), whole(F.col("d.confidence")).alias("sure"))


QUERIES = {f.__name__: f for f in (
    project_kinds, implication_closure, roles, identifier_mentions, constraint_violations, duplicate_abstractions, adaptation_steps, symbol_noise, test_profiles, target_profiles, unrecognised_fragments,
)}


def _quote(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _dealt(key: str, items) -> str:
    """The item of a list that a key deals."""
    return f"([{', '.join(map(_quote, items))}][{key} % {len(items)} + 1])"


def _first(column: str, rules, last: str = "null", flags: str = "") -> str:
    """The name of the first pattern that fits."""
    return "case " + " ".join(f"when regexp_matches({column}, '{flags}{p.replace(chr(39), chr(39) * 2)}') then {_quote(n)}" for p, n in rules) + f" else {last} end"


def _score_sql() -> str:
    words = f"string_split({_IDENT.format('name')}, ' ')"
    low = lambda c: f"lower(coalesce({c}, ''))"
    worth = lambda t: f"case when list_contains({words}, '{t}') then 0.35e0 when contains({low('name')}, '{t}') then 0.25e0 when contains({low('purpose')}, '{t}') then 0.12e0 when contains({low('path')}, '{t}') then 0.10e0 when contains({low('signature')}, '{t}') then 0.06e0 else 0e0 end"
    bonus = f"""case when regexp_matches({_IDENT.format('name')}, '{sc.ROLE}') then 0.15e0 else 0e0 end + case when kind in ('class', 'interface') then 0.1e0 else 0e0 end - case when kind in ('constant', 'enum') then 0.3e0 else 0e0 end
        - case when regexp_matches(name, '^[A-Z0-9_]{{6,}}$') then 0.3e0 else 0e0 end - case when regexp_matches(path, '(?i)(^|/)(test|tests|spec|__tests__|androidTest)/') then 0.45e0 else 0e0 end
        - case when regexp_matches(path, '(?i)(^|/)(example|examples|sample|samples|demo)/') then 0.35e0 else 0e0 end"""
    return f"cast(floor(floor(greatest(0e0, least(1e0, {worth('ring')} + {worth('economy')} + {bonus})) * 100e0 + 0.5e0) / 100e0 * 100e0 + 0.5e0) as bigint)"


_ROLE_SQL = f"regexp_matches({_IDENT.format('name')}, '{sc.ROLE}')"
_NAMED_SQL = "case " + " ".join(f"when regexp_matches({'name' if p.startswith('^') else _IDENT.format('name')}, '{p}') then '{n}'" for p, n in sc.NOISE_NAMES) + " end"
_ALWAYS_SQL = f"regexp_matches({_IDENT.format('name')}, '(?i)\\b(logger|logging|analytics|telemetry|tracking)\\b')"
_SYMBOLS_SQL = f"""s as (select p_partkey, {_filled_sql(_dealt('p_size', ('{c}', 'get{c}', 'MAX_RETRIES', '{u}_')))} || case when p_size % 4 <> 2 then {_dealt('p_partkey', ENDS)} else '' end as name, {_filled_sql(_dealt('p_partkey', PATHS))} as path,
        {_dealt('p_size', SYMBOL_KINDS)} as kind, lower(p_type) as purpose, {_filled_sql(_dealt('p_partkey', ('fun {u}()', None)))} as signature from part)"""
_TESTS_SQL = f"""f as (select p_brand, {_filled_sql(_dealt('p_partkey', TEST_FILES))} as path, {_filled_sql(_dealt('p_size', TEST_TEXTS))} as content from part),
        t as (select *, regexp_replace(regexp_replace(content, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]+', ' ', 'g') as spaced from f where regexp_matches(path, '{profiles.TEST_PATHS}')),
        h as (select p_brand, 'f' as kind, n from t, {values(tuple(profiles.TEST_FRAMEWORKS.items()), 'n, p')} where regexp_matches(content, p) union select p_brand, 'e', n from t, {values(tuple(profiles.EDGE_CASES.items()), 'n, p')} where regexp_matches(spaced, p))"""
_PROJECTS_SQL = f"""p as (select p_partkey, [{', '.join(_filled_sql(_dealt(f'(p_partkey + {k} * p_size)', DEPENDENCIES)) for k in (0, 1, 4))}] as deps, [{', '.join(_filled_sql(_dealt(f'(p_size + {k})', TARGET_FILES)) for k in (0, 3))}] as files,
        [{', '.join(_filled_sql(_dealt(f'(p_size + {k} * p_partkey)', DIRECTORY_ROLES)) for k in range(4))}][1:p_partkey % 5] as roles from part)"""


def _some(items: str, pattern: str | None) -> str:
    return f"len(list_filter({items}, lambda x: regexp_matches(x, {_quote(pattern)}))) > 0" if pattern else "false"


_FRAMEWORKS_SQL = "list_filter([" + ", ".join(f"case when {_some('deps', d)} or {_some('files', f)} then '{n}' end" for n, d, f in profiles.FRAMEWORKS) + "], lambda x: x is not null)"
_MARK_SQL = {kind: "case " + " ".join(f"when {_some('deps', p)} then '{n}'" for p, n in marks) + " end" for kind, marks in profiles.MARKERS.items()}
_put = lambda key, items: _filled_sql(_dealt(f"({key})", items))
_KINDS_SQL = f"""p as (select p_partkey, [{_put('p_partkey', PROJECT_PATHS)}, {_put('p_partkey + p_size', PROJECT_PATHS)}] as files, [{_put('p_size', PROJECT_NAMES)}, {_put('p_size + p_partkey', PROJECT_NAMES)}] as names, {_put('p_size', PROJECT_SAID)} as name,
        {_put('p_partkey', PROJECT_TOPICS)} as topic, {_put('p_partkey', PROJECT_SAID)} as said, [{_put('p_size + p_partkey', PROJECT_DEPENDENCIES)}] as deps, p_partkey % 2 = 0 as known from part)"""
_SHAPE_TEXT = "lower(array_to_string(files, chr(10))) || chr(10) || lower(array_to_string(names, ' '))"
_fits = lambda p: f"regexp_matches(text, {_quote('(?im)' + p)})"
_SHAPE_SQL = "[" + ", ".join(f"case when {' and '.join(map(_fits, needs))} then [{' + '.join(['100', *[f'25 * cast({_fits(x)} as int)' for x in more]])}, {-k}] end" for k, (_, needs, more) in enumerate(profiles.ARCHITECTURES)) + "]"
_when = lambda test, n: f"case when {test} then {n} else 0 end"
_like = lambda column, p: f"regexp_matches(lower({column}), {_quote('(?i)' + p)})"
_HOST_SQL = "[" + ", ".join("[" + " + ".join([_when(_like("name", a), 30), _when(_like("topic", b), 20), _when(_like("said", b), 15), _when(_some("deps", d and "(?i)" + d), 20), _when(_some("files", f and "(?i)" + f), 20)]) + f", {-k}]" for k, (_, a, b, d, f, _) in enumerate(profiles.HOSTS)) + "]"
_SIDE_SQL = {n: " + ".join([_when(_some("deps", "(?i)" + x["deps"]), 3), _when(_some("files", "(?i)" + x["files"]), 2), _when(f"regexp_matches(name || ' ' || said, {_quote('(?i)' + x['phrases'])})", 2), _when(f"regexp_matches(topic, {_quote('(?i)' + x['topics'])})", 1)]) for n, x in (("c", profiles.CLIENT), ("s", profiles.SERVER))}
_ASKED = [(k, n, f) for k, (_, found) in enumerate(ASKS) for n, f in enumerate(found)]
SQL = {
    "implication_closure": """with recursive e as (select n_nationkey as s, unnest([(n_nationkey * 2) % 25, (n_nationkey * 3 + 1) % 25]) as d from nation),
        w as (select s as origin, d as reached, 1 as steps from e union select w.origin, e.d, w.steps + 1 from w join e on e.s = w.reached where w.steps < 6)
        select origin, reached, cast(min(steps) as bigint) as steps from w group by 1, 2""",
    "roles": f"""with n as (select p_partkey, {_FILLS['{c}']} || {_dealt('p_partkey', ENDS)} as name, {_filled_sql(_dealt('p_partkey', FOLDERS))} as f from part)
        select p_partkey, case when contains(lower(name), 'cache') then 'Cache layer' else {_first('name', bd.ROLES, "'core implementation'")} end as symbol, {_first('f', bd.DIRECTORIES, flags='(?i)')} as folder from n""",
    "identifier_mentions": f"""with n as (select p_partkey, {_filled_sql(_dealt('p_partkey', ('{c}', '{u}_', 'Old{c}')) + ' || ' + _dealt('p_size', ('Handler', 'Things', '')))} as name,
              lower({_filled_sql("'src/' || " + _dealt('p_size', ('{b}/ring', '{a}', 'thing/{b}', 'handlers')) + " || '.kt'")}) as path from part),
        w as (select *, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]', ' ', 'g')), '\\s+'), lambda w: length(w) >= 4) as ws from n),
        m as (select *, list_filter(ws, lambda w: contains(path, w) or contains(path, regexp_replace(w, 's$', ''))) as met, list_sort(list_transform(ws, lambda w, i: [lpad(cast(100 - length(w) as varchar), 3, '0'), lpad(cast(i as varchar), 3, '0'), w]))[1][3] as longest from w)
        select p_partkey, case when len(ws) = 0 then contains(path, lower(name)) else len(met) > 0 and (2 * len(met) >= len(ws) or (length(longest) >= 6 and list_contains(met, longest))) end as there from m""",
    "constraint_violations": f"""with c as (select p_partkey, p_size, p_name, {_dealt('p_partkey', _KINDS)} as kind, {_dealt('p_size', ('gpl', 'mit', 'Ring', 'bolt policy', None))} as subject, {_dealt('p_size', ('ADAPT', 'DO_NOT_USE', 'ADAPT'))} as mode,
              {_dealt('p_partkey', ('permissive', 'strong-copyleft', 'unknown'))} as category, {_dealt('p_size', ('MIT', 'GPL-3.0', None))} as spdx, ['x:' || {_FILLS['{a}']}, lower(p_type)] as deps from part),
        w as (select *, lower(subject) as low, list_filter(deps, lambda d: contains(lower(d), lower(subject)))[1] as dep,
              len(list_filter(string_split(lower(subject), ' '), lambda x: length(x) >= 4 and contains(lower(p_name) || ' policy', x))) > 0 as named from c)
        select p_partkey, case kind when 'license-incompatible' then case when mode = 'DO_NOT_USE' then 'licence ' || coalesce(spdx, 'unknown') || ' is incompatible' when category = 'strong-copyleft' then 'licence ' || coalesce(spdx, 'unknown') || ' is ' || category
                 when contains(lower(spdx), low) then 'also ' || spdx end
               when 'dependency-incompatible' then 'also depends on ' || dep
               when 'stack-mismatch' then case when p_size % 10 < 6 then 'stack match is only ' || (p_size % 10) * 10 || '%' end
               when 'too-complex' then case when p_size % 3 > 0 then 'integration difficulty is ' || {_dealt('p_size', ('low', 'high', 'very-high'))} end
               when 'unmaintained' then case when p_partkey % 7 = 0 then 'also archived' when p_size * 20 > 365 then 'also stale (last activity ' || p_size * 20 || 'd ago)' end
               when 'missing-capability' then case when named and p_size % 2 = 0 then 'also lacks "' || p_name || ' policy"' end end as violation,
               {_dealt('p_partkey', tuple(verifying.CONSTRAINTS.values()))} || coalesce(' (' || subject || ')', '') as "constraint" from w""",
    "duplicate_abstractions": f"""with d as (select distinct l_suppkey, l_partkey % {len(LIBRARIES)} as k from lineitem), l as (select * from {values([(k, c, f) for k, (_, c, f) in enumerate(LIBRARIES)], 'k, concept, family')})
        select concept, count(distinct family) as families, count(distinct l_suppkey) as entities from d join l using (k) where concept is not null group by 1 having count(distinct family) > 1""",
    "adaptation_steps": f"""with c as (select p_partkey, p_size, {_dealt('p_partkey', [c for _, c, _ in OWN])} as own, [{', '.join('null' if n is None else str(n) for _, _, n in OWN)}][p_partkey % {len(OWN)} + 1] as a, {_dealt('p_size', [c for _, c, _ in THEIRS])} as their,
              [{', '.join('null' if n is None else str(n) for _, _, n in THEIRS)}][p_size % {len(THEIRS)} + 1] as b, {_dealt('p_partkey', [t for _, t, _ in SHAPES])} as shape, [{', '.join(str(x).lower() for _, _, x in SHAPES)}][p_partkey % {len(SHAPES)} + 1] as reshaped from part),
        s as (select p_partkey, 1 as ord, 'port into ' || case when p_size % 2 = 0 then 'Kotlin' else 'your language' end as action, 'large' as effort from c where p_size / 50e0 < 0.35e0
              union all select p_partkey, 2, case when own = their then 'replace ' else 'decide on ' end || own, 'medium' from c where own is not null and not coalesce(own = their and a = b, false)
              union all select p_partkey, 3, 'reshape into ' || shape, 'medium' from c where reshaped union all select p_partkey, 4, 'test what was adapted', 'small' from c)
        select p_partkey, row_number() over (partition by p_partkey order by ord) as step, action, effort from s""",
    "symbol_noise": f"""with {_SYMBOLS_SQL}
        select p_partkey, coalesce({_first('path', sc.NOISE_PATHS)}, case when (kind in ('constant', 'enum') or regexp_matches(name, '^[A-Z0-9_]{{6,}}$')) and not {_ROLE_SQL} then {_quote(sc.CONSTANT)} end,
               case when not {_ROLE_SQL} or {_ALWAYS_SQL} then {_NAMED_SQL} end) as reason, {_score_sql()} as score from s""",
    "test_profiles": f"""with {_TESTS_SQL}, c as (select p_brand, count(*) as test_files from t group by 1)
        select p_brand, test_files, coalesce((select string_agg(n, ',' order by n) from h where h.p_brand = c.p_brand and kind = 'f'), '') as frameworks, coalesce((select string_agg(n, ',' order by n) from h where h.p_brand = c.p_brand and kind = 'e'), '') as edge_cases from c""",
    "target_profiles": f"""with {_PROJECTS_SQL}, f as (select *, {_FRAMEWORKS_SQL} as fs from p)
        select p_partkey, array_to_string(fs, ',') as frameworks, {_MARK_SQL['network']} as network, {_MARK_SQL['database']} as database, {_MARK_SQL['state']} as state,
               case when list_has_all(roles, ['domain model', 'data access', 'presentation']) then 'clean architecture (domain / data / presentation)' when list_has_all(roles, ['business logic', 'data access']) then 'layered service architecture'
                    when list_has_all(roles, ['data access', 'presentation']) then 'MVVM / layered' when list_contains(fs, 'Next.js') then 'Next.js app structure' when list_contains(fs, 'Django') then 'Django MTV' when list_contains(fs, 'Rails') then 'Rails MVC'
                    when len(roles) <= 3 then 'flat / single-module' end as architecture from f""",
    "unrecognised_fragments": f"select p_partkey, {_filled_sql('f')} as fragment from part join {values(_ASKED, 'k, n, f')} on k = p_partkey % {len(ASKS)}",
    "project_kinds": f"""with {_KINDS_SQL}, t as (select *, {_SHAPE_TEXT} as text from p),
        r as (select *, list_sort(list_filter({_SHAPE_SQL}, lambda x: x is not null), 'DESC')[1] as a, list_sort({_HOST_SQL}, 'DESC')[1] as h, {_SIDE_SQL['c']} as c, {_SIDE_SQL['s']} as s from t)
        select p_partkey, [{', '.join(_quote(n) for n, _, _ in profiles.ARCHITECTURES)}][1 - a[2]] as pattern, a[1] as score, case when h[1] >= 20 then [{', '.join(_quote(x[0]) for x in profiles.HOSTS)}][1 - h[2]] when known then 'native' else 'unknown' end as host,
               case when c + s = 0 then 'unknown' when c >= 3 and s >= 3 then 'universal' when c >= 2 * s and c >= 2 then 'client' when s >= 2 * c and s >= 2 then 'server' else 'unknown' end as side,
               case when c + s = 0 then 10 when c >= 3 and s >= 3 then 50 when c >= 2 * s and c >= 2 then least(90, 40 + 10 * c) when s >= 2 * c and s >= 2 then least(90, 40 + 10 * s) else 20 end as sure from r""",
}
