"""Queries over project and source files that are written from parts: each part is a repository, its columns are names and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.plans.literals import values
from evidra.sources import manifests, modules, symbols, table_text
from evidra.sources.tables import table

# What is filled in: {a} the name with dashes, {c} in camel case, {u} with underscores, {b} the type, {v} and {w} versions.
#: A file's path and content, and what it declares: (name, version, scope, inferred).
MANIFESTS = (
    ("package.json", "npm", '{"devDependencies":{"{b}-dev":"~{w}"},"dependencies":{"{a}":"^{v}","react":"18"},"peerDependencies":{"{a}-peer":"*"},"optionalDependencies":{"opt-{b}":"{w}"},"dependenciesMeta":{"x":{"y":1}}}',
     (("{a}", "^{v}", "runtime", False), ("react", "18", "runtime", False), ("{b}-dev", "~{w}", "dev", False), ("{a}-peer", "*", "peer", False), ("opt-{b}", "{w}", "optional", False))),
    ("build.gradle.kts", "gradle", 'dependencies {\n  implementation("com.{b}:{a}:{v}")\n  testImplementation("junit:{a}-junit:{w}")\n  ksp("androidx.{b}:{a}-compiler:{v}")\n  implementation("androidx.room:{a}-runtime:$room")\n  implementation(libs.{b})\n classpath("com.tools:{a}-gradle:{w}")\n}',
     (("com.{b}:{a}", "{v}", "runtime", False), ("junit:{a}-junit", "{w}", "test", False), ("androidx.{b}:{a}-compiler", "{v}", "build", False), ("androidx.room:{a}-runtime", None, "runtime", True),
      ("libs.{b}", None, "runtime", True), ("com.tools:{a}-gradle", "{w}", "build", False))),
    ("libs.versions.toml", "gradle", '[libraries]\n{u} = { module = "com.{b}:{a}", version = "{w}" }\nwork = { group = "androidx.{b}", name = "{a}", version.ref = "{u}" }\n',
     (("com.{b}:{a}", "{w}", "runtime", False), ("androidx.{b}:{a}", "{u}", "runtime", False))),
    ("pom.xml", "maven", '<project xmlns="http://maven.apache.org/POM/4.0.0">\n<dependencies><!-- <dependency><groupId>old</groupId><artifactId>{a}</artifactId></dependency> -->\n<dependency><version>{v}</version><artifactId>{a}</artifactId><groupId>org.{b}</groupId></dependency>\n'
     "<dependency><groupId>junit</groupId><artifactId> {a}-test </artifactId><version>${{u}.version}</version><scope>test</scope></dependency></dependencies>\n<dependencyManagement><dependencies><dependency><groupId>bom</groupId><artifactId>{b}</artifactId><scope>provided</scope></dependency></dependencies></dependencyManagement></project>",
     (("org.{b}:{a}", "{v}", "runtime", False), ("junit:{a}-test", "${{u}.version}", "test", True), ("bom:{b}", None, "build", False))),
    ("requirements-dev.txt", "pypi", "{a}>={v}\n# {b}\n-e .\n{u}[extra]=={w} ; python_version > '3'\n", (("{a}", ">={v}", "dev", False), ("{u}", "=={w}", "dev", False))),
    ("pyproject.toml", "pypi", '[project]\ndependencies = ["{a}>={v}", "{u}"]\n[tool.poetry.dependencies]\npython = "^3.11"\n{b} = "{w}"\n[tool.x]\ny = "1"\n',
     (("{a}", ">={v}", "runtime", False), ("{u}", None, "runtime", False), ("{b}", "{w}", "runtime", False))),
    ("setup.py", "pypi", "setup(install_requires=['{a}', \"{u}>={w}\"])", (("{a}", None, "runtime", False), ("{u}", ">={w}", "runtime", False))),
    ("Pipfile", "pypi", '[packages]\n{a} = "*"\n{u} = "=={v}"\n', (("{a}", "*", "runtime", False), ("{u}", "=={v}", "runtime", False))),
    ("Cargo.toml", "cargo", '[package]\nname = "x"\n[dependencies]\n{a} = { version = "{v}", features = ["{b}"] }\n{u} = "{w}"\n[dev-dependencies]\n{a}-dev = "{w}"\n[build-dependencies]\ncc-{b} = "1"\n',
     (("{a}", "{v}", "runtime", False), ("{u}", "{w}", "runtime", False), ("{a}-dev", "{w}", "dev", False), ("cc-{b}", "1", "build", False))),
    ("go.mod", "go", "module m\nrequire (\n\tgithub.com/{b}/{a} v{v}\n\tgolang.org/x/{b} v{w} // indirect\n)\nrequire github.com/one/{a} v0.1.0\n",
     (("github.com/{b}/{a}", "v{v}", "runtime", False), ("golang.org/x/{b}", "v{w}", "optional", False), ("github.com/one/{a}", "v0.1.0", "runtime", False))),
    ("composer.json", "composer", '{"require":{"php":">=8","{b}/{a}":"^{v}"},"require-dev":{"phpunit/{a}":"^{w}"}}', (("{b}/{a}", "^{v}", "runtime", False), ("phpunit/{a}", "^{w}", "dev", False))),
    ("Gemfile", "gem", "gem '{a}', '~> {w}'\ngem \"{u}\"\n", (("{a}", "~> {w}", "runtime", False), ("{u}", None, "runtime", False))),
    ("Package.swift", "swiftpm", '.package(url: "https://example.com/{b}/{a}.git", from: "{v}")', (("{b}/{a}", "{v}", "runtime", False),)),
    ("Podfile", "cocoapods", "pod '{c}', '~> {w}'\n", (("{c}", "~> {w}", "runtime", False),)),
    ("x.csproj", "nuget", '<Project Sdk="s"><ItemGroup><PackageReference Include="{c}" Version="{v}" />\n<PackageReference Version="{w}" Include="{c}.Core"/><PackageReference Include="{a}"><Version>{w}</Version></PackageReference></ItemGroup></Project>',
     (("{c}", "{v}", "runtime", False), ("{c}.Core", "{w}", "runtime", False), ("{a}", "{w}", "runtime", False))),
)
#: Where a part's second manifest is, which is of the kind that comes so many places later, and its others: vendored, too deep, no manifest, no JSON.
SECOND, LATER = "app/", 4
OTHERS = ("node_modules/x/package.json", "a/b/c/d/package.json", "README.md", "bad/package.json")
#: Source files: extension, content below p_size % 7 lines of notes, its symbols (name, kind, line without the notes), what it imports.
SOURCES = (
    ("kt", "package x\nimport {u}.flow\nclass {c}Manager {\n  fun {u}() {}\n}\nclass {c}Manager2\ninterface Queue{c}\nenum class State { A }\nsuspend fun retry_{u}() {}\nclass {c}Manager {}\n",
     (("{c}Manager", "class", 3), ("{u}", "function", 4), ("{c}Manager2", "class", 6), ("Queue{c}", "interface", 7), ("State", "enum", 8), ("retry_{u}", "function", 9)), ("{u}.flow",)),
    ("ts", "import { x } from './{a}'\nimport '{b}'\nexport class {c} {}\nexport type Id{c} = string\nexport async function run_{u}() {}\nfunction run_{u}() {}\n",
     (("{c}", "class", 3), ("Id{c}", "type", 4), ("run_{u}", "function", 5)), ("./{a}", "{b}")),
    ("py", "import os\nfrom {u}.{b} import c\nclass {c}:\n    def {u}(self):\n        pass\ndef {u}():\n    pass\n", (("{c}", "class", 3), ("{u}", "function", 4)), ("os", "{u}.{b}")),
    ("rs", "use std::{u}\npub struct {c}\nimpl {c}\ntrait {c}Shape\n", (("{c}", "struct", 2), ("{c}Shape", "struct", 4)), ("std::{u}",)),
    ("go", "func (s *T) Serve{c}() {}\nfunc main() {}\n", (("Serve{c}", "function", 1), ("main", "function", 2)), ()),
)
_NOTES = "// a note\n"


_FILLS = {
    "{a}": "replace(p_name, ' ', '-')",
    "{u}": "replace(p_name, ' ', '_')",
    "{c}": "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '')",
    "{b}": "lower(p_type)",
    "{v}": "p_size || '.' || (p_partkey % 10) || '.0'",
    "{w}": "(p_partkey % 97) || '.1'",
}


def _filled(template: Column) -> Column:
    key, text = F.col("p_partkey"), lambda c: c.cast("string")
    name = lambda put: F.replace("p_name", F.lit(" "), F.lit(put))
    fills = {
        "{a}": name("-"),
        "{u}": name("_"),
        "{c}": F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")),
        "{b}": F.lower("p_type"),
        "{v}": F.concat_ws(".", text(F.col("p_size")), text(key % 10), F.lit("0")),
        "{w}": F.concat_ws(".", text(key % 97), F.lit("1")),
    }
    for mark, value in fills.items():
        template = F.replace(template, F.lit(mark), value)
    return template


def _filled_sql(template: str) -> str:
    for mark, sql in _FILLS.items():
        template = f"replace({template}, '{mark}', {sql})"
    return template


def _picked(kinds: int, later: int = 0) -> Column:
    return F.pmod(F.col("p_partkey") + later, F.lit(kinds)).cast("int")


def _of(place: Column, items) -> Column:
    return F.get(F.array(*map(F.lit, items)), place)


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, ord, path, content): two manifests of each part, and files that aren't read as such."""
    paths, contents = [m[0] for m in MANIFESTS], [m[2] for m in MANIFESTS]
    here, there = _picked(len(MANIFESTS)), _picked(len(MANIFESTS), LATER)
    file = lambda ord_, path, content: F.struct(F.lit(ord_).alias("ord"), path.alias("path"), content.alias("content"))
    some = [file(k, F.lit(p), F.lit("{not json" if p.startswith("bad") else '{"dependencies":{"hidden":"1"}}')) for k, p in enumerate(OTHERS)]
    some += [file(10, F.concat(F.lit(SECOND), _of(there, paths)), _filled(_of(there, contents))), file(11, _of(here, paths), _filled(_of(here, contents)))]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo"), F.inline(F.array(*some)))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a part are manifests to read, shallow ones first."""
    return manifests.find_manifests(project_files(spark, sf_dir), "repo", "path", "ord").select("repo", "path", "ecosystem", "place")


def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifests.find_manifests(project_files(spark, sf_dir), "repo", "path", "ord").select("repo", "path", "content")
    return manifests.dependencies(found, "path", "content").select("repo", "path", "ecosystem", "name", "version", "scope", "inferred")


def runtime_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best declaration of each dependency, and of these what runs."""
    rows = manifest_dependencies(spark, sf_dir).withColumn("depth", F.size(F.split("path", "/"))).withColumn("low", F.lower("name"))
    best = manifests.best_declaration(rows, ["repo", "ecosystem", "low"], "depth")
    return best.filter(manifests.runs(F.col("scope"))).select("repo", "ecosystem", "name", "version")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content): a source file of each part."""
    kind = _picked(len(SOURCES))
    path = _filled(F.concat(F.lit("src/{b}/{u}."), _of(kind, [s[0] for s in SOURCES])))
    content = F.concat(F.repeat(F.lit(_NOTES), F.col("p_size") % 7), _filled(_of(kind, [s[1] for s in SOURCES])))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo"), path.alias("path"), content.alias("content"))


def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.declarations(source_files(spark, sf_dir), ["repo", "path"], "content").select("repo", "path", "name", "kind", F.col("line").cast("int"))


def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.imports(source_files(spark, sf_dir), ["repo", "path"], "content")


def symbol_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with their lines: a file is read once for all of them."""
    return modules.symbol_sources(source_files(spark, sf_dir), ["repo", "path"], "content", 3).select("repo", "name", "source")


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content): brands as repositories; each part's file imports the one before it, by module or by relative path, and others that aren't there."""
    module = _filled(F.concat(F.lit("{u}_"), F.col("p_partkey").cast("string")))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.lower("p_type").alias("kind"), module.alias("module"), (F.col("p_partkey") % 3).alias("form"))
    of = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = rows.withColumns({"kind1": F.lag("kind").over(of), "module1": F.lag("module").over(of)})
    suffix = F.when(F.col("form") == 0, ".py").when(F.col("form") == 1, ".ts").otherwise("/index.ts")
    line = (
        F.when(F.col("form") == 0, F.concat(F.lit("from pkg."), F.concat("kind1", F.lit("."), "module1"), F.lit(" import go\nimport os\n")))
        .when(F.col("form") == 1, F.concat(F.lit("import { go } from '../"), F.concat("kind1", F.lit("/"), "module1"), F.lit("'\n")))
        .otherwise(F.concat(F.lit("import { go } from '../../"), F.concat("kind1", F.lit("/"), "module1"), F.lit("'\nimport './gone'\n")))
    )
    return rows.select(F.col("p_brand").alias("repo"), F.concat(F.lit("src/pkg/"), F.concat_ws("/", "kind", "module"), suffix).alias("path"), F.coalesce(line, F.lit("")).alias("content"))


def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.resolved(linked_files(spark, sf_dir), "repo", "path", "content")


def file_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.importers(import_targets(spark, sf_dir))


#: Table text of a part: interned names, scalars, quoted and missing values, a value that isn't of its kind.
TABLES = (
    "#MUNCH/1 tool=list\n@6={b}/\n@66=@6main/\ncount={v} __tables=t:repos:repo|symbols|loadable:str|int|bool;u:others:x:str\n"
    't,@66{c},{s},T\nu,hidden\nt,"{a},x",,F\nt,@6{u},bad,true\nnothing\n'
)


def table_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", _filled(F.replace(F.lit(TABLES), F.lit("{s}"), F.col("p_size").cast("string"))).alias("text"))
    cells = table_text.from_column(rows, ["p_partkey"], "text")
    got = table_text.typed(cells, "repos", {"repo": "str", "symbols": "int", "loadable": "bool"}, ["p_partkey", "row"])
    return got.select("p_partkey", "row", "repo", F.col("symbols").cast("int").alias("symbols"), "loadable")


QUERIES = {f.__name__: f for f in (manifest_files, manifest_dependencies, runtime_dependencies, source_symbols, source_imports, symbol_sources, import_targets, file_importers, table_text_rows)}


def _manifests_sql() -> str:
    """part, with what its two manifests declare by the templates: (repo, path, ecosystem, name, version, scope, inferred)."""
    rows = [(k, path, eco, n, v, s, i) for k, (path, eco, _, deps) in enumerate(MANIFESTS) for n, v, s, i in deps]
    return f"""t as (select * from {values(rows, 'k, path, ecosystem, name, version, scope, inferred')}),
        w as (select *, unnest([0, {LATER}]) as later from part),
        d as (select p_partkey as repo, case when later = 0 then path else '{SECOND}' || path end as path, ecosystem, {_filled_sql('name')} as name, {_filled_sql('version')} as version, scope, inferred
              from w join t on k = (p_partkey + later) % {len(MANIFESTS)})"""


def _sources_sql() -> str:
    rows = [(k, ext, n, kind, line) for k, (ext, _, found, _) in enumerate(SOURCES) for n, kind, line in found]
    return f"""t as (select * from {values(rows, 'k, ext, name, kind, line')}),
        s as (select p_partkey as repo, {_filled_sql("'src/{b}/{u}.'")} || ext as path, {_filled_sql('name')} as name, kind, cast(line + p_size % 7 as integer) as line, k, p_size,
              {_filled_sql('[' + ', '.join(_text(x[1]) for x in SOURCES) + '][k + 1]')} as content from part join t on k = p_partkey % {len(SOURCES)})"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_IMPORTED = [(k, ext, i) for k, (ext, _, _, imported) in enumerate(SOURCES) for i in imported]
_LINKED = f"""b as (select p_brand, p_partkey, lower(p_type) as kind, {_filled_sql("'{u}_' || p_partkey")} as module, p_partkey % 3 as form from part),
        l as (select *, lag(kind) over o as kind1, lag(module) over o as module1, lag(form) over o as form1 from b window o as (partition by p_brand order by p_partkey)),
        f as (select p_brand as repo, form, kind1, module1, 'src/pkg/' || kind || '/' || module || ['.py', '.ts', '/index.ts'][form + 1] as path,
              'src/pkg/' || kind1 || '/' || module1 || ['.py', '.ts', '/index.ts'][form1 + 1] as target from l),
        g as (select repo, path, case form when 0 then 'pkg.' || kind1 || '.' || module1 when 1 then '../' || kind1 || '/' || module1 else '../../' || kind1 || '/' || module1 end as imported, target from f where kind1 is not null
              union all select repo, path, case form when 0 then 'os' else './gone' end, null from f where form <> 1 and kind1 is not null)"""
SQL = {
    "manifest_files": f"""with p as (select p_partkey as repo, unnest([0, {LATER}]) as later, p_partkey from part), k as (select * from {values([(k, m[0], m[1]) for k, m in enumerate(MANIFESTS)], 'k, path, ecosystem')}),
        m as (select repo, case when later = 0 then path else '{SECOND}' || path end as path, ecosystem, case when later = 0 then 1 else 3 end as n from p join k on k = (p_partkey + later) % {len(MANIFESTS)}
              union all select p_partkey, 'bad/package.json', 'npm', 2 from part)
        select repo, path, ecosystem, cast(n as integer) as place from m""",
    "manifest_dependencies": f"with {_manifests_sql()} select repo, path, ecosystem, name, version, scope, inferred from d",
    "runtime_dependencies": f"""with {_manifests_sql()}, r as (select *, row_number() over (partition by repo, ecosystem, lower(name) order by version is null, inferred, len(string_split(path, '/')), name) as n from d)
        select repo, ecosystem, name, version from r where n = 1 and scope in ('runtime', 'peer')""",
    "source_symbols": f"with {_sources_sql()} select repo, path, name, kind, line from s",
    "source_imports": f"""with t as (select * from {values(_IMPORTED, 'k, ext, imported')})
        select p_partkey as repo, {_filled_sql("'src/{b}/{u}.'")} || ext as path, {_filled_sql('imported')} as imported from part join t on k = p_partkey % {len(SOURCES)}""",
    "symbol_sources": f"""with {_sources_sql()}, n as (select *, least(3, coalesce(lead(line) over (partition by repo order by line, name) - line, 3)) as size, string_split(repeat({_text(_NOTES)}, p_size % 7) || content, chr(10)) as lines from s)
        select repo, name, array_to_string(lines[line:line + size - 1], chr(10)) as source from n""",
    "import_targets": f"with {_LINKED} select repo, path, imported, target from g",
    "file_importers": f"with {_LINKED} select repo, target, count(distinct path) as n, min(path) as first from g where target is not null group by 1, 2",
    "table_text_rows": f"""select p_partkey, cast(r.n as integer) as row, case r.n when 0 then {_FILLS['{b}']} || '/main/' || {_FILLS['{c}']} when 1 then {_FILLS['{a}']} || ',x' else {_FILLS['{b}']} || '/' || {_FILLS['{u}']} end as repo,
        case when r.n = 0 then p_size end as symbols, r.n <> 1 as loadable from part, (values (0), (1), (2)) as r(n)""",
}
