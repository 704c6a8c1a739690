"""Readers of project files on files of each kind, and which file an import means."""

from __future__ import annotations

import pytest

from evidra.sources import manifests, modules

POM = """<project><dependencies>
<!-- <dependency><groupId>gone</groupId><artifactId>x</artifactId></dependency> -->
<dependency><groupId>org.slf4j</groupId><artifactId>slf4j-api</artifactId><version>2.0.9</version></dependency>
<dependency><version>${junit.version}</version><scope>test</scope><artifactId>junit</artifactId><groupId>junit</groupId></dependency>
</dependencies><build><plugins><plugin><dependencies><dependency><groupId>p</groupId><artifactId>q</artifactId></dependency></dependencies></plugin></plugins></build></project>"""
CSPROJ = """<Project><ItemGroup><PackageReference Version="1" Include="A"/><PackageReference Include="B"><Version>2</Version></PackageReference></ItemGroup>
<ItemGroup><Compile Include="c"/></ItemGroup></Project>"""
CASES = [
    ("pom.xml", POM, [("org.slf4j:slf4j-api", "2.0.9", "runtime", False), ("junit:junit", "${junit.version}", "test", True), ("p:q", None, "runtime", False)]),
    ("x.csproj", CSPROJ, [("A", "1", "runtime", False), ("B", "2", "runtime", False)]),
    ("pom.xml", "no <xml", []),
    ("pom.xml", None, []),
    ("package.json", "{not json", []),
    ("package.json", '{"dependencies":{"a":"1"},"devDependencies":{"b":"2"}}', [("a", "1", "runtime", False), ("b", "2", "dev", False)]),
    ("requirements-dev.txt", "requests>=2.31\n# comment\n-e .\nflask==3.0.0 ; python_version > '3'\n", [("requests", ">=2.31", "dev", False), ("flask", "==3.0.0", "dev", False)]),
    ("notes.md", "x", []),
]


@pytest.mark.parametrize("path,content,want", CASES)
def test_dependencies(spark, path, content, want):
    rows = spark.createDataFrame([(path, content)], "path string, content string")
    got = manifests.dependencies(rows, "path", "content").collect()
    assert [(r["name"], r["version"], r["scope"], r["inferred"]) for r in got] == want


def test_not_vendored_not_deep_not_too_many(spark):
    paths = ["node_modules/x/package.json", "deep/a/b/c/package.json", *[f"m{k}/package.json" for k in range(15)], "package.json"]
    rows = spark.createDataFrame([("r", k, p) for k, p in enumerate(reversed(paths))], "repo string, ord int, path string")
    got = manifests.find_manifests(rows, "repo", "path", "ord").orderBy("place").collect()
    assert [r["path"] for r in got] == ["package.json", *[f"m{k}/package.json" for k in range(14, 3, -1)]]


def test_imports_find_their_files(spark):
    files = [
        ("r", "src/app/main.py", "from core.util import x\nimport os\nimport core.util.helper\n"),
        ("r", "lib/core/util.py", "from . import y\n"),
        ("r", "old/lib/core/util.py", ""),
        ("r", "web/a.ts", "import { b } from './b'\nimport '../web/c'\nimport './a'\nimport '../../../up'\n"),
        ("r", "web/b.ts", ""),
        ("r", "web/c/index.ts", ""),
        ("r", "up.ts", ""),
        ("s", "core/util.py", "import core.util\n"),
    ]
    graph = modules.resolved(spark.createDataFrame(files, "repo string, path string, content string"), "repo", "path", "content")
    got = {(r["repo"], r["path"], r["imported"]): r["target"] for r in graph.collect()}
    assert got == {
        ("r", "src/app/main.py", "core.util"): "lib/core/util.py", ("r", "src/app/main.py", "os"): None, ("r", "src/app/main.py", "core.util.helper"): "lib/core/util.py",
        ("r", "lib/core/util.py", "."): None, ("r", "web/a.ts", "./b"): "web/b.ts", ("r", "web/a.ts", "../web/c"): "web/c/index.ts", ("r", "web/a.ts", "./a"): None,
        ("r", "web/a.ts", "../../../up"): "up.ts", ("s", "core/util.py", "core.util"): None,
    }
    assert {(r["repo"], r["target"]): (r["n"], r["first"]) for r in modules.importers(graph).collect()}[("r", "lib/core/util.py")] == (1, "src/app/main.py")
