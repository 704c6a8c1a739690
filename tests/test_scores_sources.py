from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidra.functions import scores as sc
from evidra.sources import symbols, table_text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("days,commits,age,archived,want", [(10, 30, 2000, False, 1.0), (10, 0, 2000, False, 0.8), (10, 30, 20, False, 0.45), (400, 0, 2000, False, 0.25), (5000, None, 9000, False, 0.08), (1, 30, 900, True, 0.0)])
def test_maintenance(spark, days, commits, age, archived, want):
    assert one(spark, sc.maintenance(F.lit(days), F.lit(commits).cast("int"), F.lit(age), F.lit(archived))) == pytest.approx(want)


def test_relevance_gates(spark):
    def score(products=(), excluded=(), body="plain text"):
        arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<string>)")
        return one(spark, sc.feature_relevance(arr(["download", "resume", "ui"]), arr(["download-manager"]), F.lit("resume lib"), F.lit(body), arr(products), arr(excluded)))

    assert score() == pytest.approx(0.30)
    assert score(products=["acme"]) == pytest.approx(0.11) and score(products=["acme"], body="for Acme") == pytest.approx(0.18)
    assert score(excluded=["manager"]) == pytest.approx(0.06)


def test_stack_and_reuse(spark):
    none = F.expr("cast(array() as array<string>)")
    assert one(spark, sc.stack_match(F.lit("Kotlin"), F.lit("kotlin"), none, none, none)) == pytest.approx(0.88)
    assert one(spark, sc.stack_match(F.lit("Java"), F.lit("kotlin"), none, none, none)) == pytest.approx(0.57)

    def verdict(ok=True, known=True, old=False, kind="library", kc=0.8, copyleft=False, stack=0.9, arch=0.8):
        t = lambda x: F.lit(x)
        return one(spark, sc.reuse(t(ok), t(known), t(old), t(kind), t(kc), t(copyleft), t(False), t(stack), t(arch), t(1.0)))["verdict"]

    assert verdict() == "DIRECT_REUSE" and verdict(ok=False) == "DO_NOT_USE" and verdict(known=False) == "REFERENCE_ONLY" and verdict(old=True) == "REFERENCE_ONLY"
    assert verdict(kind="application") == "REFERENCE_ONLY" and verdict(kind="mixed") == "ADAPT" and verdict(copyleft=True) == "REFERENCE_ONLY" and verdict(stack=0.3) == "REFERENCE_ONLY" and verdict(arch=0.5) == "ADAPT"


def test_small_scores(spark):
    assert one(spark, sc.popularity(F.lit(0))) == 0.0 and one(spark, sc.popularity(F.lit(10**6))) == 1.0
    assert one(spark, sc.dependency_simplicity(F.lit(2))) == 1.0 and one(spark, sc.dependency_simplicity(F.lit(60))) == 0.0
    assert one(spark, sc.test_evidence(F.lit(None).cast("boolean"), F.lit(3))) is None and one(spark, sc.test_evidence(F.lit(False), F.lit(0))) == 0.05
    assert one(spark, sc.completeness_penalty(F.lit(0), F.lit(5))) == 0.45 and one(spark, sc.completeness_penalty(F.lit(1), F.lit(9))) == 1.0
    assert one(spark, sc.integration_surface(F.lit(6), F.lit(2), F.lit(1), F.lit(0), F.lit(0.0)))["difficulty"] == "trivial"
    assert one(spark, sc.reusability(F.lit(4), F.lit(1), F.lit(3), F.lit(False)))["kind"] == "library" and one(spark, sc.reusability(F.lit(0), F.lit(0), F.lit(0), F.lit(False)))["confidence"] == 0.1
    assert one(spark, sc.readme_quality(F.lit(""))) == 0.0 and one(spark, sc.readme_quality(F.lit("# Install\n```x```\n## Usage\nsee"))) == pytest.approx(0.6)
    assert one(spark, sc.symbol_score(F.array(F.lit("download")), F.lit("DownloadManager"), F.lit(None).cast("string"), F.lit("src/a.kt"), F.lit(None).cast("string"), F.lit("class"))) == pytest.approx(0.6)


SOURCE = "import a.b.C\nfrom 'x'\nclass Foo {\n  fun bar() {}\n}\nclass Foo {}\nconst X = 1\ndef baz(self):\nimport { y } from \"mod\"\n"


def test_declarations_and_imports(spark):
    files = spark.createDataFrame([("a", SOURCE), ("b", "")], "path string, content string")
    got = {(r["name"], r["kind"], r["line"]) for r in symbols.declarations(files, ["path"], "content").collect()}
    assert got == {("Foo", "class", 3), ("bar", "function", 4), ("baz", "function", 8)}
    assert {r["imported"] for r in symbols.imports(files, ["path"], "content").collect()} >= {"a.b.C", "mod"}
    paths = spark.createDataFrame([("g", "src/download/Queue.kt"), ("g", "test/download/T.kt"), ("g", "README.md")], "g string, path string")
    assert [r["path"] for r in symbols.best_files(paths, "g", "path", ["download", "queue"]).orderBy(F.desc("points")).collect()] == ["src/download/Queue.kt", "test/download/T.kt"]


TEXT = '#MUNCH/1 tool=list\n@6=src/\n@66=@6main/\ncount=3 note="x y" __stypes=count:int __tables=t:repos:repo|symbols|loadable:str|int|bool;u:other:v:int\nt,@66App,12,T\nt,@6x,bad,F\nt,"a,""b""",,true\nu,7\nnonsense\n'


def test_table_text(spark, tmp_path):
    spark.dataSource.register(table_text.TableText)
    cells = spark.read.format("table_text").option("text", TEXT).load()
    got = [tuple(r) for r in table_text.typed(cells, "repos", {"repo": "str", "symbols": "int", "loadable": "bool"}).orderBy("row").collect()]
    assert got == [(0, "src/main/App", 12, True), (1, "src/x", None, False), (2, 'a,"b"', None, True)]
    assert table_text.typed(cells, "", {"count": "int", "note": "str"}).first()[1:] == (3, "x y")
    (tmp_path / "one.txt").write_text(TEXT)
    files = table_text.from_files(spark, str(tmp_path))
    assert table_text.typed(files, "other", {"v": "int"}, ["file", "row"]).first()["v"] == 7
    assert spark.read.format("table_text").option("text", "a,b\n").load().count() == 0


def test_table_text_is_read_by_ranges_of_files_and_what_is_asked_leaves_out_files(spark, tmp_path):
    for k in range(10):
        (tmp_path / f"f{k}.txt").write_text(f"#MUNCH/1\ncount={k} __tables=t:repos:repo|n:str|int;u:other:x:str\nt,a{k},{k}\nt,b,2\nu,z\n")
    whole = table_text.folder(spark, str(tmp_path), 3)
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 60
    cells = table_text.folder(spark, str(tmp_path), 3, table="repos", file=f"{tmp_path}/f3.txt")
    assert cells.rdd.getNumPartitions() == 1 and cells.count() == 4
    some = table_text.folder(spark, str(tmp_path), 1, row=0, column="n", file_prefix=f"{tmp_path}/f")
    assert some.rdd.getNumPartitions() == 10 and cells.union(some).count() == 14
    (tmp_path / "f3.txt").write_bytes(b"")  # files that aren't asked for are not opened
    assert table_text.folder(spark, str(tmp_path), file_prefix=f"{tmp_path}/f4").count() == 6
    assert {tuple(r) for r in table_text.from_files(spark, str(tmp_path)).drop("file").collect()} == {tuple(r) for r in whole.drop("file").collect()}
    with pytest.raises(ValueError):
        table_text.folder(spark, str(tmp_path), value="x")
