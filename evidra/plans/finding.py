"""Discovery end to end as a query: nations ask, parts are the repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.plans import files
from evidra.plans.discover import discover
from evidra.plans.reads import _pick
from evidra.sources.tables import table

AS_OF = "2025-06-01"
#: Words of parts' names, by which nations ask for them.
FIRST, SECOND = ("large", "hot", "blue", "old", "cold", "red", "small"), ("ring", "bolt", "plate", "rod", "gear", "widget", "gizmo", "anvil")


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, queries): what each nation asks for, and by which words it searches."""
    key = F.col("n_nationkey")
    a, b = _pick(key, *FIRST), _pick(key, *SECOND)
    checklist = F.array(F.concat(a, F.lit(" "), b, F.lit(" manager")), F.concat(F.lit("retry "), b), F.lit("react"), F.lit("installation instructions"), F.lit("zebra crossing"))
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t"), key.cast("string")).alias("task"), F.concat(F.lit("find a "), a, F.lit(" "), b, F.lit(" with retry")).alias("requirement"),
        _pick(key, "kotlin", "typescript", None).alias("target_language"), checklist.alias("checklist"), a.alias("a"), b.alias("b"),
    )
    words = [F.concat_ws(" ", "a", "b"), F.concat_ws(" ", "b", F.lit("library")), F.concat_ws(" ", "b", F.lit("zebra"))]
    queries = rows.select("task", F.posexplode(F.array(*words)).alias("ord", "query"))
    return rows.drop("a", "b"), queries


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as repositories: their name and type, their size as age, their price as stars."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), key.cast("string"))
    full = lambda k: F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/"), k)
    return table(spark, sf_dir, "part").select(
        key.alias("repo"), full(name).alias("full_name"), F.concat(F.lit("A "), "p_name", _pick(size, " library", " demo app", "", " toolkit with retry")).alias("description"),
        F.array(F.lower("p_type")).alias("topics"), _pick(key, "Kotlin", "TypeScript", "Python", "Rust", "Go").alias("language"), F.floor("p_retailprice").cast("long").alias("stars"),
        (key % 13 == 0).alias("is_fork"), F.lit(None).cast("string").alias("parent"), (size % 9 == 0).alias("archived"), F.date_sub(F.lit(AS_OF).cast("date"), size * 40 + 100).alias("created_at"),
        F.date_sub(F.lit(AS_OF).cast("date"), size * 20).alias("pushed_at"), _pick(key, "MIT", "Apache-2.0", "GPL-3.0", None).alias("license_spdx"), (size * 100).cast("long").alias("size_kb"), (size % 7).cast("long").alias("releases"),
    )


README = "# {c}\n## Installation\n```\npip install {a}\n```\n## Usage\nThe {a} manager does {b}.\n"


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(full_name, path, content): manifests and sources of parts, and what stands beside them."""
    key = F.col("p_partkey")
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    some = F.array(file("README.md", files._filled(F.lit(README))), file("tests/test_all.py", F.lit("import pytest\n")), file(".github/workflows/ci.yml", F.lit("on: push\n")))
    more = table(spark, sf_dir, "part").select(key.alias("repo"), F.inline(F.slice(some, F.lit(1), (key % 4).cast("int"))))
    all_ = more.union(files.project_files(spark, sf_dir).select("repo", "path", "content")).union(files.source_files(spark, sf_dir))
    return all_.join(repositories(spark, sf_dir).select("repo", "full_name"), "repo").select("full_name", "path", "content")


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, queries = asked(spark, sf_dir)
    repos = repositories(spark, sf_dir).drop("repo")
    got = discover(tasks, queries, repos, repository_files(spark, sf_dir), AS_OF, size=20, deep=5)
    return got.withColumn("discovered_via", F.array_join("discovered_via", ","))


QUERIES = {"discovered": discovered}
