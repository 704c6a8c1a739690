"""Which file an import means, which files import a file, and the source of many symbols at one reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.sources import symbols

# Names of files that stand for their folder.
FOLDER_FILES = r"/(index|__init__|mod)$"


def stem(path: Column) -> Column:
    """A path without its extension; a file that stands for its folder has the folder's."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), FOLDER_FILES, "")


def joined(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, without . and .. in it; .. beyond the top stays at the top."""
    none = F.expr("cast(array() as array<string>)")
    up = lambda got: F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(0)))
    step = lambda got, x: F.when(x.isin("", "."), got).when(x == "..", up(got)).otherwise(F.concat(got, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, relative), "/"), none, step), "/")


def resolved(files: DataFrame, repo: str, path: str, content: str) -> DataFrame:
    """(repo, path, imported, target): the file of the same repository that each import means, null for none.

    A module is a path (a.b and a::b are a/b). Relative ones are files exactly; others are the file whose path
    ends with all of the module, else with all but its last name (a member of it); of several such files the one
    with fewest folders, then the first by path. Each file is dealt once for each end of its path, so
    this is an equal join, whatever the number of files and imports.
    """
    own = files.select(F.col(repo).alias("repo"), F.col(path).alias("file"), F.split(stem(F.col(path)), "/").alias("parts"))
    size = F.size("parts")
    ends = own.select("repo", "file", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("n"), "parts")
    end = F.array_join(F.slice("parts", -F.col("n"), F.col("n")), "/")
    whole = own.select("repo", F.concat(F.lit("/"), F.array_join("parts", "/")).alias("key"), size.alias("size"), "file")
    keys = ends.select("repo", end.alias("key"), "size", "file").union(whole)
    best = keys.groupBy("repo", "key").agg(F.min(F.struct("size", "file")).alias("m")).select(F.col("repo").alias("r"), F.col("key").alias("k"), F.col("m.file").alias("target"))
    found = symbols.imports(files.select(F.col(repo).alias("repo"), F.col(path).alias("path"), F.col(content).alias("content")), ["repo", "path"], "content")
    module = F.regexp_replace(F.regexp_replace("imported", r"\.|::", "/"), r"^/+|/+$", "")
    outer = F.when(F.contains(module, F.lit("/")), F.regexp_replace(module, "/[^/]*$", ""))
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    exact = F.concat(F.lit("/"), joined(folder, stem(F.col("imported"))))
    wanted = F.when(F.col("imported").rlike(r"^\.\.?/"), F.array(exact)).otherwise(F.array_compact(F.array(module, outer)))
    asked = found.select("repo", "path", "imported", F.posexplode(wanted).alias("ord", "key"))
    met = asked.join(best, (F.col("repo") == F.col("r")) & (F.col("key") == F.col("k")), "left").filter("target is null or target <> path")
    got = met.groupBy("repo", "path", "imported").agg(F.min(F.when(F.col("target").isNotNull(), F.struct("ord", "target"))).alias("m"))
    return found.join(got, ["repo", "path", "imported"], "left").select("repo", "path", "imported", F.col("m.target").alias("target"))


def importers(graph: DataFrame) -> DataFrame:
    """(repo, target, n, first): how many files import each file, and the first of them."""
    edges = graph.filter("target is not null").select("repo", "target", "path").distinct()
    return edges.groupBy("repo", "target").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def symbol_sources(files: DataFrame, key: list[str], content: str, most: int = 40) -> DataFrame:
    """(key, name, kind, line, source): each symbol of a file with its lines, up to the next symbol's, most at most.

    A file is read once for all its symbols.
    """
    found = symbols.declarations(files, key, content)
    after = F.lead("line").over(Window.partitionBy(*key).orderBy("line", "name"))
    found = found.withColumn("size", F.least(F.coalesce(after - F.col("line"), F.lit(most)), F.lit(most)))
    lists = found.groupBy(*key).agg(F.collect_list(F.struct("name", "kind", "line", "size")).alias("s"))
    lines = files.select(*key, F.split(content, "\n").alias("lines"))
    each = lists.join(lines, key).select(*key, "lines", F.inline("s"))
    return each.select(*key, "name", "kind", "line", F.array_join(F.slice("lines", F.col("line"), F.greatest("size", F.lit(0))), "\n").alias("source"))
