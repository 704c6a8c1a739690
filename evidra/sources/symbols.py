"""Declarations and imports in source text, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kind and pattern of a declaration; the name is the first group.
DECLARATIONS = (
    ("class", r"^\s*(?:public\s+|private\s+|internal\s+|open\s+|abstract\s+|final\s+|export\s+|export\s+default\s+)*(?:data\s+|sealed\s+)?class\s+([A-Z][A-Za-z0-9_]*)"),
    ("interface", r"^\s*(?:public\s+|export\s+)?interface\s+([A-Z][A-Za-z0-9_]*)"),
    ("type", r"^\s*(?:public\s+|export\s+)?(?:type|typealias)\s+([A-Z][A-Za-z0-9_]*)"),
    ("enum", r"^\s*(?:public\s+|export\s+)?enum(?:\s+class)?\s+([A-Z][A-Za-z0-9_]*)"),
    ("function", r"^\s*(?:public\s+|private\s+|export\s+|export\s+default\s+|suspend\s+|async\s+)*fun\s+([a-zA-Z_][A-Za-z0-9_]*)"),
    ("function", r"^\s*(?:export\s+|export\s+default\s+|async\s+)*function\s+([a-zA-Z_][A-Za-z0-9_]*)"),
    ("function", r"^\s*def\s+([a-zA-Z_][A-Za-z0-9_]*)"),
    ("function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"),
    ("struct", r"^\s*(?:pub\s+)?(?:struct|trait|impl)\s+([A-Z][A-Za-z0-9_]*)"),
)
IMPORTS = (r"""(?m)^\s*import\s+(?:\{[^}]*\}\s+from\s+)?['"]([^'"]+)['"]""", r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import", r"(?m)^\s*use\s+([\w:]+)")


def declarations(files: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, name, kind, line): the first declaration of each name in a file, by pattern, then place; lines count from 1."""
    lines = files.select(*key, F.posexplode(F.split(content, "\n")).alias("at", "text"))
    found = F.array_compact(F.array(*[F.when(F.regexp_extract("text", p, 1) != "", F.struct(F.lit(k).alias("ord"), F.regexp_extract("text", p, 1).alias("name"), F.lit(kind).alias("kind"))) for k, (kind, p) in enumerate(DECLARATIONS)]))
    rows = lines.select(*key, (F.col("at") + 1).alias("line"), F.explode(found).alias("d")).select(*key, "line", "d.*")
    first = Window.partitionBy(*key, "name").orderBy("ord", "line")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*key, "name", "kind", "line")


def imports(files: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, imported): distinct modules that a file names."""
    all_ = F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in IMPORTS]))
    return files.select(*key, F.explode(all_).alias("imported"))


def path_score(path: Column, terms: list[str]) -> Column:
    """Terms in a file's name count 4, elsewhere in its path 2; tests are worth 0.4 of that, examples 0.3."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    points = sum((F.when(F.contains(name, F.lit(t.lower())), 4.0).when(F.contains(low, F.lit(t.lower())), 2.0).otherwise(0.0) for t in terms), F.lit(0.0))
    return points * F.when(low.rlike("(^|/)(test|tests|spec|__tests__)/"), 0.4).otherwise(1.0) * F.when(low.rlike("(^|/)(example|examples|sample|samples|demo)/"), 0.3).otherwise(1.0)


def best_files(files: DataFrame, group: str, path: str, terms: list[str], most: int = 8) -> DataFrame:
    """The files of each group whose paths score best; those that score nothing are left out."""
    rows = files.withColumn("points", path_score(F.col(path), terms)).filter(F.col("points") > 0)
    order = Window.partitionBy(group).orderBy(F.desc("points"), path)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
