"""Text made of results: the only place where rows reach the driver, and few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limitations(degradations: DataFrame, most: int = 5) -> tuple[list[str], int]:
    """(the first lines, how many more): what could not be measured, once for each stage and reason."""
    rows = degradations.groupBy("stage", "reason").agg(F.min("ord").alias("o")).orderBy("o", "stage", "reason")
    total = rows.count()
    return [f"{r['stage']}: {r['reason']}" for r in rows.limit(most).collect()], max(0, total - most)


def table(df: DataFrame, columns: list[str], most: int = 50) -> str:
    """Left-aligned columns of the first rows; a last line says if there are more."""
    found = df.select(*columns).limit(most + 1).collect()
    rows = [columns] + [["" if v is None else str(v) for v in r] for r in found[:most]]
    widths = [max(len(r[k]) for r in rows) for k in range(len(columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return "\n".join(lines + ["…"] * (len(found) > most))


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as one JSON object, for sinks that take text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
