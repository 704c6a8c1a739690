"""Cutting a long plan at the folder that all executors share; numbering rows over ranges."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """df as written once under spark.checkpoint.dir; only where that is unset, on one machine, a folder is made."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="evidra-checkpoints-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        context.setCheckpointDir(where)
    return df.checkpoint()


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in that order, from 1. Ranges of the order are numbered on their own; one count a range reaches the driver."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, at = [], 0
    for r, n in sorted(tuple(x) for x in dealt.groupBy("_range").count().collect()):
        before.append((r, at))
        at += n
    bases = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _base long"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", inside).join(bases, "_range").withColumn(name, F.col("_base") + F.col("_in")).drop("_range", "_in", "_base")


#: Tables of so many rows or fewer are broadcast.
SMALL = 20_000


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """rows, to be broadcast if they are few; their number is looked at."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
