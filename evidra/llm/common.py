"""What several corpus operators share: safe projections, lineage cuts, bounded membership filters."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts per Arrow batch: whole texts go to Python, so a batch of long ones must still fit.
BATCH_ROWS = 256
#: bitmap_construct_agg fills blocks of this many bits (4 KB).
BLOCK_BITS = 32768


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone: other columns, whatever their names, can't clash; a null text is empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, and all on one machine, as in tests) a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="evidra-checkpoints-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Written once to the shared folder, so that a lost executor costs nothing that was done before."""
    if not shared_dir(df.sparkSession):
        raise ValueError("no checkpoint folder")
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Drops what earlier rounds left: shuffle files and cut tables go when the driver has collected their handles, which it else does when its memory is full."""
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class BitFilter:
    """A membership filter of a fixed size (bits / 8 bytes), broadcast whatever the input's size.

    It has no false negatives; a false positive only sends a row through the exact step that
    follows, so results never depend on it.
    """

    def __init__(self, keys: DataFrame, *cols: str, bits: int = 1 << 23):
        self.cols, self.bits = cols, bits
        slot = F.pmod(F.xxhash64(*cols), F.lit(bits))
        blocks = keys.select(slot.alias("s")).groupBy(F.floor(F.col("s") / BLOCK_BITS).cast("int").alias("_bf_block"))
        self.blocks = blocks.agg(F.bitmap_construct_agg((F.col("s") % BLOCK_BITS).cast("bigint")).alias("_bf_bits"))

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """df with a boolean column: false means certainly not among the keys."""
        slot = F.pmod(F.xxhash64(*self.cols), F.lit(self.bits))
        at = F.col("_bf_slot") % BLOCK_BITS
        byte = F.conv(F.hex(F.substring("_bf_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, (at % 8).cast("int")) == 1
        got = df.withColumn("_bf_slot", slot).withColumn("_bf_block", F.floor(F.col("_bf_slot") / BLOCK_BITS).cast("int"))
        got = got.join(F.broadcast(self.blocks), "_bf_block", "left")
        return got.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_bf_slot", "_bf_block", "_bf_bits")
