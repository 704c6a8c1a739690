"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import bpe_transducer, line_dedup, mixing, near_sets, rule_quality
from evidra.llm.common import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score less are rejected.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from labelled rows that aren't held out.

    Null texts count as empty and are scored like any text; rows with the same text go or stay
    together; labels without a document or a value teach nothing, and without any label every
    document scores 0.5 and stays; an empty table gives an empty result.
    """
    model = rule_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_quality.scored(docs, model).filter(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of repeated runs of lines; a text that loses all its lines stays as an empty one."""
    got = line_dedup.dedup_lines(docs)
    return got.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more): the one with the least id.

    Of several texts under that id in one group the one with the least hash stays; another text under
    the id that is like nothing of the group is judged on its own. Rows with the same id and text stay
    together; null texts are empty ones; null ids come last.
    """
    groups = near_sets.near_duplicates(docs)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    kept = groups.groupBy("component").agg(least.alias("m")).select(F.col("m.id").alias("_id"), F.col("m.t").alias("_t"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_t"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their source draw them; a null source is one of its own, null texts have no tokens, rows with the same id and text are drawn together, an empty table gives an empty result."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids of each document, and the text that they decode to; a null text has none and decodes to the empty one, each row is encoded, an empty table gives an empty result."""
    import public_tokenizers

    got = bpe_transducer.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memory=0.2)  # beside what the other stages take
    return got.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("mixing sources", mixture), ("byte-level BPE", tokens)]
#: A learned classifier and bisection have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage returns is written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
