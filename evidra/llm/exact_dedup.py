"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BitFilter, cut, documents, id_text

#: A run of white space that isn't a lone space already.
_RUN = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False, filter_bits: int = 1 << 23) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of docs.

    Texts are equal when identical after each run of ASCII white space became one space. Three
    refinements, each reading on only for what the one before left in a group of two or more:
    the length; the hash of the first prefix_chars; the SHA-256 of the full text. The survivors
    of the first two are passed on as bit filters of a fixed size; only the full hash decides.

    The smallest id of a group stays. digest is null for rows that dropped out before the full
    hash, unless digest_all. Null text counts as empty; a null id is larger than any other and
    stays only in a group without another; rows with the same id and the same text are one
    document and share its result; an empty table gives an empty result; further columns are
    not read.
    """
    rows = id_text(docs, id_col, text_col).select("id", normalised(F.col("text")).alias("norm"))
    sized = rows.withColumn("n", F.length("norm"))
    lengths = sized.groupBy("n").count().filter("count > 1")
    left = BitFilter(lengths, "n", bits=filter_bits).mark(sized, "s1")
    headed = left.withColumn("p", F.when(F.col("s1"), F.xxhash64(F.substring("norm", 1, prefix_chars))))
    heads = headed.filter("s1").groupBy("n", "p").count().filter("count > 1")
    left = BitFilter(heads, "n", "p", bits=filter_bits).mark(headed, "s2").withColumn("s", F.col("s1") & F.col("s2"))
    full = F.unhex(F.sha2("norm", 256))
    hashed = cut(left.select("id", "s", (full if digest_all else F.when(F.col("s"), full)).alias("digest")))
    # Cut before the join: both sides are then dealt anew, and AQE may split a hot group.
    groups = cut(hashed.filter("s").groupBy(F.col("digest").alias("k")).agg(F.min("id").alias("keep"), F.count("*").alias("size")).filter("size > 1"))
    alone = F.unhex(F.hex(F.xxhash64("id")))  # shorter than a digest: matches none, and spreads the rows that have none
    joined = hashed.withColumn("k", F.when(F.col("s"), F.col("digest")).otherwise(alone)).join(groups, "k", "left")
    grouped = F.col("size").isNotNull()
    return joined.select(
        "id",
        F.when(grouped, F.col("keep")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_groups(documents(spark, sf_dir), digest_all=True)
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
     g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
