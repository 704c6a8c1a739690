"""I-Match fingerprints: mid-frequency terms, sorted, hashed over several random subsets of the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, id_text

#: Terms found in at least LOW and at most HIGH of the documents. A document with d distinct terms
#: adds at most d / (LOW * n) terms to the lexicon, so it has at most (mean d) / LOW terms at any size.
LOW, HIGH = 0.001, 0.1
#: A lexicon of more terms than this (two million bytes) is joined by shuffle instead of broadcast.
BROADCAST_TERMS = 400_000
#: Random subsets of the lexicon: FAMILIES at each rate 2**-2 ... 2**-9. Dense ones suit short texts, sparse ones long texts.
RATES, FAMILIES = tuple(range(2, 10)), 4
SUBSETS = len(RATES) * FAMILIES


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def codes(text: Column) -> Column:
    """The distinct terms of text as 64-bit hashes, the lowest bit cleared: it is kept for a mark."""
    return F.transform(terms(text), lambda t: F.xxhash64(t).bitwiseAND(F.lit(-2)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): the hashes of the terms whose share of all documents is in [low, high]."""
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = text.count()
    counted = text.select(F.explode(codes(F.col("text"))).alias("term")).groupBy("term").count()
    found = cut(counted.filter((F.col("count") >= max(2, low * total)) & (F.col("count") <= max(2, high * total))).select("term"))
    return F.broadcast(found) if found.count() <= BROADCAST_TERMS else found


def in_lexicon(df: DataFrame, keys: list[str], marked: Column, words: DataFrame, *carried: str) -> DataFrame:
    """keys, carried columns, and set: the marked codes of each key's rows that are in the lexicon."""
    # Codes of one key lie together, so few groups would be enough; the default of 128 sorts instead.
    df.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
    rows = df.select(*keys, *carried, F.explode_outer(marked).alias("v")).withColumn("k", F.col("v").bitwiseAND(F.lit(-2)))
    rows = rows.join(words, F.col("k") == F.col("term"), "left")
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], F.collect_set(F.when(F.col("term").isNotNull(), F.col("v"))).alias("set"))


def of_mark(found: Column, mark: int) -> Column:
    """Sorted codes with that mark, without it."""
    return F.array_sort(F.transform(F.filter(found, lambda v: v.bitwiseAND(F.lit(1)) == mark), lambda v: v.bitwiseAND(F.lit(-2))))


def fingerprint(sorted_codes: Column) -> Column:
    """array<int>: for each subset the 16-bit hash of its terms in order, 0 where it holds none."""

    def inside(k: int):
        at, low = 1 + (k * 11) % 53, (1 << RATES[k // FAMILIES]) - 1
        return lambda c: F.shiftright(c, at).bitwiseAND(F.lit(low)) == 0

    subsets = F.array(*[F.filter(sorted_codes, inside(k)) for k in range(SUBSETS)])
    return F.transform(subsets, lambda s: F.when(F.size(s) > 0, (F.pmod(F.xxhash64(s), F.lit(65535)) + 1).cast("int")).otherwise(0))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of equal hashes among the subsets that either holds a term of; 1 for equal texts, 0 for others without a term."""
    pair = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    either = F.size(F.filter(pair, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    both = F.size(F.filter(pair, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return F.when(same, 1.0).when(either > 0, both / either).otherwise(0.0)


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def next_in_order(keys: DataFrame) -> DataFrame:
    """keys (distinct id, h; more columns pass) with next_id, next_h: the next pair by id, then h; the first after the last.

    Keys are dealt into ranges by their quantiles, whatever the gaps between ids, each ordered on
    its own; the first pair of the next range closes each one. One pair a range reaches the driver.
    Null ids come last.
    """
    pair = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    dealt = cut(keys.repartitionByRange(F.col("id").isNull(), F.col("id"), F.col("h")).withColumn("range", F.spark_partition_id()))
    firsts = sorted((r["range"], r["id"], r["h"]) for r in dealt.groupBy("range").agg(F.min(pair).alias("first")).select("range", "first.id", "first.h").collect())
    closing = [(here[0], *after[1:]) for here, after in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    kind = keys.schema["id"].dataType.simpleString()
    ends = F.broadcast(keys.sparkSession.createDataFrame(closing, f"range int, end_id {kind}, end_h long"))
    led = dealt.withColumn("next", F.lead(pair).over(Window.partitionBy("range").orderBy(pair))).join(ends, "range")
    here = F.col("next").isNotNull()
    return led.select(*keys.columns, F.when(here, F.col("next.id")).otherwise(F.col("end_id")).alias("next_id"), F.when(here, F.col("next.h")).otherwise(F.col("end_h")).alias("next_h"))


def _zero(rows: DataFrame) -> Column:
    """What stands for a null id: 0 as an id of that type."""
    return F.lit(0).cast(rows.schema["id"].dataType)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id0, none, h, text): the id (a number or a string) with 0 for null, whether it is null, the text's hash; null text is empty."""
    rows = id_text(docs, id_col, text_col)
    return rows.select(F.coalesce("id", _zero(rows)).alias("id0"), F.col("id").isNull().alias("none"), F.xxhash64("text").alias("h"), "text")


KEY = ["id0", "none", "h"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(id, fingerprint array<int>) for every row of docs.

    Terms are lower-cased runs of letters and digits; those within the frequency band, distinct and
    in order of their hash, are hashed once for each random subset of the lexicon. Texts without a
    term in the band have a fingerprint of zeros. Equal texts have equal fingerprints. Null text
    counts as empty; null ids are kept; repeated rows give repeated rows; an empty table gives an
    empty result; further columns are not read. Only hashes of terms are shuffled, not texts.
    """
    rows = keyed(docs, id_col, text_col)
    sets = in_lexicon(rows, KEY, codes(F.col("text")), lexicon(docs, text_col, low, high))
    copies = rows.groupBy(*KEY).count()
    got = sets.join(copies, KEY).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    got = got.withColumn("c", of_mark(F.col("set"), 0))
    return got.select(F.when(~F.col("none"), F.col("id0")).alias("id"), fingerprint(F.col("c")).alias("fingerprint"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id0, none, h, copies, next0, next_none, next_h, text, edited), dealt by the first three.

    edited is text with its last quarter replaced by as much of the start of the next text, in
    order of id, then of the text's hash h. Rows with the same id and text are one document, which
    came copies times. Texts are dealt once, by id and hash; starts of texts (a quarter of them at
    most) once more.
    """
    rows = keyed(docs, id_col, text_col)
    quarter = F.floor(F.length("text") / 4).cast("int")
    keys = cut(rows.groupBy(*KEY).agg(F.min(quarter).alias("quarter"), F.count("*").cast("int").alias("copies")))
    repeats = keys.filter("copies > 1").limit(1).count() > 0
    ordered = next_in_order(keys.withColumn("id", F.when(~F.col("none"), F.col("id0"))))
    after = cut(ordered.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "quarter", "copies", F.coalesce("next_id", _zero(ordered)).alias("next0"), F.col("next_id").isNull().alias("next_none"), "next_h"))
    heads = rows.join(after, (F.col("id0") == F.col("next0")) & (F.col("none") == F.col("next_none")) & (F.col("h") == F.col("next_h")))
    heads = heads.select(*[f"of_{k}" for k in KEY], "quarter", "copies", "next0", "next_none", "next_h", F.expr("left(text, quarter)").alias("head"))
    if repeats:
        heads = heads.dropDuplicates([f"of_{k}" for k in KEY])
    both = rows.join(heads, (F.col("id0") == F.col("of_id0")) & (F.col("none") == F.col("of_none")) & (F.col("h") == F.col("of_h")))
    edited = F.concat(F.expr("left(text, length(text) - quarter)"), "head")
    return both.select(*KEY, "copies", "next0", "next_none", "next_h", "text", edited.alias("edited"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents its own fingerprint and its edited text's, and the likeness to that and to the next document's.

    Null text is empty; rows with the same id and text are one document, which comes as often as
    it has rows; after the last document comes the first (a table of one document: itself).
    """
    docs = documents(spark, sf_dir)
    words = lexicon(docs)
    marked = F.concat(codes(F.col("text")), F.transform(codes(F.col("edited")), lambda c: c.bitwiseOR(F.lit(1))))
    sha = F.unhex(F.sha2(F.col("edited").cast("binary"), 256))
    both = with_edits(docs).select(*KEY, "copies", "next0", "next_none", "next_h", F.length("text").cast("long").alias("n"), sha.alias("sha"), (F.xxhash64("edited") == F.col("h")).alias("same"), marked.alias("marked"))
    sets = in_lexicon(both, KEY, F.col("marked"), words, "copies", "next0", "next_none", "next_h", "n", "sha", "same")
    # the sorted codes are columns of their own: all subsets of a fingerprint read them
    sets = sets.withColumn("c", of_mark(F.col("set"), 0)).withColumn("ce", of_mark(F.col("set"), 1)).drop("set")
    done = cut(sets.withColumn("f", fingerprint(F.col("c"))).withColumn("fe", fingerprint(F.col("ce"))).drop("c", "ce"))
    of_next = done.select(F.col("id0").alias("i"), F.col("none").alias("o"), F.col("h").alias("g"), F.col("f").alias("fn"))
    got = done.join(of_next, (F.col("next0") == F.col("i")) & (F.col("next_none") == F.col("o")) & (F.col("next_h") == F.col("g")))
    got = got.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return got.select(
        F.when(~F.col("none"), F.col("id0")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        written(F.col("f")).alias("fingerprint"),
        written(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("fe"), F.col("same")).alias("near_edited"),
        likeness(F.col("f"), F.col("fn"), F.col("h") == F.col("next_h")).alias("near_next"),
    )
