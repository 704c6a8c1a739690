"""Secrets in text: three base patterns, and windows of high entropy inside candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 20 or more characters of keys, with a digit and a letter among them.
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Character class of a candidate (the first that fits), window length, least bits per character.
CLASSES = ((r"^[0-9a-fA-F]+$", 16, 2.8), (r"^[A-Z0-9]+$", 20, 3.4), (r"^[A-Za-z0-9]+$", 20, 3.6), (r".", 20, 3.8))
#: What looks random but is public: UUIDs, placeholders, names made of words, paths, rulers. Groups that repeat are possessive, so that long strings need no stack.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|your[-_]|xxxx|0123456789|1234567890|abcdef",
    r"^(?:[A-Za-z]++[0-9]{0,4}+[-_/+=]++)++[A-Za-z]*+[0-9]{0,4}+$",
    r"^(?:[0-9]++[-_/+=])*+[0-9]++$",
    r"(.)\1{7}",
)
_UNIT = 1_000_000


def _found(text: Column, hint: Column, pattern: str, value_group: int, least: int) -> Column:
    """array<struct(start, end, hit)> of the leftmost non-overlapping matches whose group has the least length.

    Each match is taken with the text since the match before it, so that the lengths of these
    pieces add up to places; a failing match still uses up its text.
    """
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")  # \G: after the last match no other start is tried
    take = lambda g: F.regexp_extract_all(text, whole, F.lit(g))
    rows = F.zip_with(take(0), F.zip_with(take(2), take(value_group), lambda h, v: F.struct(h.alias("hit"), F.length(v).alias("n"))), lambda p, x: F.struct(F.length(p).alias("size"), x["hit"].alias("hit"), x["n"].alias("n")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")

    def add(state: Column, x: Column) -> Column:
        end = state["at"] + x["size"]
        span = F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["n"] >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    got = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    return F.when(hint, got).otherwise(none)


def _windows(hit: Column, size: int, least: float) -> Column:
    """struct(low, high): the first and last window of size characters with the least entropy, or nulls.

    A character that enters and one that leaves each change the window's sum of c * log2(c) by
    their own counts only, which are those among the last size characters; the sum goes from
    window to window (in integer millionths, so it never drifts). The work is in proportion to
    the string's length times size.
    """
    g = F.array(*[F.lit(round(c * math.log2(c) * _UNIT) if c else 0).cast("bigint") for c in range(size + 2)])
    limit = round((math.log2(size) - least) * size * _UNIT)
    none = F.lit(None).cast("int")

    def change(codes: Column):
        def at(x: Column, k: Column) -> Column:
            last = F.slice(codes, F.greatest(k - size, F.lit(0)) + 1, F.least(k, F.lit(size)))
            gone = F.get(codes, k - size)
            enters = F.size(F.filter(last, lambda y: y == x))
            leaves = F.size(F.filter(last, lambda y: y == gone)) + (x == gone).cast("int")
            return F.get(g, enters + 1) - F.get(g, enters) + F.when(k >= size, F.get(g, leaves - 1) - F.get(g, leaves)).otherwise(0)

        return at

    def step(state: Column, x: Column) -> Column:
        s = state["s"] + x["by"]
        good = (x["k"] >= size - 1) & (s <= limit)
        return F.struct(s.alias("s"), F.when(good & state["low"].isNull(), x["k"] + 1 - size).otherwise(state["low"]).alias("low"), F.when(good, x["k"] + 1).otherwise(state["high"]).alias("high"))

    codes = F.transform(F.split(hit, ""), F.ascii)
    # an array of one element binds the codes, which would else be made anew for each character
    changes = F.transform(F.array(codes), lambda c: F.transform(c, lambda x, k: F.struct(change(c)(x, k).alias("by"), k.alias("k"))))[0]
    last = F.aggregate(changes, F.struct(F.lit(0).cast("bigint").alias("s"), none.alias("low"), none.alias("high")), step)
    return F.struct(last["low"].alias("low"), last["high"].alias("high"))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that touch no base span, by two passes in order of place: over what began before, then over what begins within."""
    item = lambda x, rank, hit: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), hit.alias("hit"))
    items = F.array_sort(F.concat(F.transform(base, lambda x: item(x, 0, F.lit(None).cast("string"))), F.transform(spans, lambda x: item(x, 1, x["hit"]))))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,hit:string>>)")

    def forth(state: Column, x: Column) -> Column:
        ends = F.when(x["rank"] == 0, F.greatest(state["at"], x["end"])).otherwise(state["at"])
        return F.struct(ends.alias("at"), F.when((x["rank"] == 0) | (state["at"] <= x["start"]), F.concat(state["out"], F.array(x))).otherwise(state["out"]).alias("out"))

    def back(state: Column, x: Column) -> Column:
        begins = F.when(x["rank"] == 0, x["start"]).otherwise(state["at"])
        return F.struct(begins.alias("at"), F.when((x["rank"] == 1) & (state["at"] >= x["end"]), F.concat(state["out"], F.array(x))).otherwise(state["out"]).alias("out"))

    some = F.aggregate(items, F.struct(F.lit(0).alias("at"), none.alias("out")), forth)["out"]
    free = F.aggregate(F.reverse(some), F.struct(F.lit(2**31 - 1).alias("at"), none.alias("out")), back)["out"]
    return F.transform(F.when((F.size(base) > 0) & (F.size(spans) > 0), free).otherwise(F.transform(spans, lambda x: item(x, 1, x["hit"]))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))


def _random_part(hit: Column) -> Column:
    """struct(low, high) of a candidate by its class; nulls if it is allowed or nowhere random enough."""
    none = F.struct(F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    allowed = hit.rlike(ALLOW[0])
    for pattern in ALLOW[1:]:
        allowed = allowed | hit.rlike(pattern)
    case = F.when(allowed, none)
    for pattern, size, least in CLASSES:
        case = case.when(hit.rlike(pattern), _windows(hit, size, least))
    return case.otherwise(none)


def _tagged(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct(start, rank, kind, end)>) for every row of docs, in order of start, then kind.

    Places count code points, the end is exclusive, and a span is the whole match. Base kinds:
    assign (a named value of 12 or more characters), access (18 or more), hex (16 or more). Kind
    entropy: in strings of 20 or more key characters with a digit and a letter, the stretch from
    the first to the last window whose Shannon entropy reaches the bound of the string's character
    class; allowed shapes and strings that touch a base span are left out.

    Null text counts as empty and has no spans; null ids are kept; repeated rows give repeated
    rows; an empty table gives an empty result; texts are read whole; further columns are not
    read. A row's work is a projection: nothing is shuffled.
    """
    rows = id_text(docs, id_col, text_col)
    text = F.col("text")
    base = [
        ("assign", _found(text, text.rlike(_ASSIGN_HINT), _ASSIGN, 3, 12)),
        ("access", _found(text, F.contains(text, F.lit("AKIA")), _ACCESS, 2, 18)),
        ("hex", _found(text, text.rlike(r"[0-9a-f]{16}"), r"[0-9a-f]{16,}", 2, 16)),
    ]
    for kind, spans in base:
        rows = rows.withColumn(kind, F.transform(spans, _tagged(kind)))
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("candidates", _found(text, text.rlike(_CANDIDATE), _CANDIDATE, 2, 20))
    parts = F.transform(_apart(F.col("candidates"), F.col("base")), lambda x: F.struct(x["start"].alias("at"), _random_part(x["hit"]).alias("part")))
    parts = F.filter(parts, lambda x: x["part"]["low"].isNotNull())
    random = F.transform(F.transform(parts, lambda x: F.struct((x["at"] + x["part"]["low"]).alias("start"), (x["at"] + x["part"]["high"]).alias("end"))), _tagged("entropy"))
    random = F.when(F.size("candidates") > 0, random).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)"))
    return rows.select("id", F.array_sort(F.concat("base", random)).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return got.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
