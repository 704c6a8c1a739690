"""Line dedup: intervals of the suffix array over line ids, by prefix doubling; later copies of maximal repeated runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BitFilter, cut, documents

#: A run counts as repeated if it has this many words.
MIN_WORDS = 10
#: A document: nulls last, then id, then hash of the text.
KEY = ["none", "id", "h"]
_BLANKS = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    return [F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), zero).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _full(line: Column) -> Column:
    """Whether a line isn't blank; the first character mostly tells."""
    return (F.ascii(line) > 32) | line.rlike(_WORD)


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, i, a, b, words): the lines that aren't blank, numbered i, without white space at their end, as 128-bit ids."""
    lines = docs.select(*_key(docs, id_col, text_col), F.posexplode(F.filter(_lines(F.col(text_col)), _full)).alias("i", "raw"))
    spaced = F.col("raw").endswith(" ")
    for c in _BLANKS[1:]:
        spaced = spaced | F.col("raw").endswith(c)
    lines = lines.withColumn("line", F.when(spaced, F.rtrim("raw", F.lit(_BLANKS))).otherwise(F.col("raw")))
    return lines.select(*KEY, "i", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"), F.regexp_count("line", F.lit(_WORD + "+")).alias("words"))


def starts(rows: DataFrame) -> DataFrame:
    """(key, d) of each document in rows: the place of its first line if all documents stand one after another, in order of
    their keys, with a free place after each. Ranges of keys are summed on their own; one total a range reaches the driver."""
    rooms = rows.groupBy(*KEY).agg((F.max("i") + 2).cast("long").alias("room")).repartitionByRange(*KEY)
    rooms = cut(rooms.withColumn("range", F.spark_partition_id()))
    before, at = [], 0
    for r in sorted(rooms.groupBy("range").agg(F.sum("room").alias("room")).collect()):
        before.append((r["range"], at))
        at += r["room"]
    before = rows.sparkSession.createDataFrame(before, "range int, base long")
    inside = F.sum("room").over(Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1))
    return rooms.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "range").select(*KEY, (F.col("base") + F.col("inside")).alias("d"))


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose class by those columns has several places, with r, the first of these: the rank of their interval.

    The extreme places of a class are found before it is dealt; the classes are cut before the
    join, so that both sides are dealt anew and AQE may split a class that many rows share.
    """
    classes = rows.groupBy(*by).agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low <> high")
    classes = cut(classes.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(by)], "low"))
    match = F.lit(True)
    for k, c in enumerate(by):
        match = match & (F.col(c) == F.col(f"c{k}"))
    return rows.join(classes.hint("merge"), match).select(*[c for c in rows.columns if c not in by], F.col("low").alias("r"))


def prefix_doubling(lines: DataFrame, depth: int) -> list[DataFrame]:
    """Level k holds (p, d, n, r) for each suffix p that shares its first n = 2**k lines with another: r is the first such suffix.

    Suffixes of one rank are one interval of the suffix array. A round pairs each suffix's rank
    with that of the suffix n lines on and ranks the pairs. The lengths of all levels together are depth
    lines or more, unless an earlier level is the last with an interval. Lengths are columns: every
    round is the same plan, whose code is made once.
    """
    levels = [lines.withColumn("n", F.lit(1).cast("long"))]
    step = Window.partitionBy("d", F.col("p") % F.col("n")).orderBy("p")
    while (1 << len(levels)) - 1 < depth:
        if levels[-1].isEmpty():
            return levels[:-1] or levels
        paired = levels[-1].select("p", "d", (2 * F.col("n")).alias("n"), (F.lead("p").over(step) == F.col("p") + F.col("n")).alias("near"), F.col("r").alias("x"), F.lead("r").over(step).alias("y"))
        levels.append(cut(ranked(paired.filter("near").drop("near"), ["x", "y"])))
    return levels


def longest_copies(levels: list[DataFrame]) -> DataFrame:
    """(p, d, first, size): each suffix that shares lines with an earlier one, with the most lines that it so shares (of as many as
    the levels' lengths make together) and the earliest suffix that shares them. Rows of one (first, size) are, with first, an
    interval of that longest common prefix.

    A suffix starts in the longest interval of n lines of which it isn't the first. A round, with
    n falling by half, parts each longer interval by the rank of what follows the common prefix:
    who isn't the first of its part goes on with the part's prefix. The first of a part speaks
    for it in the interval, so a suffix is not the first in one interval at most and rows never grow.
    """
    later = None
    for level in levels:
        some = level.filter("r <> p").select("p", F.struct(F.col("n").alias("size"), F.col("r").alias("first"), "d").alias("top"))
        later = some if later is None else later.union(some)
    rows = cut(later.groupBy("p").agg(F.max("top").alias("top")).select("p", "top.d", "top.first", "top.size", F.lit(1 << len(levels)).cast("long").alias("n")))
    for level in reversed(levels[:-1]):
        rows = rows.withColumn("n", F.shiftright("n", 1))  # twice the level's n: intervals of so many lines or more are parted
        live, rest = rows.filter(F.col("size") >= F.col("n")), rows.filter(F.col("size") < F.col("n"))
        firsts = live.select("first", "size", "n").distinct().select(F.col("first").alias("p"), F.lit(-1).cast("long").alias("d"), "first", "size", "n")
        after = level.select(F.col("p").alias("q"), F.col("r").alias("y"))
        parted = cut(live.select("p", "d", "first", "size", "n").union(firsts).join(after, F.col("p") + F.col("size") == F.col("q"), "left").drop("q"))
        parts = parted.filter("y is not null").groupBy("first", "size", "y").agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low <> high")
        parts = cut(parts.select(F.col("first").alias("f"), F.col("size").alias("s"), F.col("y").alias("z"), "low"))
        told = parted.filter("p <> first").join(parts.hint("merge"), (F.col("first") == F.col("f")) & (F.col("size") == F.col("s")) & (F.col("y") == F.col("z")), "left")
        on = F.coalesce(F.col("low") < F.col("p"), F.lit(False))
        told = told.select("p", "d", F.when(on, F.col("low")).otherwise(F.col("first")).alias("first"), (F.col("size") + F.when(on, F.shiftright("n", 1)).otherwise(0)).alias("size"), "n")
        rows = cut(told.union(rest.select("p", "d", "first", "size", "n")))
    return rows


def maximal_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, runs array<struct(start, stop)>): which lines that aren't blank (numbered, stop exclusive, runs apart and in order) are later copies.

    Of all runs of whole lines that occur before (in order of key, then place) those are taken
    that no longer one holds; they count if they have min_words. Runs that meet are one.

    A line that isn't blank has a word, so min_words lines always count: suffixes are ranked by that many lines or a few more,
    and a longer run is what its stretches of so many lines, each a later copy too, make together. So rounds
    don't grow with the length of runs.
    """
    rows = cut(sequences(docs, id_col, text_col))
    often = rows.groupBy("a", "b").count().filter("count > 1").select("a", "b")
    rows = BitFilter(often, "a", "b", bits=1 << 24).mark(rows, "hit").filter("hit").drop("hit").dropDuplicates([*KEY, "i"])  # repeated rows are one document
    rows = cut(rows)
    places = cut(starts(rows))
    lines = rows.join(places.hint("merge"), KEY).select((F.col("d") + F.col("i")).alias("p"), "d", "a", "b", "words")
    ordered = Window.partitionBy("d").orderBy("p")
    lines = cut(ranked(lines, ["a", "b"]).withColumn("upto", F.sum("words").over(ordered)))
    copies = longest_copies(prefix_doubling(lines.select("p", "d", "r"), min_words))

    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    runs = copies.select("p", "d", (F.col("p") + F.col("size")).alias("stop"))
    runs = runs.withColumn("reach", F.max("stop").over(before)).filter("reach is null or stop > reach")
    head = lines.select(F.col("p").alias("p1"), (F.col("upto") - F.col("words")).alias("less"))
    last = lines.select(F.col("p").alias("p2"), "upto")
    runs = runs.join(head, F.col("p") == F.col("p1")).join(last, F.col("stop") - 1 == F.col("p2")).filter(F.col("upto") - F.col("less") >= min_words)
    runs = runs.withColumn("apart", F.coalesce(F.col("p") > F.max("stop").over(before), F.lit(True)).cast("int"))
    runs = runs.withColumn("island", F.sum("apart").over(ordered)).groupBy("d", "island").agg(F.min("p").alias("p"), F.max("stop").alias("stop"))
    runs = runs.groupBy("d").agg(F.array_sort(F.collect_list(F.struct((F.col("p") - F.col("d")).cast("int").alias("start"), (F.col("stop") - F.col("d")).cast("int").alias("stop")))).alias("runs"))
    return runs.join(places.hint("merge"), "d").select(*KEY, "runs")


def _without(text: Column, runs: Column) -> Column:
    """text without the lines of runs; the blank ones among them stay."""

    def rest(lines: Column, full: Column) -> Column:
        part = lambda low, high: F.slice(lines, low + 1, high - low)
        after = lambda r: F.get(full, r["stop"] - 1) + 1
        piece = lambda r, k: F.concat(part(F.when(k > 0, after(F.get(runs, k - 1))).otherwise(0), F.get(full, r["start"])), F.filter(part(F.get(full, r["start"]), after(r)), lambda x: ~_full(x)))
        return F.array_join(F.concat(F.flatten(F.transform(runs, piece)), part(after(F.element_at(runs, -1)), F.size(lines))), "\n")

    # arrays of one element bind what would else be made anew for each run
    places = lambda lines: F.array_compact(F.transform(lines, lambda x, k: F.when(_full(x), k)))
    return F.transform(F.array(_lines(text)), lambda lines: F.transform(F.array(places(lines)), lambda full: rest(lines, full))[0])[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_col without the later copies of repeated runs of lines, and _removed, the number of lines that went.

    Lines are compared without white space at their end; blank lines are kept and don't part a
    run. A run may repeat within a document and overlap itself. The first copy stays whole. Texts
    without a repeated run are not changed and not shuffled (a filter of a fixed size tells them).

    A null text has no lines and stays null; null ids come after all others; rows with the same id
    and text are one document and get the same result; an empty table gives an empty result;
    other columns pass through, whatever their names (a column _removed is replaced).
    """
    runs = cut(maximal_runs(docs, id_col, text_col, min_words))
    names = [c for c in docs.columns if c != "_removed"]
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), *_key(docs, id_col, text_col))
    marked = BitFilter(runs, *KEY).mark(rows, "hit")
    found = marked.filter("hit").join(runs.hint("merge"), KEY, "left")
    text = F.when(F.col("runs").isNotNull(), _without(F.col("row")[text_col], F.col("runs"))).otherwise(F.col("row")[text_col])
    gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["stop"] - r["start"]), F.lit(0))
    changed = found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], gone.alias("_removed"))
    return marked.filter("not hit").select(*[F.col("row")[c].alias(c) for c in names], F.lit(0).alias("_removed")).unionByName(changed)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "text", F.col("_removed").cast("long").alias("lines_removed"))


OP2_SQL = rf"""
with recursive split as (
  select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place_no from documents
), lines as (
  select doc_id, place_no, raw, rtrim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as line from split
), full_lines as (
  select doc_id, place_no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
         row_number() over (partition by doc_id order by place_no) - 1 as i
  from lines where line <> ''
), runs as (
  select doc_id, i, 1 as size, words, line as content from full_lines
  union all
  select r.doc_id, r.i, r.size + 1, r.words + l.words, r.content || chr(10) || l.line
  from runs r join full_lines l on l.doc_id = r.doc_id and l.i = r.i + r.size where r.size < {MIN_WORDS}
), first as (
  select size, content, min((doc_id, i)) as place from runs where words >= {MIN_WORDS} group by all
), gone as (
  select distinct r.doc_id, r.i + unnest(range(r.size)) as i
  from runs r join first f on f.size = r.size and f.content = r.content and f.place <> (r.doc_id, r.i) where r.words >= {MIN_WORDS}
), marked as (
  select l.doc_id, l.place_no, l.raw, g.doc_id is not null as dropped
  from lines l left join full_lines f on f.doc_id = l.doc_id and f.place_no = l.place_no left join gone g on g.doc_id = f.doc_id and g.i = f.i
)
select doc_id, coalesce(string_agg(raw, chr(10) order by place_no) filter (not dropped), '') as text,
       count(*) filter (dropped) as lines_removed
from marked group by doc_id
"""
