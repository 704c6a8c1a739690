"""Periodic runs of words: power-of-two naming, common extensions by descending levels, candidates on a grid."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, small_batches

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts of about so many bytes are named side by side.
PART_BYTES = 2 << 20
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def naming(words: np.ndarray) -> list[np.ndarray]:
    """Levels of names: at level k two places have the same name if and only if the 2**k words from there are the same.

    words are numbers. A name of len(words) or more belongs to one place alone: the 2**k words from
    there are found nowhere else (or don't fit), and so are no longer ones. Only what is left is
    sorted at the next level; the last level is the last one on which anything is found twice.
    """
    n, levels = len(words), []
    places, key = np.arange(n), words
    while True:
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = counts > 1
        if not twice.any():
            return levels
        names = np.arange(n, 2 * n)
        found = twice[inverse]
        names[places[found]] = (np.cumsum(twice) - 1)[inverse[found]]
        half = 1 << len(levels)
        levels.append(names)
        places = places[found]
        places = places[places + half < n]
        places = places[names[places + half] < n]
        key = names[places] * np.int64(n) + names[places + half]


def extensions(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the words from at, and those before at, are the same as the words a period further on: from the highest level down."""
    n = len(levels[0])
    right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        there = at + period + right
        same = names[np.minimum(there, n - 1)] == names[np.minimum(there - period, n - 1)]
        right += np.where(same & (there < n), 1 << k, 0)
        here = at - left - (1 << k)
        same = names[np.maximum(here, 0)] == names[np.maximum(here, 0) + period]
        left += np.where(same & (here >= 0), 1 << k, 0)
    return right, left


def runs(words: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, by start, then period; none has a period above longest / least_periods.

    Of a run of four periods p or more, the first place on a grid of step p has the same 2p + 1 words
    as the next one, so a look at one level tells the candidates of a period. Neighbours on the
    grid belong to one run, the first is extended. A stretch that has several periods is met first with the least.
    """
    none = np.zeros(0, np.int64)
    levels = naming(words)
    heads, periods = [], []
    for p in range(1, longest // least_periods + 1):
        k = ((least_periods - 2) * p + 1).bit_length() - 1
        if k >= len(levels):
            break
        grid = levels[k][::p]
        same = grid[1:] == grid[:-1]
        if same.any():
            same[1:] &= ~same[:-1].copy()
            head = np.flatnonzero(same)
            heads.append(head * p)
            periods.append(np.full(len(head), p))
    if not heads:
        return none, none, none
    at, period = np.concatenate(heads), np.concatenate(periods)
    right, left = extensions(levels, at, period)
    start, length = at - left, left + right + period
    keep = (length >= least_words) & (length >= least_periods * period)
    start, length, period = start[keep], length[keep], period[keep]
    _, first = np.unique(start * np.int64(len(words) + 1) + length, return_index=True)  # the first has the least period
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that are named side by side."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PART_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _found(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, start, length, period) of the runs of all texts, and the texts without what repeats.

    A word is another one in each text, so that what one text has in common with another is no repeat.
    """
    split = [t.split() for t in texts]  # bytes: ASCII white space alone
    sizes = np.array([len(w) for w in split], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.array([w for ws in split for w in ws], pa.binary())
    doc = np.repeat(np.arange(len(texts)), sizes)
    codes = words.dictionary_encode()
    numbers = doc * np.int64(len(codes.dictionary) + 1) + codes.indices.to_numpy()
    start, length, period = runs(numbers, int(sizes.max(initial=0)))
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    keep = np.cumsum(cover[:-1]) == 0
    of = doc[start]
    shorter = set(of.tolist())
    out = [b" ".join(compress(ws, keep[a:b].tolist()) if k in shorter else ws) for k, (ws, a, b) in enumerate(zip(split, begins[:-1], begins[1:], strict=True))]
    return of, start - begins[of], length, period, out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, text) for every row of docs: its periodic runs of words, and its words without what they repeat.

    A run is a stretch of consecutive words with a least period q (words q apart are the same) of
    6 words and 4 periods at least, which no neighbouring word extends under that period; runs are
    by start, then period. A word goes if some run has it after its first q words; those that
    stay are joined by one space. Words are what ASCII white space parts.

    Null text counts as empty and has no run; a null id is kept; repeated rows give repeated rows;
    an empty table gives an empty result; further columns are not read. Texts are read whole,
    whatever their length; a batch takes some 100 bytes a word in memory.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in _together(texts):
                of, start, length, period, out = _found(texts[a:b])
                ends = np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                columns = [batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), found), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.record_batch(columns, names=["id", "runs", "text"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, runs array<{RUN}>, text string")


def with_cycles(docs: DataFrame) -> DataFrame:
    """documents, a tenth of which repeat a stretch of their words up to the end (by the crc32 of doc_id), words joined by one space; a null id is none of these."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    times, rest = F.floor(left / F.col("p")).cast("int"), (left % F.col("p")).cast("int")
    cycle = lambda size: F.slice("w", F.col("a") + 1, size)
    parts = F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(cycle(F.col("p")), times)), cycle(rest))
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(parts, " ")).otherwise(F.col("text")).alias("text"))


def most_repeated(found: str) -> Column:
    """Of runs by start, then period, the first one with the greatest length / period, compared exactly; null without a run."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(found, F.lit(None).cast(RUN), lambda best, r: F.when(more(best, r), r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic_runs(with_cycles(documents(spark, sf_dir))).withColumn("best", most_repeated("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return got.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
