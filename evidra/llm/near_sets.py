"""Near-duplicates by word shingles: SimHash and shared rare shingles give pairs, the shingle sets decide, no pair is lost."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import BitFilter, cut, id_text, shared_dir, small_batches, sweep
from .token_files import _place

#: Words of a shingle, and the least Jaccard similarity of near-duplicates as a fraction.
WIDTH, LEAST = 5, (4, 5)
#: Slots of the table that tells how many sets hold a shingle (half a byte each, whatever the input's size), and those of one row of it. Only the cost depends on it.
SLOTS, ROW_SLOTS = 1 << 27, 1 << 16
#: Least number of sets of each level of frequency.
LEVELS = (0, 1, 2, 3, 4, 6, 9, 14, 24, 48, 96, 192, 512, 2048, 8192, 65536)
#: Shingles that a task gathers before it hands their slots on.
MOST_GATHERED = 1 << 22
#: Least bits of a set's map, which has two to four for each hash. Two sets differ by as many hashes at least as their maps by bits.
MAP_BITS = 1024


def shingle_sets(rows: DataFrame, width: int, least: tuple[int, int] | None = None, levels: str | None = None) -> DataFrame:
    """(id, t, v, fp, n, m, h) for every row of (id, text, t): hash and size of the set of shingles, SimHash, a map of bits, and the set's hashes.

    With least only the prefix: of two sets that are so similar, the first n - ceil(least * n) + 1
    hashes share one, whatever the order; here it is that of levels (a folder of frequency_levels), the rarest first.
    """
    import xxhash

    small_batches(rows.sparkSession)
    slots = SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            if table is None and levels is not None:
                table = Levels(levels, slots)
            vs, fps, ns, maps, sets = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = simhash.shingle_hashes(text, width)
                own = np.unique(hashes)
                vs.append(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 7))
                fps.append(simhash.fingerprint(hashes))
                ns.append(len(own))
                bits = np.zeros(max(MAP_BITS, 1 << (2 * len(own)).bit_length()), bool)
                bits[own & np.uint64(len(bits) - 1)] = True
                maps.append(np.packbits(bits).view(np.int64))
                if least is not None and len(own):
                    if table is not None:
                        own = own[np.argsort(table.of(own), kind="stable")]
                    own = own[: len(own) + (-len(own) * least[0]) // least[1] + 1]
                sets.append(own)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([np.array([], np.uint64), *sets]).astype(np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(2), pa.array(np.array(vs, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.array(ns, pa.int32()), pa.array(maps, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(values))]
            yield pa.record_batch(columns, names=["id", "t", "v", "fp", "n", "m", "h"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t bigint, v bigint, fp bigint, n int, m array<bigint>, h array<bigint>")


class Levels:
    """The table of frequency_levels, as a task reads it from the shared folder; it goes with the task."""

    def __init__(self, folder: str, slots: int):
        import pyarrow.dataset as ds

        system, path = _place(folder)
        self.table = np.zeros(slots // 2, np.uint8)
        for batch in ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False).to_batches(batch_size=64):
            for block, data in zip(*(batch.column(c).to_pylist() for c in ("block", "levels")), strict=True):
                self.table[block * len(data) : (block + 1) * len(data)] = np.frombuffer(data, np.uint8)
        pa.default_memory_pool().release_unused()

    def of(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64(2 * len(self.table) - 1)
        return (self.table[(slot >> np.uint64(1)).astype(np.int64)] >> ((slot & np.uint64(1)) << np.uint64(2)).astype(np.uint8)) & 15


def frequency_levels(rows: DataFrame, width: int) -> str:
    """A folder of the shared one with a table of SLOTS levels: how many sets hold a shingle of a slot (see LEVELS).

    All sets of (text) count. Tasks sort the slots that they meet and send them on as differences;
    each row of the table is summed where they come together, one part after another. The table
    has a fixed size (64 MB), which each task reads, so nothing of it passes through the driver; in a
    corpus with many more shingles than slots it still tells those that are far more frequent than a slot's usual load.
    """
    import zstandard

    small_batches(rows.sparkSession)
    slots_, row_slots, most = SLOTS, ROW_SLOTS, MOST_GATHERED

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pack = zstandard.ZstdCompressor(level=1).compress

        def parts() -> pa.RecordBatch:
            slots = np.sort(np.concatenate([np.zeros(0, np.uint32), *held]))
            held.clear()
            edges = np.searchsorted(slots, np.arange(0, slots_ + 1, row_slots))
            full = np.flatnonzero(np.diff(edges)).tolist()
            data = [pack(np.diff(slots[edges[b] : edges[b + 1]] - np.uint32(b * row_slots), prepend=np.uint32(0)).astype("<u2").tobytes()) for b in full]
            return pa.record_batch([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["block", "slots"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append((np.unique(simhash.shingle_hashes(text, width)) & np.uint64(slots_ - 1)).astype(np.uint32))
            if sum(map(len, held)) > most:
                yield parts()
        yield parts()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, unpack = None, np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress

        def row() -> pa.RecordBatch:
            level = (np.searchsorted(LEVELS, total, side="right") - 1).astype(np.uint8)
            return pa.record_batch([pa.array([block], pa.int32()), pa.array([(level[::2] | level[1::2] << 4).tobytes()])], names=["block", "levels"])

        for batch in batches:
            for b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if block is not None:
                        yield row()
                    block, total = b, np.zeros(row_slots, np.int64)
                total += np.bincount(np.cumsum(np.frombuffer(unpack(data), "<u2"), dtype=np.int64), minlength=row_slots)
        if block is not None:
            yield row()

    met = rows.select("text").mapInArrow(gather, "block int, slots binary")
    folder = f"{shared_dir(rows.sparkSession)}/levels-{uuid.uuid4().hex}"
    met.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, levels binary").write.parquet(folder)
    return folder


def alike(rows: DataFrame, one: DataFrame, pairs: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) whose sets have the similarity.

    Sets of that similarity differ by a part of their sizes at most, so most pairs are told by their
    maps (of two sizes, one is twice the other then; its halves are put together). The sets are
    made again, of the texts that the other pairs name.
    """
    of = lambda x: one.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}"))
    half = lambda m: F.floor(F.size(m) / 2).cast("int")
    folded = lambda m, o: F.when(F.size(m) > F.size(o), F.zip_with(F.slice(m, F.lit(1), half(m)), F.slice(m, half(m) + 1, half(m)), lambda x, y: x.bitwiseOR(y))).otherwise(F.col(m))
    apart = F.aggregate(F.zip_with(folded("ma", "mb"), folded("mb", "ma"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = one.select(F.col("v").alias("w"), F.col("n").alias("nw"))
    sized = pairs.join(sizes.withColumnsRenamed({"w": "a", "nw": "na"}), "a").join(sizes.withColumnsRenamed({"w": "b", "nw": "nb"}), "b")
    sized = sized.filter(least[0] * F.greatest("na", "nb") <= least[1] * F.least("na", "nb"))
    near = sized.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter(apart * sum(least) <= (least[1] - least[0]) * (F.col("na") + F.col("nb")))
    pairs = cut(near.select("a", "b"))
    wanted = cut(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct())
    ids = wanted.join(one.select("v", "least"), "v").select(F.col("least").alias("id"))
    texts = BitFilter(ids, "id").mark(rows, "_hit").filter("_hit").select("id", "text", "t")
    sets = shingle_sets(texts, width).select("v", "h").join(wanted, "v", "left_semi").dropDuplicates(["v"])
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("v").alias("b"), F.col("h").alias("hb")), "b")
    return cut(both.filter(F.size(F.array_intersect("ha", "hb")) * sum(least) >= least[0] * (F.size("ha") + F.size("hb"))).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """(id, t, component) for every row of docs: its id, the xxhash64 of its text, and the least id reachable over pairs of that Jaccard similarity or more.

    Equal sets are one vertex (texts without a word are equal; texts of fewer words than a shingle
    have one of all words). First come few pairs: SimHash links, and each set with the least one
    that a prefix shingle has. What they join needs no further pair; then all pairs of a prefix
    shingle follow that are in different components and that size and place in the order allow.
    Every pair is checked on its sets, so components are exact.

    Null text counts as empty; null ids are kept and are larger than any other; repeated rows give
    repeated rows; an empty table gives an empty result; further columns are not read.
    """
    rows = id_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    done = lambda df: (cut(df), sweep(df.sparkSession))[0]  # noqa: E731  # each step's shuffle files go before the next one's come
    levels = frequency_levels(rows, width)
    signed = done(shingle_sets(rows, width, least, levels))
    system, path = _place(levels)
    system.delete_dir(path)
    one = cut(signed.groupBy("v").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.first("m").alias("m")))
    tokens = signed.select("v", "n", F.posexplode("h").alias("pos", "h"))
    keys = done(tokens.groupBy("h").agg(F.min("v").alias("c"), F.max("v").alias("d")).filter("c <> d").select(F.col("h").alias("k"), "c"))
    some = BitFilter(keys.select(F.col("k").alias("h")), "h", bits=1 << 25).mark(tokens, "_hit").filter("_hit")
    shared = done(some.join(keys, F.col("h") == F.col("k")).select("h", "v", "n", "pos", "c").distinct())

    first = shared.filter("v = c").select(F.col("h").alias("k"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    # two sets share no hash before the first that they share, and no more after it than either has left: a pair meets under that one
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    enough = most * sum(least) >= least[0] * (F.col("n") + F.col("n2"))
    near = shared.join(first, F.col("h") == F.col("k")).filter(enough).select("c", "v")
    prints = cut(one.groupBy("fp").agg(F.min("v").alias("c")))
    named = lambda x: prints.select(F.col("fp").alias(x), F.col("c").alias(f"v{x}"))
    pairs = simhash.links(prints.select("fp")).join(named("a"), "a").join(named("b"), "b").select(F.col("va").alias("c"), F.col("vb").alias("v"))
    pairs = pairs.union(one.select("fp", "v").join(prints, "fp").select("c", "v")).union(near).filter("c <> v")
    pairs = done(pairs.select(F.least("c", "v").alias("a"), F.greatest("c", "v").alias("b")).distinct())
    found = alike(rows, one, pairs, width, least)
    sweep(rows.sparkSession)

    labels = simhash.components(found).select(F.col("v").alias("w"), "label")
    apart = cut(shared.join(labels, F.col("v") == F.col("w"), "left").select("h", "v", "n", "pos", F.coalesce("label", "v").alias("label")))
    mixed = apart.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    apart = done(apart.join(mixed, "h", "left_semi"))
    other = apart.select("h", *[F.col(c).alias(f"{c}2") for c in ("v", "n", "pos", "label")])
    more = apart.join(other, "h").filter((F.col("v") < F.col("v2")) & (F.col("label") != F.col("label2")) & enough)
    more = done(more.select(F.col("v").alias("a"), F.col("v2").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    found = found.union(alike(rows, one, more, width, least))

    labels = simhash.components(found).select(F.col("v").alias("w"), "label")
    told = cut(one.select("v", "least").join(labels, F.col("v") == F.col("w"), "left").select("v", "least", F.coalesce("label", "v").alias("label")))
    smallest = cut(told.groupBy("label").agg(F.min("least").alias("component")))
    named = cut(told.join(smallest, "label").select(F.col("v").alias("w"), "component"))
    return signed.select("id", "t", "v").join(named, F.col("v") == F.col("w")).select("id", "t", "component")
