"""SimHash near-dedup: fingerprints, links at a few differing bits by the general pigeonhole principle, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.clusters import connected

from .common import cut, documents, id_text, small_batches

BITS, DISTANCE, SHINGLE = 64, 3, 3
#: Larger buckets are split again by bits they don't share yet, so no task compares more than this many at once.
BUCKET = 1024
#: Fingerprints (in order of a hash) from which the plan estimates how often parts of two fingerprints agree.
PLAN_SAMPLE = 2000
#: Cost of a bucket row (shuffled twice) in comparisons of two fingerprints.
ROW_COST = 40.0


def shingle_hashes(text: str, words_per: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle, repeated ones too; of all words, if fewer; none without a word."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lower-cased, ASCII white space alone splits
    if not words:
        return np.array([], np.uint64)
    last = max(1, len(words) - words_per + 1)
    shingles = map(b" ".join, zip(*(words[i : i + last] for i in range(words_per)), strict=True)) if len(words) >= words_per else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, last)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64 bits: bit b is set if over half the hashes have it; 0 without a hash."""
    last = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def simhash(text: str, words_per: int = SHINGLE) -> int:
    """Signed 64 bits: bit b is set if over half the shingle hashes have it; 0 without a word."""
    return fingerprint(shingle_hashes(text, words_per))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([simhash(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "fp"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


# ---------------------------------------------------------------- the plan


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def correlations(prints: DataFrame) -> np.ndarray:
    """|correlation| of each two bits over all distinct fingerprints: 64 x 64 counts are summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        at = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.record_batch([pa.array(at), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["at", "n"])

    rows = prints.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    n, both = max(1.0, flat[-1]), flat[:-1].reshape(BITS, BITS)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each takes the bits most correlated with those it has."""
    left, out = set(range(BITS)), []
    corr = corr - np.diag(np.diag(corr))
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        part = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def allocate(sample: np.ndarray, count: int, parts: list[list[int]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """(cost, thresholds): the general pigeonhole principle needs thresholds that sum to distance - parts + 1.

    Two fingerprints within distance then agree to within its threshold on one part at least; -1
    leaves a part out. Dynamic programming over the parts takes the thresholds with the least
    estimated rows and candidate pairs.
    """
    need, n, half = distance - len(parts) + 1, float(count), len(sample) // 2
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        own = sample & np.uint64(sum(1 << b for b in part))
        near = np.bincount(np.bitwise_count(own[:half, None] ^ own[None, half:]).ravel(), minlength=BITS + 1)
        cost = {-1: 0.0}
        for t in (0, 1):  # a ball of radius 2 would have hundreds of rows for each fingerprint
            ball = 1 + t * len(part)
            share = max(near[: t + 1].sum() / max(1, near.sum()), ball / 2.0 ** len(part))
            cost[t] = n * ball * ROW_COST + n * n / 2 * share * (1 + t)
        longer: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in cost.items():
                option = (spent + c, [*chosen, t])
                longer[total + t] = min(option, longer.get(total + t, option))
        best = longer
    return best.get(need, (float("inf"), []))


def make_plan(prints: DataFrame, count: int, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """(parts, thresholds) of the cheapest partition into 2 to 6 parts."""
    sample = [r["fp"] for r in prints.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).collect()]
    sample = np.array(sample or [0], np.int64).view(np.uint64)
    corr = correlations(prints)
    options = []
    for m in range(2, 7):
        parts = grouped_bits(corr, m)
        cost, thresholds = allocate(sample, count, parts, distance)
        options.append((cost, m, parts, thresholds))
    _, _, parts, thresholds = min(options)
    return parts, thresholds


# ---------------------------------------------------------------- links


def _buckets(prints: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(path, key, fp, own): each fingerprint under its part's value, and near values where the threshold is 1."""
    moves, masks = [], []
    for k, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
        masks.append(sum(1 << b for b in part))
        if t >= 0:
            moves += [(k, _signed(masks[k]), _signed(1 << b) if b is not None else 0, b is None) for b in [None, *(part if t else [])]]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.lit(m).cast("bigint").alias("mask"), F.lit(f).cast("bigint").alias("flip"), F.lit(own).alias("own")) for k, m, f, own in moves])).alias("m")
    got = prints.select("fp", rows)
    return got.select(F.col("m.path").alias("path"), F.col("fp").bitwiseAND(F.col("m.mask")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp", F.col("m.own").alias("own"))


def _split(hot: DataFrame, left: list[list[int]], distance: int) -> tuple[DataFrame, list[list[int]]]:
    """Hot buckets under the value of each of distance + 1 parts of the bits that their members need not share yet.

    Two members within distance agree on one of these parts at least.
    """
    table, after = [], []
    for r in hot.select("path").distinct().collect():  # paths are parts of parts: few, whatever the number of rows
        bits = left[r["path"]]
        for piece in np.array_split(bits, distance + 1):
            taken = set(map(int, piece))
            table.append((r["path"], len(after), _signed(sum(1 << b for b in taken))))
            after.append([b for b in bits if b not in taken])
    masks = F.broadcast(hot.sparkSession.createDataFrame(table, "of int, at int, mask long"))
    rows = hot.join(masks, F.col("path") == F.col("of"))
    key = F.xxhash64("key", F.col("fp").bitwiseAND(F.col("mask")))
    return rows.select(F.col("at").alias("path"), key.alias("key"), "fp", "own"), after


def _forest(distance: int):
    """Links within a bucket, as few as join the same members: each is linked to one that is in its tree already."""

    def links(fps: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
        values, out = fps.view(np.uint64), []
        todo = np.ones(len(fps), bool)
        for start in range(len(fps)):
            if not todo[start]:
                continue
            todo[start], wave = False, [start]
            while wave and todo.any():
                at, rest = wave.pop(), np.flatnonzero(todo)
                near = rest[(np.bitwise_count(values[rest] ^ values[at]) <= distance) & (own[rest] | own[at])]
                todo[near] = False
                out += [(int(fps[at]), int(fps[x])) for x in near]
                wave += list(near)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for fps, own in zip(batch.column(0), batch.column(1), strict=True):
                found += links(fps.values.to_numpy(zero_copy_only=False), own.values.to_numpy(zero_copy_only=False))
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints at distance or fewer differing bits, enough to join all that are linked.

    Buckets come from the general pigeonhole plan. A bucket of more than bucket members is dealt
    again by further bits, which keeps every link; members are distinct, so buckets end when few
    bits are left. Each bucket gives one link less than it has members at most.
    """
    count = prints.count()
    parts, thresholds = make_plan(prints, count, distance)
    rows, left = _buckets(prints, parts, thresholds), [[b for b in range(BITS) if b not in part] for part in parts]
    found = None
    for _ in range(32):
        rows = cut(rows)
        sizes = cut(rows.groupBy("path", "key").agg(F.count("*").alias("n"), F.max("own").alias("any")).filter("n > 1 and any").select(F.col("path").alias("p"), F.col("key").alias("k"), "n"))
        dealt = cut(rows.join(sizes, (F.col("path") == F.col("p")) & (F.col("key") == F.col("k"))).select("path", "key", "fp", "own", "n"))
        cold = dealt.filter(F.col("n") <= bucket).groupBy("path", "key").agg(F.collect_list(F.struct("fp", "own")).alias("m"))
        small = cold.select(F.col("m.fp").alias("fps"), F.col("m.own").alias("own")).mapInArrow(_forest(distance), "a bigint, b bigint")
        found = small if found is None else found.unionByName(small)
        hot = dealt.filter(F.col("n") > bucket)
        if hot.limit(1).count() == 0:
            break
        rows, left = _split(hot, left, distance)
    else:
        raise ValueError("buckets don't end: a larger bucket is needed")
    return cut(found.distinct())


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each vertex's component of (a, b).

    Classes hook to the least label that a neighbour has, and hooks are followed to their ends by
    halving, so rounds grow with the logarithm of the longest path, whatever the order of vertices.
    """
    return connected(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component) for every row of docs; component is the least id reachable over links.

    Fingerprints over shingles of three words (of all words, if fewer; 0 without a word) are linked
    at distance or fewer differing bits. Equal fingerprints are one vertex from the start, so
    copies cost one row each, however many there are.

    Null text counts as empty; null ids are kept and are larger than any other (a component of
    null ids alone has a null); repeated rows give repeated rows; an empty table gives an empty
    result; further columns are not read.
    """
    signed = cut(signatures(docs, id_col, text_col))
    prints = cut(signed.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(links(prints, distance))
    # only linked fingerprints have a label
    told = prints.join(labels, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    told = cut(told)
    smallest = cut(told.groupBy("label").agg(F.min("least").alias("component")))
    named = cut(told.join(smallest.withColumnRenamed("label", "l"), F.col("label") == F.col("l")).select(F.col("fp").alias("f"), "component"))
    return signed.join(named, F.col("fp") == F.col("f")).select("id", "fp", "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(documents(spark, sf_dir))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
