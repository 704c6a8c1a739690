"""Token ids in binary files: a static range asymmetric numeral system over one shared frequency table.

A folder holds `table.bin` (magic, scale bits, symbol count, their frequencies; little-endian) and
`part-NNNNN.evt` files. A part file is blocks one after another, then its index, then the index's
length and a magic. A block holds whole documents: their count, ids and token counts, then LANES
final states and the 32-bit words that decoding takes in. Symbol k of a block is in lane
k % LANES, so lanes decode side by side; the index (place, length, symbols, CRC-32 of the ids) is the
set of checkpoints at which decoding may start.
"""

from __future__ import annotations

import gc
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_text, shared_dir, small_batches
from .words import BulkWordIds

MAGIC = b"EVRANS1\n"
LANES, SCALE_BITS, LOW = 32, 18, np.uint64(1 << 31)
#: A block ends with the first document that fills it; so many blocks are at hand, and so many of like length are coded side by side.
BLOCK_TOKENS, TOGETHER, ABREAST = 16384, 384, 128
ABSENT = -(1 << 63)

# ---------------------------------------------------------------- tokenizing


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is seen, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in seen}
    out.update({b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(seen)))})
    return out


class Tokens:
    """Packed ids (16 bits each where the vocabulary fits, else 32) by the tokenizers library; words are encoded by it once and remembered.

    A word of letters, with the space before it and one mark after it or not, is one match of the
    pattern (two with the mark): these go straight to the library's model, others through all of it.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        form = "H" if self.kind.itemsize == 2 else "I"
        self.packs = [struct.Struct(f"<{n}{form}").pack for n in range(32)]
        self.letters = {ord(chr(b)): c for b, c in byte_letters().items()}
        self.space = self.letters[32]
        self.marks = {m: self._whole(m) for m in ".,;:!?"}
        self.words = BulkWordIds(self._spaced, self._plain, self._whole, 600_000)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _letters(self, letters: str) -> str | None:
        """As the vocabulary writes them; null if it is safer to ask the library."""
        if letters.isascii():
            return letters
        return letters.encode().decode("latin-1").translate(self.letters) if max(letters) <= "\u024f" else None

    def _packed(self, letters: str) -> bytes:
        ids = [t.id for t in self.model(letters)]
        return self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else np.array(ids, self.kind).tobytes()

    def _spaced(self, word: str) -> bytes | None:
        """Ids of a word after a space; None if it isn't one word."""
        mark = self.marks.get(word[-1:])
        letters = word[:-1] if mark else word
        if letters.isalpha():
            if mark and (known := self.words.words.known(letters)):
                return known + mark
            if (written := self._letters(letters)) is not None:
                return self._packed(self.space + written) + mark if mark else self._packed(self.space + written)
        return self._whole(" " + word) if word.split() == [word] else None

    def _plain(self, word: str) -> bytes | None:
        """Ids of a word at a line's start; None if it isn't one word."""
        if word.isalpha() and (written := self._letters(word)) is not None:
            return self._packed(written)
        return self._whole(word) if word.split() == [word] else None

    def __call__(self, texts: pa.StringArray) -> list[bytes]:
        """A text that holds an added token's string is encoded whole: the library makes it that token."""
        out = self.words(texts)
        for x in self.added:
            for k in np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)).tolist():
                out[k] = self._whole(texts[k].as_py())
        return out


_made: dict = {}


def _tokens(model: str) -> Tokens:
    """One for each Python worker: later tasks know the words of earlier ones."""
    key = zlib.crc32(model.encode())
    if key not in _made:
        _made[key] = Tokens(model)
    return _made[key]


def _zstd():
    """A light compressor and its decompressor, one for each Python worker."""
    import zstandard

    if "zstd" not in _made:
        _made["zstd"] = (zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor())
    return _made["zstd"]


def _pack(ids: bytes, width: int) -> bytes:
    """Ids of one document for the way from task to task, deflated lightly."""
    return str(width).encode() + _zstd()[0].compress(ids)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(data[1:]), "<u2" if data[:1] == b"2" else "<u4").astype(np.uint32)


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many bytes: words that come again are looked up less often."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.nbytes
        if held >= size:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, held = [], 0
    if held:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


# ---------------------------------------------------------------- the coder


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each symbol that occurs."""
    total, goal = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > goal:
        raise ValueError("more symbols than the scale has room for")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (goal / total))), 0).astype(np.int64)
    over = int(freq.sum()) - goal
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # from the most frequent, which it costs least
        take = np.minimum(np.maximum(freq[order] // 2, 0), np.maximum(0, over - np.concatenate(([0], np.cumsum(freq[order] // 2)[:-1]))))
        freq[order] -= take
        over = int(freq.sum()) - goal
    freq[order[0]] -= over
    return freq.astype(np.uint32)


def _alike(sizes: list[int]) -> Iterator[list[int]]:
    """Places in sizes, ABREAST at a time, those of like size together."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    for at in range(0, len(order), ABREAST):
        yield order[at : at + ABREAST]


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = np.uint64(bits), freq.astype(np.uint32)
        self.first = (np.cumsum(freq, dtype=np.int64) - freq).astype(np.uint32)
        self.symbol = np.append(np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)), np.uint32(0))  # the last: for tables without a symbol
        self.room = np.uint64(31 - bits + 32)
        self.mask = np.uint64((1 << bits) - 1)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        out: list[bytes] = [b""] * len(blocks)
        for some in _alike([len(b) for b in blocks]):
            for k, coded in zip(some, self._encode([blocks[k] for k in some]), strict=True):
                out[k] = coded
        return out

    def decode(self, coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
        out: list = [None] * len(coded)
        for some in _alike(lengths):
            for k, symbols in zip(some, self._decode([coded[k] for k in some], [lengths[k] for k in some]), strict=True):
                out[k] = symbols
        return out

    def _encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """States and words of each block; blocks go side by side, from their last symbol to the first."""
        steps = -(-max([1, *map(len, blocks)]) // LANES)
        symbols = np.zeros((steps, len(blocks), LANES), np.uint32)
        for k, b in enumerate(blocks):
            flat = np.zeros(steps * LANES, np.uint32)
            flat[: len(b)] = b
            symbols[:, k] = flat.reshape(steps, LANES)
        lengths = np.array([len(b) for b in blocks])
        lane = np.arange(LANES)
        x = np.full((len(blocks), LANES), LOW, np.uint64)
        sent, words = np.zeros((steps, len(blocks), LANES), bool), np.zeros((steps, len(blocks), LANES), np.uint32)
        shortest = int(lengths.min())
        for t in range(steps - 1, -1, -1):
            s = symbols[t]
            if (t + 1) * LANES <= shortest:  # all lanes have a symbol here
                f = self.freq[s].astype(np.uint64)
                out = np.greater_equal(x, f << self.room, out=sent[t])
                words[t] = x
                y = np.where(out, x >> np.uint64(32), x)
                q = y // f
                x = (q << self.bits) + (y - q * f) + self.first[s]
                continue
            live = t * LANES + lane < lengths[:, None]
            f = np.where(live, self.freq[s], np.uint32(1)).astype(np.uint64)
            out = live & (x >= f << self.room)
            sent[t], words[t] = out, x.astype(np.uint32)
            y = np.where(out, x >> np.uint64(32), x)
            q = y // f
            x = np.where(live, (q << self.bits) + (y - q * f) + self.first[s], x)
        return [x[k].astype("<u8").tobytes() + words[:, k][sent[:, k]].astype("<u4").tobytes() for k in range(len(blocks))]

    def _decode(self, coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
        steps = -(-max([1, *lengths]) // LANES)
        size = np.array(lengths)[:, None]
        x = np.stack([np.frombuffer(c[: 8 * LANES], "<u8") for c in coded]).astype(np.uint64)
        streams = [np.frombuffer(c[8 * LANES :], "<u4") for c in coded]
        words = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
        at = np.concatenate(([0], np.cumsum([len(s) for s in streams])[:-1]))
        ends = at + np.array([len(s) for s in streams])
        out = np.zeros((steps, len(coded), LANES), np.uint32)
        lane = np.arange(LANES)
        shortest = min(lengths)
        for t in range(steps):
            low = x & self.mask
            s = self.symbol[low.astype(np.int64)]
            out[t] = s
            y = self.freq[s] * (x >> self.bits) + low - self.first[s]
            if (t + 1) * LANES <= shortest:
                need = y < LOW
                where = at[:, None] + np.cumsum(need, axis=1) - 1
                x = np.where(need, (y << np.uint64(32)) | words[np.where(need, where, 0)], y)
                at = where[:, -1] + 1
                continue
            live = t * LANES + lane < size
            need = live & (y < LOW)
            where = at[:, None] + np.cumsum(need, axis=1) - 1
            more = words[np.where(need, where, 0)]
            x = np.where(need, (y << np.uint64(32)) | more, np.where(live, y, x))
            at = at + need.sum(axis=1)
        if (at != ends).any() or (x != LOW).any():
            raise ValueError("a block doesn't decode to its start: it is damaged")
        return [out[:, k].reshape(-1)[:n] for k, n in enumerate(lengths)]


# ---------------------------------------------------------------- files


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(uri: str, data: bytes) -> None:
    """Whole or not at all: a task that is run again or twice replaces the file by the same bytes."""
    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as stream:
        stream.write(data)
    system.move(part, path)


def _read(uri: str, at: int | None = None, size: int | None = None) -> bytes:
    system, path = _place(uri)
    with system.open_input_file(path) as file:
        if at is None:
            return file.read()
        file.seek(at)
        return file.read(size)


def _table(freq: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<II", SCALE_BITS, len(freq)) + freq.astype("<u4").tobytes()


def _coder(data: bytes) -> Coder:
    if data[:8] != MAGIC:
        raise ValueError("not a frequency table")
    bits, n = struct.unpack_from("<II", data, 8)
    return Coder(np.frombuffer(data, "<u4", n, 16), bits)


def _index(uri: str) -> dict:
    system, path = _place(uri)
    size = system.get_file_info(path).size
    tail = _read(uri, size - 12, 12)
    if tail[4:] != MAGIC:
        raise ValueError(f"{uri} has no index")
    n = struct.unpack("<I", tail[:4])[0]
    return json.loads(_read(uri, size - 12 - n, n))


def tokenize(docs: DataFrame, model: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, counts binary) in ascending order of id (nulls first, equal ids by text): each partition before the next.

    A partition ends with a row that has nothing but counts: how often each symbol comes in it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model, encoding="utf-8") as file:
        data = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(data.value)
        tail, width = np.array([end], tokens.kind).tobytes(), tokens.kind.itemsize
        gc.disable()  # words hold no cycles, and there are enough of them to make each collection slow
        counts = np.zeros(tokens.tokenizer.get_vocab_size(), np.int64)
        kind = None
        for batch in _gathered(batches):
            ids, kind = [x + tail for x in tokens(batch.column(1))], batch.column(0).type
            counts += np.bincount(np.frombuffer(b"".join(ids), tokens.kind), minlength=len(counts))
            yield pa.record_batch([batch.column(0), pa.array([_pack(x, width) for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names=["id", "ids", "counts"])
        gc.enable()
        if kind is not None:
            yield pa.record_batch([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([_zstd()[0].compress(counts.astype("<i8").tobytes())], pa.binary())], names=["id", "ids", "counts"])

    # dealt as texts: the ranges are found by a pass over the ids, not by encoding everything twice
    rows = id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    return cut(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, counts binary"))


def write_tokens(tokens: DataFrame, folder: str, symbols: int) -> DataFrame:
    """Writes tokens (as tokenize gives them) to folder; (part, n_tokens) of each part file, one for each partition with rows.

    Frequencies are those of all tokens; a row for each symbol reaches the driver, which writes the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                some = np.frombuffer(_zstd()[1].decompress(x), "<i8")
                total[: len(some)] += some
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["s", "n"])

    counts = np.zeros(symbols, np.int64)
    for r in tokens.filter("counts is not null").select("counts").mapInArrow(count, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        counts[r["s"]] = r["n"]
    table = _table(scaled(counts))
    _write(f"{folder}/table.bin", table)
    shared = tokens.sparkSession.sparkContext.broadcast(table)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = _coder(shared.value), TaskContext.get().partitionId()
        out, index, waiting, at, total = [], [], [], 0, 0
        docs, size = [], 0

        def flush() -> None:
            nonlocal at
            for (ids, sizes, symbols_), coded in zip(waiting, coder.encode([w[2] for w in waiting]), strict=True):
                known = np.array([ABSENT if i is None else i for i in ids], "<i8")
                head = struct.pack("<I", len(ids)) + known.tobytes() + np.array(sizes, "<u4").tobytes()
                data = head + coded
                index.append([at, len(data), len(symbols_), zlib.crc32(symbols_.astype("<u4").tobytes())])
                out.append(data)
                at += len(data)
            waiting.clear()

        def close() -> None:
            nonlocal size
            if docs:
                waiting.append(([d[0] for d in docs], [len(d[1]) for d in docs], np.concatenate([d[1] for d in docs])))
                docs.clear()
                size = 0
            if len(waiting) >= TOGETHER:
                flush()

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append((i, _unpack(x)))
                size += len(docs[-1][1])
                total += len(docs[-1][1])
                if size >= BLOCK_TOKENS:
                    close()
        close()
        if waiting:
            flush()
        if index:
            foot = json.dumps(index).encode()
            _write(f"{folder}/part-{part:05d}.evt", b"".join(out) + foot + struct.pack("<I", len(foot)) + MAGIC)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total], pa.int64())], names=["part", "n_tokens"])

    return cut(tokens.filter("counts is null").select("id", "ids").mapInArrow(write, "part int, n_tokens long"))


def read_tokens(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """(id, start, ids binary) of each document, decoded from the files alone; blocks are decoded where they are dealt, in any order.

    start is the number of ids before the document, over all parts in order. Each block is held
    against its checksum; a damaged one raises ValueError.
    """
    rows = sorted((r["part"], r["n_tokens"]) for r in parts.collect())  # one row for each file
    starts, before = [], 0
    for part, n in rows:
        starts.append((part, before))
        before += n
    shared = spark.sparkContext.broadcast(_read(f"{folder}/table.bin"))

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Checkpoints at which decoding may start: TOGETHER blocks at a time."""
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = np.array(_index(f"{folder}/part-{part:05d}.evt"), np.int64)
                firsts = start + np.cumsum(index[:, 2]) - index[:, 2]
                runs = [np.column_stack((index, firsts))[k : k + TOGETHER] for k in range(0, len(index), TOGETHER)]
                yield pa.record_batch([pa.array([part] * len(runs), pa.int32()), pa.array([r.ravel().tolist() for r in runs], pa.list_(pa.int64()))], names=["part", "blocks"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for part, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.array(blocks, np.int64).reshape(-1, 5)
                data = _read(f"{folder}/part-{part:05d}.evt", int(rows[0, 0]), int(rows[-1, 0] + rows[-1, 1] - rows[0, 0]))
                heads, coded = [], []
                for at, size, *_ in (rows - [rows[0, 0], 0, 0, 0, 0]).tolist():
                    n = struct.unpack_from("<I", data, at)[0]
                    heads.append((np.frombuffer(data, "<i8", n, at + 4), np.frombuffer(data, "<u4", n, at + 4 + 8 * n)))
                    coded.append(data[at + 4 + 12 * n : at + size])
                ids, firsts, out = [], [], []
                for (_, _, _, crc, start), (docs, sizes), symbols in zip(rows.tolist(), heads, coder.decode(coded, rows[:, 2].tolist()), strict=True):
                    raw = symbols.astype("<u4").tobytes()
                    if zlib.crc32(raw) != crc:
                        raise ValueError("a block's checksum differs")
                    ends = np.cumsum(sizes.astype(np.int64))
                    ids += [None if i == ABSENT else i for i in docs.tolist()]
                    firsts += (start + ends - sizes).tolist()
                    out += [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(out, pa.binary())], names=["id", "start", "ids"])

    if not starts:
        return spark.createDataFrame([], "id long, start long, ids binary")
    files = spark.createDataFrame(starts, "part int, start long").repartition(len(starts), "part")
    runs = cut(files.mapInArrow(list_runs, "part int, blocks array<bigint>"))
    # by number, so that runs aren't put together by the few bytes that they are before they are read
    deal = max(1, -(-before // (TOGETHER * BLOCK_TOKENS)))
    return runs.repartition(deal, F.xxhash64("part", F.col("blocks")[0])).mapInArrow(read, "id long, start long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer ids; null text is empty (its end id alone); repeated rows are written as often as they come."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens = tokenize(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0)
    parts = write_tokens(tokens, folder, 50257)
    got = read_tokens(spark, folder, parts)
    return got.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
