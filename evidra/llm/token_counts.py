"""Token counts: tokens are counted once for each distinct pre-token and summed over each document's frequencies."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BITS, BitFilter, cut, documents, id_text, small_batches
from .token_files import byte_letters

#: Documents of more tokens than this are over the limit.
LIMIT = 1024
#: Pre-tokens that most documents hold go to all tasks: so many bytes at most, an entry counting as its text and ENTRY_BYTES.
HOT_BYTES, ENTRY_BYTES = 8 << 20, 48
#: Bits of the filter that tells pre-tokens of one document alone: its size is fixed.
FILTER_BITS = 1 << 26
#: Rows of distinct pre-tokens that a task gathers before it hands them on, and odd words that a worker remembers.
MOST_GATHERED, MOST_WORDS = 1_000_000, 200_000
#: Bytes of texts that are taken apart at once.
PART_BYTES = 4 << 20
#: Words that need no look by the library: letters of Latin scripts, with a line end before them and one mark after them or not.
PLAIN = r"^(?P<line>\n?)(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<mark>[.,;:!?]?)$"


class PreTokens:
    """Pre-tokens of texts, and how many tokens the model of the tokenizers library makes of each.

    A byte-level pattern parts a text before each lone space and around each lone line end, so the
    distinct words between these are taken apart once. A text with other white space goes
    through the library's pre-tokenizer whole. Strings of added tokens are one token each; where an
    added token also takes what stands around it, texts that hold it are left to the library.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        self.tokenizer = Tokenizer.from_str(model)
        added = spec.get("added_tokens") or []
        wide = lambda t: t.get("lstrip") or t.get("rstrip") or t.get("single_word") or (t.get("normalized") and spec.get("normalizer"))
        self.strange = [t["content"] for t in added if wide(t)]
        self.plain_added = sorted((t["content"] for t in added if not wide(t)), key=lambda s: (-len(s), s))
        self.parts_added = re.compile("|".join(map(re.escape, self.plain_added))) if self.plain_added else None
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        letters = byte_letters()
        self.letters = {chr(b): c for b, c in letters.items()}
        self.bytes_of = {ord(c): b for b, c in letters.items()}
        self.letter_of = {ord(b): c for b, c in self.letters.items()}
        self.words: dict[str, tuple[str, ...] | None] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens: as they stand in it where the model reads bytes, else as the model gets them."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return [text] if text else []
        found = [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return [s.translate(self.bytes_of).encode("latin-1").decode("utf-8", "surrogatepass") for s in found] if self.byte_level else found

    def tokens(self, pre_token: str) -> int:
        if self.byte_level:
            pre_token = pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letter_of)
        return len(self.tokenizer.model.tokenize(pre_token))

    def _word(self, word: str) -> tuple[str, ...] | None:
        """Pre-tokens of a word after a space, or after a line end that stands before it; None if it isn't one word."""
        if word not in self.words:
            bare = word[1:] if word[:1] == "\n" else word
            one = bare.split() == [bare]
            self.words[word] = tuple(self.split(word if bare is not word else " " + word)) if one else None
        return self.words[word]

    def _whole(self, text: str) -> tuple[Counter, int]:
        """Frequencies of pre-tokens, and tokens beside them."""
        if any(x in text for x in self.strange):
            return Counter(), len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.parts_added.split(text) if self.parts_added else [text]
        found: Counter = Counter()
        for part in parts:
            found.update(self.split(part))
        return found, len(parts) - 1

    def frequencies(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray, np.ndarray]:
        """(text, pre-token, frequency) as numbers, the distinct pre-tokens, and the tokens that each text has beside them."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        beside = np.zeros(len(texts), np.int64)
        odd = np.ones(len(texts), bool)
        at, which, names = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
        if self.byte_level and len(texts):
            at, which, names, odd = self._by_word(texts)
        for x in [*self.plain_added, *self.strange]:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        keep = ~odd[at]
        at, which = at[keep], which[keep]
        more: list[tuple[int, int]] = []
        others: list[str] = []
        for k in np.flatnonzero(odd).tolist():
            found, beside[k] = self._whole(texts[k].as_py())
            more += [(k, n) for n in found.values()]
            others += found
        # a pre-token may come from several words: its names become one number
        coded = pa.concat_arrays([names, pa.array(others, pa.string())]).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        size = max(1, len(coded.dictionary))
        key, times = np.unique(at * size + number[which], return_counts=True)
        rest = np.array(more, np.int64).reshape(-1, 2)
        docs, pieces = np.concatenate([key // size, rest[:, 0]]), np.concatenate([key % size, number[len(names) :]])
        return docs, pieces, np.concatenate([times, rest[:, 1]]), coded.dictionary, beside

    def _by_word(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray, np.ndarray]:
        """(text, pre-token) of each occurrence as numbers, names of pre-tokens (some more than once), and the texts for which the rule doesn't hold."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        known = pc.extract_regex(words, PLAIN)
        plain = known.is_valid().to_numpy(zero_copy_only=False)
        line, letters, mark = (known.field(k).filter(known.is_valid()) for k in range(3))
        ends = pc.equal(line, "\n")
        begun = pc.binary_join_element_wise(pc.if_else(ends, "", " "), letters, "")
        # up to three pre-tokens of each plain word: its line end, its letters, its mark
        has_mark = pc.not_equal(mark, "").to_numpy(zero_copy_only=False)
        has_line = ends.to_numpy(zero_copy_only=False)
        # the first word of a text has no space before it; the library tells it, and all that isn't plain
        firsts = parts.values.take(pa.array(starts[:-1])).to_pylist()
        others = [self._word(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        others += [self._word(w) if w[:1] == "\n" else tuple(self.split(w)) if w.split() == [w] else None for w in firsts]
        codes[starts[:-1]] = len(words) + np.arange(len(texts))
        names = pa.concat_arrays([line, begun, mark, pa.array([s for w in others for s in w or ()], pa.string())])
        count = len(letters)
        lengths, begins = np.zeros(len(words) + len(texts), np.int64), np.zeros(len(words) + len(texts), np.int64)
        rows = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain), len(words) + np.arange(len(texts))])
        sizes = np.concatenate([1 + has_line + has_mark, [len(w or ()) for w in others]]).astype(np.int64)
        lengths[rows] = sizes
        begins[rows] = np.cumsum(sizes) - sizes
        own = np.arange(count)
        triples = np.stack([own, own + count, own + 2 * count], axis=1)
        flat = triples[np.stack([has_line, np.ones(count, bool), has_mark], axis=1)]
        flat = np.concatenate([flat, 3 * count + np.arange(len(names) - 3 * count)])
        bad = np.zeros(len(words) + len(texts), bool)
        bad[rows[count:]] = [w is None for w in others]
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        odd = np.zeros(len(texts), bool)
        odd[doc[bad[codes]]] = True
        each = lengths[codes]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(doc, each), flat[np.repeat(begins[codes], each) + inner], names, odd


_made: dict[int, PreTokens] = {}


def _pre_tokens(model: str) -> PreTokens:
    """One for each Python worker."""
    key = zlib.crc32(model.encode())
    if key not in _made:
        _made[key] = PreTokens(model)
    return _made[key]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, about PART_BYTES of text at a time."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES)))
        yield batch.slice(at, upto - at)
        at = upto


def lexicon(rows: DataFrame, model: str) -> DataFrame:
    """(piece, docs, tokens): each distinct pre-token of (text) that several rows hold once, how many rows, and the tokens it makes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = _pre_tokens(shared.value), []

        def give() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by("piece").aggregate([("docs", "sum")])
            held.clear()
            yield from summed.select(["piece", "docs_sum"]).rename_columns(["piece", "docs"]).to_batches()

        for batch in batches:
            for some in _slices(batch):
                _, which, _, pieces, _ = made.frequencies(some.column("text"))
                held.append(pa.table({"piece": pieces, "docs": np.bincount(which, minlength=len(pieces))}))
                if sum(map(len, held)) > MOST_GATHERED:
                    yield from give()
        if held:
            yield from give()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = _pre_tokens(shared.value).tokens
        for batch in batches:
            tokens = pa.array([tokens_of(s) for s in batch.column("piece").to_pylist()], pa.int64())
            yield pa.record_batch([*batch.columns, tokens], names=["piece", "docs", "tokens"])

    found = rows.select("text").mapInArrow(gather, "piece string, docs bigint").groupBy("piece").agg(F.sum("docs").alias("docs"))
    return found.filter("docs > 1").mapInArrow(count, "piece string, docs bigint, tokens bigint")


def _level() -> F.Column:
    return F.length(F.bin("docs"))


def least_hot_level(known: DataFrame, most_bytes: int) -> int:
    """The least power of two of documents from which all pre-tokens together take most_bytes at most."""
    cost = F.sum(F.octet_length("piece") + F.lit(ENTRY_BYTES))
    sizes = known.groupBy(_level().alias("level")).agg(cost.alias("size")).collect()  # 64 rows at most
    level, left = 65, most_bytes
    for r in sorted(sizes, reverse=True):
        left -= r["size"]
        if left < 0:
            break
        level = r["level"]
    return level


def _filter_bits(keys: DataFrame, bits: int) -> bytes:
    """The bits of a filter over (piece), bits / 8 bytes whatever the number of keys."""
    out = bytearray(bits // 8)
    for r in BitFilter(keys, "piece", bits=bits).blocks.collect():
        out[r[0] * BLOCK_BITS // 8 : (r[0] + 1) * BLOCK_BITS // 8] = r[1]
    return bytes(out)


def _may_be_met_again(pieces: list[str], table: np.ndarray) -> np.ndarray:
    """Whether pieces may be in the filter: its slots are by the hash that Spark takes of a string."""
    import xxhash

    slots = np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in pieces), np.uint64, len(pieces))
    slots &= np.uint64(len(table) * 8 - 1)
    return (table[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs, by the tokenizers file vocabulary; no ids are made.

    Each distinct pre-token is counted once. Those of several documents are counted into a table; the
    most frequent of them (hot_bytes at most, whatever the input's size) go to all tasks, which join
    them with each document's frequencies as they are made. A bit filter of a fixed size tells those of one
    document alone, which are counted where they stand. The others are joined by a shuffle, in which no
    key is frequent. Special strings inside texts are the library's tokens.

    Null text counts as empty and has no tokens; a null id is kept; repeated rows give repeated
    rows; an empty table gives an empty result; further columns are not read. Texts are read whole,
    whatever their length.
    """
    with open(vocabulary, encoding="utf-8") as file:  # a vocabulary, about 2 MB
        model = file.read()
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs, id_col, text_col)
    known = cut(lexicon(rows, model))
    least = least_hot_level(known, hot_bytes)
    hot = known.filter(_level() >= least).select("piece", "tokens").toArrow().combine_chunks()
    shared, table = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(hot)
    rare = known.filter(_level() < least).select("piece", "tokens")
    again = spark.sparkContext.broadcast(_filter_bits(rare, filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, filter_ = _pre_tokens(shared.value), np.frombuffer(again.value, np.uint8)
        names, counts = (table.value.column(c).combine_chunks() for c in ("piece", "tokens"))
        for batch in batches:
            for some in _slices(batch):
                texts = some.column("text")
                at, which, times, pieces, total = made.frequencies(texts)
                tokens = pc.fill_null(counts.take(pc.index_in(pieces, names)), -1).to_numpy(zero_copy_only=False).copy()
                left = np.flatnonzero(tokens < 0)
                words = pieces.take(pa.array(left)).to_pylist()
                alone = ~_may_be_met_again(words, filter_)
                tokens[left[alone]] = [made.tokens(w) for w, one in zip(words, alone.tolist(), strict=True) if one]
                here = tokens[which] >= 0
                np.add.at(total, at[here], times[here] * tokens[which[here]])
                at, which, times = at[~here], which[~here], times[~here]
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(len(texts) + 1)).astype(np.int32)
                open_ = pa.StructArray.from_arrays([pieces.take(pa.array(which[order])), pa.array(times[order])], ["piece", "n"])
                columns = [some.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), open_)]
                yield pa.record_batch(columns, names=["id", "n_bytes", "known", "open"])

    kind = rows.schema["id"].dataType.simpleString()
    summed = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, known bigint, open array<struct<piece: string, n: bigint>>")
    # rows are numbered as they are written, and keep that number from then on
    summed = cut(summed.select(F.monotonically_increasing_id().alias("row"), "*"))
    # what the table doesn't know is a pre-token of one document alone that the filter takes for another
    met = summed.select("row", F.inline("open")).join(rare, "piece", "left").withColumn("lone", F.when(F.col("tokens").isNull(), F.col("piece")))
    met = met.groupBy("row", "lone").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("more"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _pre_tokens(shared.value)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lone", "n", "more"))
            more = [m if w is None else n * made.tokens(w) for w, n, m in zip(*columns, strict=True)]
            yield pa.record_batch([batch.column("row"), pa.array(more, pa.int64())], names=["row", "more"])

    added = met.mapInArrow(told, "row bigint, more bigint").groupBy("row").agg(F.sum("more").alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return summed.drop("open").join(added, "row", "left").select("id", "n_bytes", total.alias("n_tokens"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
