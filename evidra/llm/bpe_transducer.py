"""Byte-level BPE by a lazily determinised transducer; decoding by an incremental UTF-8 machine."""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, small_batches
from .words import MAX_WORDS, PATTERN, WordIds

#: Memoised pieces and states are dropped and built anew beyond these counts, so memory stays bounded.
MAX_PIECES, MAX_STATES, MAX_PAIRS = 150_000, 200_000, 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Reads bytes, writes token ids as soon as no later byte can change them.

    BPE gives each prefix of a piece exactly one token sequence, and a sequence is the right one
    if and only if each two neighbours alone would not be merged differently. So the
    nondeterministic machine is at (end of a tokenised prefix, path into an unfinished token);
    a deterministic state is the set of these, keyed by the bytes still open and the last token
    written or, where no token may start there any more, those after it that aren't sure yet. States and moves are made when first met.
    """

    def __init__(self, ranks: dict[bytes, int], memory: float = 1.0):
        self.ranks, self.most_states, self.most_pairs = ranks, MAX_STATES * memory, MAX_PAIRS * memory
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.open = {k[:i] for k in ranks for i in range(1, len(k))}
        self.pairs: dict[int, bool] = {}
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.spines: dict[int, tuple] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        root = (-1, None, 0)
        self.start = self._state(b"", ((b"", root),), root)

    def _state(self, pending: bytes, alive: tuple, root: tuple) -> int:
        """Tokens are nodes (token, node before, depth); root is the last one that was written."""
        if alive[0][1] is root:
            key = (pending, root[0])
        else:  # what follows depends on the tokens after the root, no longer on the root
            chain = []
            for _, node in alive:
                while node is not root:
                    chain.append(node[0])
                    node = node[1]
                chain.append(-1)
            key = (pending, tuple(chain))
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append((pending, alive, root))
        return got

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.parts:
            limit, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= limit:
                    raise ValueError("this vocabulary is not closed under its merges")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = tuple(parts) if len(parts) == 2 else None
        return self.parts[token]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """(bytes, rank, rank of the merge that uses it up) of the tokens met at that edge of token, outermost first."""
        key = token << 1 | side
        if (got := self.spines.get(key)) is None:
            got, at, used = [], self.bytes_of[token], 1 << 60
            while True:
                got.append((at, self.ranks[at], used))
                used = self.ranks[at]
                if (parts := self.split(at)) is None:
                    break
                at = parts[side]
            self.spines[key] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge across the edge comes before the merges that make left and right.

        Two tokens at the edge are merged once both are there, if neither is used up before; of
        equal merges the one further left comes first.
        """
        if left < 0:
            return True
        key = left << 24 | right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > self.most_pairs:
                self.pairs.clear()
            get, got = self.ranks.get, True
            others = self.spine(right, 0)
            for a, rank_a, used_a in self.spine(left, 1):
                for b, rank_b, used_b in others:
                    rank = get(a + b)
                    if rank is not None:
                        when = max(rank, rank_a, rank_b)
                        if when < used_a and when <= used_b:
                            got = False
                            break
                if not got:
                    break
            self.pairs[key] = got
        return got

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        pending, alive, root = self.states[state]
        one, get, unfinished = bytes((byte,)), self.ranks.get, self.open
        pending += one
        token, later = None, []
        for path, node in alive:
            path += one
            if token is None:
                got = get(path)
                if got is not None and self.fits(node[0], got):
                    token = (got, node, node[2] + 1)
            if path in unfinished:
                later.append((path, node))
        if token is None:
            raise ValueError("this vocabulary is not closed under its merges")
        later.append((b"", token))
        common = later[0][1]
        if common is not root:
            for _, node in later:
                while node[2] > common[2]:
                    node = node[1]
                while common[2] > node[2]:
                    common = common[1]
                while node is not common:
                    node, common = node[1], common[1]
        if common is root:
            return self._state(pending, tuple(later), root), ()
        out, node, used = [], common, 0
        while node is not root:
            out.append(node[0])
            used += len(self.bytes_of[node[0]])
            node = node[1]
        out.reverse()
        return self._state(pending[used:], tuple(later), common), tuple(out)

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self._reset()
        state, out, moves = self.start, [], self.moves
        for byte in piece:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        _, alive, root = self.states[state]
        node, tail = alive[-1][1], []
        while node is not root:
            tail.append(node[0])
            node = node[1]
        return out + tail[::-1]


class Encoder:
    """Texts to little-endian 32-bit ids: each match of the pattern goes through the transducer on its own.

    Words, and the matches within them, are remembered when met lately. New ones are met in
    order, so that those with a common start find its states at hand.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: float = 1.0):
        import regex

        self.find, self.machine = regex.compile(pattern).findall, Transducer(ranks, memory)
        self.pieces: dict[str, bytes] = {}
        self.most_pieces = MAX_PIECES * memory
        self.words = WordIds(lambda words: list(map(self._whole, words)), self._whole, pattern == PATTERN, int(MAX_WORDS * memory))

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > self.most_pieces:
            self.pieces.clear()
        found = self.machine.encode(piece.encode())
        ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _whole(self, text: str) -> bytes:
        get = self.pieces.get
        return b"".join([get(p) or self._piece(p) for p in self.find(text)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.words(texts)


class Utf8Machine:
    """Token ids to bytes and text, one id at a time.

    The state is what is left open of the last character (at most three bytes); a move per state
    and token is kept. A byte that fits no character, and an end inside one, raise ValueError.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.moves = bytes_of, {}
        size = max(bytes_of, default=-1) + 1
        self.whole = np.zeros(size, bool)  # tokens of whole characters: between them the state is empty
        self.strings: list[str | None] = [None] * size
        for token in bytes_of:
            tail, text = self._whole_or_not(token)
            self.whole[token] = not tail
            self.strings[token] = None if tail else text

    def _whole_or_not(self, token: int) -> tuple[bytes, str]:
        try:
            return self._move(b"", token)
        except ValueError:
            return b"?", ""

    def _move(self, state: bytes, token: int) -> tuple[bytes, str]:
        data = state + self.bytes_of[token]
        i = 0
        while i < len(data):
            b = data[i]
            size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            if not size:
                raise ValueError(f"byte {b:#x} starts no character")
            if i + size > len(data):
                break
            i += size
        tail = data[i:]
        for k, b in enumerate(tail[1:]):
            low, high = (0x80, 0xBF) if k else {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(tail[0], (0x80, 0xBF))
            if not low <= b <= high:
                raise ValueError(f"byte {b:#x} continues no character")
        return tail, data[:i].decode("utf-8")

    def text(self, ids: np.ndarray) -> str:
        """Runs of whole tokens are taken at once; the machine steps through the others one by one."""
        string = self.strings.__getitem__
        parts = np.flatnonzero(~self.whole[ids])
        if not len(parts):
            return "".join(map(string, ids.tolist()))
        state, out, at, moves = b"", [], 0, self.moves
        for k in parts.tolist():
            if k > at:
                if state:
                    raise ValueError("a token starts inside a character")
                out.append("".join(map(string, ids[at:k].tolist())))
            key = (state, token := int(ids[k]))
            if (move := moves.get(key)) is None:
                move = moves[key] = self._move(state, token)
            state = move[0]
            out.append(move[1])
            at = k + 1
        if state:
            raise ValueError("a token starts inside a character, or the ids end there")
        out.append("".join(map(string, ids[at:].tolist())))
        return "".join(out)


_made: dict = {}


def _once(key: tuple, make):
    """Per Python worker: tables are built for the first batch and reused by later ones."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))]))


def _tables(spark: SparkSession, vocabulary: str, memory: float = 1.0):
    """(encoder, decoder) makers for a Python worker, from the file (about 1 MB), which the driver reads and broadcasts."""
    with open(vocabulary, "rb") as file:
        data = spark.sparkContext.broadcast(file.read())
    encoder = lambda pattern: _once(("encoder", vocabulary, pattern, memory), lambda: Encoder(parse_ranks(data.value), pattern, memory))
    decoder = lambda: _once(("decoder", vocabulary), lambda: Utf8Machine({v: k for k, v in parse_ranks(data.value).items()}))
    return encoder, decoder


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of docs, by the ranks in the file vocabulary.

    Null text counts as empty and has no ids; a null id is kept; repeated rows give repeated rows;
    an empty table gives an empty result; further columns are not read. Texts are encoded whole,
    whatever their length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoder, _ = _tables(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(pattern)
        gc.disable()  # states and words hold no cycles, and there are enough of them to make each collection slow
        for batch in batches:
            yield pa.record_batch([batch.column(0), _lists(to_ids(batch.column(1).to_pylist()))], names=["id", "ids"])
        gc.enable()

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """tokens (id, ids, further columns) with the decoded text; null ids decode to the empty text."""
    spark = tokens.sparkSession
    small_batches(spark)
    _, decoder = _tables(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = decoder()
        for batch in batches:
            text = pa.array([machine.text(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.record_batch([*batch.columns, text], names=[*batch.schema.names, "text"])

    rows = tokens.select("id", "ids", *[c for c in tokens.columns if c not in ("id", "ids", "text")])
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memory: float = 1.0) -> DataFrame:
    """(id, ids, text): encode, then decode of the ids alone, in one Python pass; rows as for encode.

    memory scales what a Python worker remembers (about 400 MB at 1) and keeps after its task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoder, decoder = _tables(spark, vocabulary, memory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, machine = encoder(pattern), decoder()
        gc.disable()
        for batch in batches:
            ids = to_ids(batch.column(1).to_pylist())
            text = pa.array([machine.text(np.frombuffer(x, "<i4")) for x in ids], pa.string())
            yield pa.record_batch([batch.column(0), _lists(ids), text], names=["id", "ids", "text"])
        gc.enable()

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, text string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    got = round_trip(documents(spark, sf_dir), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
