from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from evidra.llm import bpe_transducer as B
from tests.llm import rows as R


@pytest.fixture(scope="module")
def ranks():
    return B.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(11)
    wild = ["".join(chr(rng.choice([32, 10, rng.randint(0, 127), rng.randint(128, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0x10000, 0x10FFFF)])) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    spaces = ["".join(rng.choice(["a", " ", "\n", "b.", "\t", "\u00a0", "'s", "9"]) for _ in range(30)) for _ in range(200)]
    return [t or "" for _, t, *_ in R.documents()] + wild + spaces + ["a" * 400, " " * 90, "ab" * 200, "<|endoftext|>", "x" * 33 + " " + "é" * 50]


def test_ids_equal_the_library_and_decode_to_the_text(ranks, library):
    encode, machine = B.Encoder(ranks, P.PATTERN), B.Utf8Machine({v: k for k, v in ranks.items()})
    for text, ids in zip(texts(), encode(texts()), strict=True):
        got = np.frombuffer(ids, "<i4")
        assert got.tolist() == library.encode_ordinary(text)
        assert machine.text(got) == text


def test_small_caches_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(B, "MAX_STATES", 20)
    monkeypatch.setattr(B, "MAX_PIECES", 5)
    monkeypatch.setattr(B, "MAX_PAIRS", 10)
    encode = B.Encoder(ranks, P.PATTERN)
    assert [np.frombuffer(x, "<i4").tolist() for x in encode(texts()[:60])] == [library.encode_ordinary(t) for t in texts()[:60]]


def test_neighbours_are_judged_as_by_merging(ranks):
    machine, rng = B.Transducer(ranks), random.Random(4)
    tokens = sorted(ranks.values())

    def merged(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[k] + parts[k + 1] not in ranks:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    for _ in range(3000):
        a, b = rng.choice(tokens[: rng.choice((300, 3000, 50000))]), rng.choice(tokens[: rng.choice((300, 3000, 50000))])
        assert machine.fits(a, b) == (merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])


@pytest.mark.parametrize("data", [b"\xff", b"\xc3", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"a\x80"])
def test_bytes_that_are_no_text_are_refused(ranks, data):
    machine = B.Utf8Machine({v: k for k, v in ranks.items()})
    with pytest.raises(ValueError):
        machine.text(np.array([ranks[data[i : i + 1]] for i in range(len(data))], np.int32))


def test_rows(spark, library):
    rows = R.documents()
    path = P.path("byte_bpe_50k.tiktoken")
    want = sorted(((i, library.encode_ordinary(t or ""), t or "") for i, t, *_ in rows), key=str)
    docs = R.clashing(R.frame(spark, rows))
    assert sorted(((r["id"], r["ids"], r["text"]) for r in B.round_trip(docs, path, P.PATTERN).collect()), key=str) == want
    apart = B.decode(B.encode(docs, path, P.PATTERN), path)
    assert sorted(((r["id"], r["ids"], r["text"]) for r in apart.collect()), key=str) == want
    assert B.round_trip(R.frame(spark, []), path, P.PATTERN).count() == 0
