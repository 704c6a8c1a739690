from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evidra.llm import token_files as T
from tests.llm import rows as R

MODEL = P.path("byte_bpe_50k.json")


def wanted(rows):
    tokenizer = Tokenizer.from_file(MODEL)
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows]


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    texts = [t or "" for _, t, *_ in R.documents()] + ["".join(rng.choice(["a", " ", "\n", "b.", "\t", "\u00a0", "'s", "9", "É"]) for _ in range(30)) for _ in range(300)]
    texts += ["end <|endoftext|> of text", "<|endoftext|>", "a<|endoftext|>\n<|endoftext|>b", "<|endoftext |>"]
    tokens = T.Tokens(open(MODEL, encoding="utf-8").read())
    for _ in range(2):
        assert [np.frombuffer(x, tokens.kind).tolist() + [0] for x in tokens(pa.array(texts))] == [ids for _, ids in wanted([(0, t) for t in texts])]


@pytest.mark.parametrize("sizes", [[1], [0], [31, 32, 33], [5000, 1, 0, 70], [40000]])
def test_coder_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    blocks = [(rng.zipf(1.4, n) % 50257).astype(np.uint32) for n in sizes]
    counts = np.bincount(np.concatenate(blocks), minlength=50257) if sum(sizes) else np.zeros(50257, np.int64)
    coder = T.Coder(T.scaled(counts))
    coded = coder.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(coder.decode(coded, sizes), blocks, strict=True))


@pytest.mark.parametrize("counts", [[1, 0, 10**9, 3], [1] * 1000, [5], [0, 0]])
def test_frequencies(counts):
    freq = T.scaled(np.array(counts, np.int64))
    assert ((freq > 0) == (np.array(counts) > 0)).all() and int(freq.sum()) == (1 << T.SCALE_BITS if any(counts) else 0)


def test_files_hold_all_documents_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_TOKENS", 700)
    rows = R.documents()
    parts = T.write_tokens(T.tokenize(R.clashing(R.frame(spark, rows)), MODEL, 0), f"file://{tmp_path}/x", 50257)
    got = T.read_tokens(spark, f"file://{tmp_path}/x", parts).collect()
    assert sorted((str(r["id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((str(i), ids) for i, ids in wanted(rows))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    ids = [r["id"] for r in sorted(got, key=lambda r: r["start"]) if r["id"] is not None]
    assert ids == sorted(ids)
    raw = sum(len(x) for _, x in wanted(rows)) * 2
    assert sum(os.path.getsize(f"{tmp_path}/x/{f}") for f in os.listdir(f"{tmp_path}/x") if f.endswith(".evt")) < raw


def test_damage_is_found(spark, tmp_path):
    rows = R.documents()
    parts = T.write_tokens(T.tokenize(R.frame(spark, rows), MODEL, 0), f"file://{tmp_path}/y", 50257)
    name = next(f for f in sorted(os.listdir(f"{tmp_path}/y")) if f.endswith(".evt"))
    data = bytearray(open(f"{tmp_path}/y/{name}", "rb").read())
    data[len(data) // 3] ^= 0x55
    open(f"{tmp_path}/y/{name}", "wb").write(bytes(data))
    with pytest.raises(Exception):
        T.read_tokens(spark, f"file://{tmp_path}/y", parts).agg({"start": "sum"}).collect()


def test_empty_table(spark, tmp_path):
    parts = T.write_tokens(T.tokenize(R.frame(spark, []), MODEL, 0), f"file://{tmp_path}/z", 50257)
    assert T.read_tokens(spark, f"file://{tmp_path}/z", parts).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, []
    for i, ids in wanted([(r["doc_id"], r["text"]) for r in docs]):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in T.op5_token_files(spark, sf_dir).collect()) == want
