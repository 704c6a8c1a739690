from __future__ import annotations

import pytest

from evidra.llm import registry, token_counts
from tests.llm import rows as R

TEXTS = [
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "it's we'll 'tis I'd've", "a  b   c\n\n d \n", "\n", " ", "x ", " x", "tab\tand\r\nends\n",
    "line one.\nline two,\nline three", "a b c　d \u0085e", "naïve café 日本語 🎉🎉 ١٢٣ ½", "12345 6,789 $1.50!!", "\x1c\x1d x", "é combining", "'s 's\n's", "word" * 500,
]


def counts(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [len(x.ids) for x in got]


def expected(rows):
    return sorted(((i, len((t or "").encode()), n) for (i, t, *_), n in zip(rows, counts([r[1] for r in rows]), strict=True)), key=str)


@pytest.mark.parametrize(("hot_bytes", "filter_bits"), [(token_counts.HOT_BYTES, token_counts.FILTER_BITS), (3000, 1 << 20), (0, 1 << 15)])
def test_equals_the_library(spark, hot_bytes, filter_bits):
    import public_tokenizers as P

    rows = R.documents() + [(5000 + k, t, None, None, None) for k, t in enumerate(TEXTS)]
    got = token_counts.token_counts(R.clashing(R.frame(spark, rows)), P.path("byte_bpe_50k.json"), hot_bytes=hot_bytes, filter_bits=filter_bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_words_that_the_filter_takes_for_others_are_counted(spark):
    import public_tokenizers as P

    word = lambda k: str(k).translate({48 + d: c for d, c in enumerate("qwrtpsdfgh")})  # noqa: E731  letters alone: one pre-token
    shared = [" ".join(word(k) for k in range(at, at + 500)) for at in range(0, 10_000, 500)]
    texts = [t for s in shared for t in (s, s + " end")] + [" ".join("lone" + word(k) for k in range(at, at + 50)) for at in range(0, 1000, 50)]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    got = token_counts.token_counts(R.frame(spark, rows), P.path("byte_bpe_50k.json"), hot_bytes=0, filter_bits=1 << 15)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_a_tokenizer_with_a_normalizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, texts = P.path("word_bpe_49k.json"), [*TEXTS, "Upper CASE, and  more", ""]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    whole = Tokenizer.from_file(path)
    assert {r["id"]: r["n_tokens"] for r in got} == {k: len(whole.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_each_pre_token_is_counted_once(spark):
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        known = token_counts.lexicon(spark.createDataFrame([("a b b",), ("b, a",), ("",), ("c a a",)], "text string"), file.read()).collect()
    assert sorted((r["piece"], r["docs"], r["tokens"]) for r in known) == [(" a", 2, 1)]


def test_empty_table(spark):
    import public_tokenizers as P

    assert token_counts.token_counts(R.frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_query(spark, tmp_path):
    R.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op12_token_counts"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == expected(R.documents())
    assert {r["over_limit"] for r in got} == {True, False} and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
