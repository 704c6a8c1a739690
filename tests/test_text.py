from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidra.functions import text as tx


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in fields.items())).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x,digits,want", [(1.005, 2, 1.0), (0.125, 2, 0.13), (2.5, 0, 3.0), (0.0, 2, 0.0)])
def test_half_up(spark, x, digits, want):
    assert value(spark, tx.half_up(F.col("x"), digits), x=x) == want


@pytest.mark.parametrize("word,want", [("policies", "policy"), ("downloading", "download"), ("caches", "cach"), ("cache", "cach"), ("uses", "uses"), ("settings", "sett"), ("queue", "queu"), ("", "")])
def test_stem(spark, word, want):
    assert value(spark, tx.stem(F.col("w")), w=word) == want


@pytest.mark.parametrize("text,phrase,inside,at", [("Pause and resume downloads", "resume download", True, 2), ("presume downloads", "resume", False, None), ("a b c", "", False, None), ("", "x", False, None)])
def test_phrases(spark, text, phrase, inside, at):
    t, p = tx.stem_phrase(F.col("t")), tx.stem_phrase(F.col("p"))
    assert value(spark, tx.contains_phrase(t, p), t=text, p=phrase) is inside
    assert value(spark, tx.phrase_position(t, p), t=text, p=phrase) == at


def test_identifier_words(spark):
    assert value(spark, tx.split_identifier(F.col("n")), n="HTTPRangeDownload_manager.v2") == "http range download manager v2"


@pytest.mark.parametrize("a,b,want", [("night", "nacht", 0.25), ("aaaa", "aa", 0.5), ("same", "same", 1.0), ("a", "b", 0.0), ("", "x", 0.0)])
def test_dice_counts_multisets(spark, a, b, want):
    assert value(spark, tx.dice(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize("text,kind,want", [("", "prose", 0), ("a", "prose", 1), ("abcdefgh", "prose", 2), ("ab\ncd", "code", 2), ("x" * 10 + "\n" * 10, "prose", 8)])
def test_token_estimate(spark, text, kind, want):
    assert value(spark, tx.estimate_tokens(F.col("t"), kind), t=text) == want


@pytest.mark.parametrize("path,safe", [("src/a.py", True), ("../a", False), ("a/../../b", False), ("/etc/x", False), ("C:\\x", False), ("", False), ("a..b/c", True)])
def test_path_safety(spark, path, safe):
    assert value(spark, tx.path_is_safe(F.col("p")), p=path) is safe


@pytest.mark.parametrize("path,want", [(".env", True), ("conf/.env.local", True), (".env.example", False), ("keys/id_rsa", True), ("a/server.pem", True), ("readme.md", False)])
def test_sensitive_paths(spark, path, want):
    assert value(spark, tx.path_is_sensitive(F.col("p")), p=path) is want


@pytest.mark.parametrize("name,want", [("https://host.example/Owner/Repo.git", "owner/repo"), ("Owner/Repo", "owner/repo"), ("nope", None), ("a/b/c", None)])
def test_repository_names(spark, name, want):
    assert value(spark, tx.repository_name(F.col("n")), n=name) == want


@pytest.mark.parametrize("name,want", [("awesome-downloader", "downloader"), ("downloader-android", "downloader"), ("my.tool_lib", "tool"), ("go", ""), ("plain", "plain")])
def test_plain_names(spark, name, want):
    assert value(spark, tx.plain_name(F.col("n")), n=name) == want


def plain_digest(text):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % 2**32
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out[:6]


@pytest.mark.parametrize("path,want", [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", None), ("a/../../b", None), ("/x", None), ("C:\\x", None), ("a\\b", "a/b"), ("", None), ("./", "."), ("a/b/../../c/..", ".")])
def test_safe_paths(spark, path, want):
    assert value(spark, tx.safe_path(F.col("p")), p=path) == want


def test_names_slugs_and_keys(spark):
    long = "Deterministic lockstep multiplayer netcode with rollback"
    full = long.lower().replace(" ", "-")
    assert value(spark, tx.slug(F.col("n")), n=long) == f"deterministic-lockstep-{plain_digest(full)}" and value(spark, tx.slug(F.col("n")), n="Short one") == "short-one" and value(spark, tx.slug(F.col("n")), n="!!") == "feature"
    assert value(spark, tx.query_key(F.col("n")), n="b  A b") == "a b"
    assert value(spark, tx.major_version(F.col("n")), n="v12.3") == "12"
    assert value(spark, tx.identity_keys(F.col("n")), n="@scope/core-utils") == ["@scope"]
    assert value(spark, tx.loosely_in(F.lit("retries"), F.col("n")), n="does retry") is False
    assert value(spark, tx.loosely_in(F.lit("web socket"), F.col("n")), n="uses websocket") is True


def test_phrases_are_stemmed_as_their_words(spark):
    import itertools

    made = ["".join(p) + e for p in ("a", "ab", "abc", "abcd", "abcde", "sses", "ing1") for e in ("", "e", "s", "es", "ies", "ed", "er", "ers", "ing", "ings", "ees", "ingse", "eses", "erings")]
    rows = spark.createDataFrame([(" ".join(ws) + "! É-",) for ws in itertools.batched(made * 2, 7)], "t string")
    one = F.array_join(F.transform(tx.words(F.col("t")), tx.stem), " ")
    assert rows.filter(~tx.stem_phrase(F.col("t")).eqNullSafe(one)).count() == 0
