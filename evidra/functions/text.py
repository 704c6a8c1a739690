"""Text functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters per token by kind of content, and what a line end adds.
CHARS_PER_TOKEN = {"prose": 4.0, "code": 3.0, "json": 3.2, "identifier": 2.6}
TOKENS_PER_LINE_END = 0.3


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds the scaled double half up: 1.005 to two digits is 1.00, as 100.49999... rounds down."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def weighted_half_up(weighted_sum: Column, weight_sum: Column) -> Column:
    """round(sum / weights) in whole numbers, so no order of summing changes it."""
    return F.floor((2 * weighted_sum + weight_sum) / (2 * weight_sum)).cast("long")


def clamp01(x: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2)


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(normalise(text), " "), lambda w: w != "")


def stem(word: Column) -> Column:
    """ies becomes y; else the longest plain ending that leaves four letters goes; a final e goes from five letters on."""
    y = word.rlike("^.{2,}ies$")
    short = F.regexp_replace(word, "^(.{4,}?)(?:ings|ing|ers|er|ed|es|s)$", "$1")
    base = F.when(y, F.regexp_replace(word, "ies$", "y")).otherwise(short)
    return F.when(F.length(base) >= 5, F.regexp_replace(base, "e$", "")).otherwise(base)


def stem_phrase(text: Column) -> Column:
    """The stem of each word (see stem), with a space between. Endings go in the whole text at once: in texts of normalise a word is a run of letters and digits."""
    y = F.regexp_replace(normalise(text), r"(?<=[a-z0-9]{2})ies\b", "y")  # no further ending fits what ends in y
    short = F.regexp_replace(y, r"(?<=[a-z0-9]{4})(?:ings|ing|ers|er|ed|es|s)\b", "")
    return F.regexp_replace(short, r"(?<=[a-z0-9]{4})e\b", "")


def contains_phrase(stemmed_text: Column, stemmed_phrase: Column) -> Column:
    """Whole stemmed words, next to one another; an empty phrase is in no text."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (F.length(stemmed_phrase) > 0) & F.contains(padded(stemmed_text), padded(stemmed_phrase))


def phrase_position(stemmed_text: Column, stemmed_phrase: Column) -> Column:
    """Number of words before the first place of the phrase, or null."""
    at = F.position(F.concat(F.lit(" "), stemmed_phrase, F.lit(" ")), F.concat(F.lit(" "), stemmed_text, F.lit(" ")))
    before = F.substring(F.concat(F.lit(" "), stemmed_text), F.lit(1), at)
    return F.when((at > 0) & (F.length(stemmed_phrase) > 0), F.length(before) - F.length(F.replace(before, F.lit(" "))) - 1)


def split_identifier(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, r"[\s_.\-/]+", " ")))


def content_terms(text: Column, stop: tuple[str, ...], least: int = 3, most: int = 6) -> Column:
    kept = F.filter(words(text), lambda w: (F.length(w) >= least) & ~w.isin(*stop))
    return F.slice(F.array_distinct(kept), 1, most)


def loosely_in(term: Column, body: Column, squashed: Column | None = None) -> Column:
    """Term in body: as it is, without separators from four letters on, or without a plural s."""
    squash = lambda c: F.regexp_replace(c, r"[\s_.\-]+", "")
    return (
        F.contains(body, term)
        | ((F.length(squash(term)) >= 4) & F.contains(squash(body) if squashed is None else squashed, squash(term)))
        | (F.endswith(term, F.lit("s")) & (F.length(term) > 3) & F.contains(body, F.regexp_replace(term, "s$", "")))
    )


def coverage(found: Column, wanted: Column) -> Column:
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(found, wanted)) / F.size(wanted)).otherwise(0.0)


# What may stand before and after a name.
PREFIXES = ("awesome", "simple", "easy", "my", "the", "go", "py", "js", "ts", "kt")
SUFFIXES = ("lib", "library", "sdk", "kit", "android", "ios", "js", "ts", "kt", "py", "go", "java", "swift", "demo", "example", "sample", "clone", "fork", "mirror")


def plain_name(name: Column) -> Column:
    """A name without separators, one prefix and one suffix; it may be empty."""
    bare = F.regexp_replace(F.lower(name), "[-_.]", "")
    return F.regexp_replace(F.regexp_replace(bare, f"^(?:{'|'.join(PREFIXES)})", ""), f"(?:{'|'.join(SUFFIXES)})$", "")


def bigrams(name: Column) -> Column:
    return F.when(F.length(name) >= 2, F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))


def dice(a: Column, b: Column) -> Column:
    """2 * shared / all, over the multisets of two-letter pieces."""
    left, right = bigrams(a), bigrams(b)
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(left), F.lit(0), lambda n, x: n + F.least(times(left, x), times(right, x)))
    both = F.size(left) + F.size(right)
    return F.when(a == b, 1.0).when(both > 0, 2.0 * shared / both).otherwise(0.0)


def topic(label: Column) -> Column:
    return F.regexp_replace(normalise(label), " ", "-")


def topic_or_null(label: Column) -> Column:
    """A topic of 3 to 35 characters, or null."""
    dashed = topic(label)
    return F.when(F.length(dashed).between(3, 35), dashed)


def capability_label(feature: Column, label: Column, capability: Column) -> Column:
    """Whether a feature's text is only the name of a capability."""
    low = F.lower(F.trim(feature))
    return (low == F.lower(label)) | (low == F.replace(F.lower(capability), F.lit("-"), F.lit(" ")))


# Words that a query leaves out of a requirement.
QUERY_STOP = ("the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "with", "is", "are", "be", "it", "its", "when", "where", "that", "this", "supports", "support", "handles", "handle", "provides", "provide", "must", "should")


def compact_requirement(text: Column) -> Column:
    """The first four words of three letters or more that say something; null if there is none."""
    kept = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*QUERY_STOP))
    return F.nullif(F.array_join(F.slice(kept, 1, 4), " "), F.lit(""))


def digest(text: Column) -> Column:
    """32-bit FNV-1a over the characters, in base 36, six digits at most."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619, F.lit(1 << 32))
    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)
    return F.left(F.lower(F.conv(value.cast("string"), 10, 36)), F.lit(6))


def slug(text: Column, most: int = 40) -> Column:
    """A stable id: the dashed words, and past most characters those that fit and a digest of all."""
    full = topic(text)
    cut = F.left(full, F.lit(most - 8))
    head = F.regexp_replace(F.when(F.contains(cut, F.lit("-")), F.regexp_extract(cut, "^(.*)-", 1)).otherwise(cut), "-+$", "")
    return F.when(full == "", "feature").when(F.length(full) <= most, full).otherwise(F.concat(F.when(head == "", cut).otherwise(head), F.lit("-"), digest(full)))


def dependency_stem(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "[/:]"), -1))


def major_version(version: Column) -> Column:
    return F.nullif(F.regexp_extract(version, r"(\d+)", 1), F.lit(""))


def dependency_name(name: Column) -> Column:
    """The name that dependencies are compared by: after the last colon, or without a scope."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit(":")), F.element_at(F.split(low, ":"), -1)).otherwise(F.regexp_replace(low, "^@[^/]+/", ""))


# Keys of libraries that are made to be used together.
COMPLEMENTARY = {
    "slf4j": ("logback", "log4j", "ch.qos.logback", "org.apache.logging.log4j"), "logback": ("slf4j", "org.slf4j"), "log4j": ("slf4j", "org.slf4j"),
    "org.slf4j": ("logback", "log4j", "ch.qos.logback"), "ch.qos.logback": ("slf4j", "org.slf4j"),
}


def identity_keys(name: Column, partners: bool = True) -> Column:
    """Keys two dependencies share if they belong to one family; with partners also those of what each is made to be used with."""
    low = F.lower(F.trim(name))
    none = F.lit(None).cast("string")
    tail = F.split(F.substring(low, F.lit(6), F.length(low)), "[.]")
    catalog = F.array(F.element_at(tail, 1), F.when(F.size(tail) > 1, F.array_join(tail, ".")))
    parts = F.split(low, ":")
    group, artifact = F.element_at(parts, 1), F.get(parts, F.lit(1))
    deep, stem_ = F.split(group, "[.]"), F.element_at(F.split(artifact, "[-_]"), 1)
    coordinates = F.array(group, F.when(F.size(deep) > 2, F.array_join(F.slice(deep, 1, 3), ".")), F.when(F.length(stem_) >= 3, stem_))
    word = F.element_at(F.split(low, "[-_]"), 1)
    other = F.array(F.when(word == "", low).otherwise(word), none)
    keys = F.when(low.startswith("libs."), catalog).when(F.contains(low, F.lit(":")), coordinates).when(low.startswith("@"), F.array(F.element_at(F.split(low, "/"), 1), none)).otherwise(other)
    keys = F.array_distinct(F.array_compact(keys))
    if not partners:
        return keys
    also = F.flatten(F.transform(keys, lambda k: F.coalesce(*[F.when(k == a, F.array(*map(F.lit, bs))) for a, bs in COMPLEMENTARY.items()], F.expr("cast(array() as array<string>)"))))
    return F.array_distinct(F.concat(keys, also))


def estimate_tokens(text: Column, kind: str = "prose") -> Column:
    """0 for nothing, else at least 1: characters by kind, and a part of a token for each line end."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    raw = F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN[kind]) + ends * F.lit(TOKENS_PER_LINE_END))
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), raw)).otherwise(0).cast("long")


def estimate_json_tokens(value: Column) -> Column:
    return estimate_tokens(F.to_json(value), "json")


def excerpt(text: Column, at: Column, size: Column, around: int = 20, most: int = 120) -> Column:
    start = F.greatest(F.lit(1), at - around)
    piece = F.substring(text, start, at - start + size + around)
    return F.left(F.trim(F.regexp_replace(piece, r"\s+", " ")), F.lit(most))


def cache_key(namespace: Column, *parts: Column) -> Column:
    return F.concat_ws(":", namespace, F.sha2(F.concat_ws("\x1f", *parts), 256))


def query_key(query: Column) -> Column:
    """The same for any order and repetition of terms."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != ""))), " ")


def path_is_safe(path: Column) -> Column:
    return path.isNotNull() & ~path.rlike(r"^/|^[A-Za-z]:|(?:^|[/\\])\.\.(?:[/\\]|$)|\x00") & (F.length(path) > 0)


def safe_path(path: Column) -> Column:
    """A path inside a repository in its plain form (no . or empty parts, .. resolved, forward slashes), or null: empty, absolute, with a drive or a zero byte, or leading out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))

    def step(out: Column, p: Column) -> Column:
        back = (p == "..") & (F.size(out) > 0) & (F.coalesce(F.get(out, F.size(out) - 1), F.lit("..")) != "..")
        return F.when(back, F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))

    plain = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    bad = path.isNull() | (path == "") | F.contains(path, F.lit("\x00")) | path.rlike(r"^[/\\]|^[A-Za-z]:[/\\]")
    return F.when(~bad & ~plain.rlike(r"^\.\.(/|$)"), F.when(plain == "", ".").otherwise(plain))


def valid_sha(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{7,40}$")


def valid_ref(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,200}$") & ~F.contains(text, F.lit("..")) & ~text.endswith("/")


def looks_like_test(name: Column) -> Column:
    return name.rlike("(?i)^(test|it|should|when|given)|(test|spec)$")


def describe_test(name: Column) -> Column:
    """A test's name as a sentence."""
    clean = F.trim(F.regexp_replace(split_identifier(name), r"^(test|it|should|when|given)\s+", ""))
    return F.when(clean != "", F.concat(F.upper(F.left(clean, F.lit(1))), F.substring(clean, F.lit(2), F.length(clean)))).otherwise(name)


def key_parts(key: Column) -> Column:
    """struct(namespace, version, subject) of a cache key, or null."""
    return F.when(key.rlike("^[^:]*:[^:]*:"), F.struct(F.substring_index(key, ":", 1).alias("namespace"), F.element_at(F.split(key, ":"), 2).alias("version"), F.regexp_extract(key, "(?s)^[^:]*:[^:]*:(.*)$", 1).alias("subject")))


def repository_key(namespace: Column, name: Column, commit: Column, ref: Column, version: str = "v1") -> Column:
    """A key pinned to a commit, else to a ref, else marked as unpinned."""
    pin = F.when(commit.isNotNull(), F.concat(F.lit("@"), commit)).when(ref.isNotNull(), F.concat(F.lit("@ref:"), ref)).otherwise("@unpinned")
    return F.concat(namespace, F.lit(f":{version}:"), F.lower(name), pin)


def path_is_sensitive(path: Column) -> Column:
    name = F.element_at(F.split(F.lower(path), "/"), -1)
    return name.rlike(r"^\.env(\..*)?$|^id_(rsa|dsa|ecdsa|ed25519)$|\.(pem|key|p12|pfx|keystore|jks)$|^\.(npmrc|netrc|pgpass)$|^credentials(\.json)?$") & ~name.rlike(r"\.(example|sample|template)$")


def repository_name(text: Column) -> Column:
    """owner/name from a name or an address, lower-cased; null if it is neither."""
    got = F.regexp_extract(text, r"^(?:https?://[^/]+/|git@[^:]+:)?([A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]{1,100}?)(?:\.git)?/?$", 1)
    return F.lower(F.nullif(got, F.lit("")))
