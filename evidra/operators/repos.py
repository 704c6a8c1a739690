"""Reading repositories that are tables: searches with qualifiers, point look-ups, releases, trees, files, code indexes, metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.text import path_is_sensitive, safe_path

_QUALIFIER = re.compile(r"^(-?)([a-z]+):(>=|<=|>|<)?(.+)$")


def qualified(query: str, columns: dict[str, str], text: Column) -> Column:
    """The filter of a search: plain terms are all in text; name:value and name:>=value compare the column that columns has for name.

    Numbers compare as numbers, ISO days as days, true and false as booleans, other values without
    case; an array column holds the value. A name without a column matches nothing. The filter is
    made of plain comparisons, so that the scan can take it.
    """
    out = F.lit(True)
    for term in query.split():
        found = _QUALIFIER.match(term)
        if not found:
            out = out & F.contains(text, F.lit(term.lower()))
            continue
        _, name, sign, value = found.groups()
        if name not in columns:
            return F.lit(False)
        column = F.col(columns[name])
        if value in ("true", "false"):
            test = column == F.lit(value == "true")
        elif re.fullmatch(r"-?\d+(\.\d+)?", value):
            test = _compared(column, sign, F.lit(float(value)))
        elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            test = _compared(column.cast("date"), sign, F.lit(value).cast("date"))
        else:
            test = F.lower(column) == value.lower()
        out = out & (~test if found[1] else test)
    return out


def _compared(column: Column, sign: str | None, value: Column) -> Column:
    return {None: column == value, ">=": column >= value, "<=": column <= value, ">": column > value, "<": column < value}[sign]


def search_code(files: DataFrame, pattern: str, content: str, path: str, around: int = 30, filename: str | None = None, extension: str | None = None, most: int = 3) -> DataFrame:
    """files whose content has the text (without case), with fragments: the first hits and what is around them, on one line each."""
    rows = files.filter(F.contains(F.lower(content), F.lit(pattern.lower())))
    if filename:
        rows = rows.filter(F.element_at(F.split(path, "/"), -1) == filename)
    if extension:
        rows = rows.filter(F.lower(path).endswith("." + extension.lower()))
    hit = rf"(?is).{{0,{around}}}{re.escape(pattern)}.{{0,{around}}}"
    got = F.slice(F.regexp_extract_all(content, F.lit(hit), F.lit(0)), 1, most)
    return rows.withColumn("fragments", F.transform(got, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def looked_up(keys: DataFrame, key: str, entries: DataFrame, now: Column) -> DataFrame:
    """keys with the value of the live entry of each, and hit: an entry that expires now or before is a miss, one without a time stays."""
    live = entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.col("key").alias("_k"), "value")
    return keys.join(live, F.col(key) == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull()).drop("_k")


def language_bytes(files: DataFrame, entity: str, language: str, size: Column) -> DataFrame:
    """(entity, language, bytes, share): bytes of each language and their share in hundredths, half up."""
    got = files.groupBy(entity, language).agg(F.sum(size).cast("long").alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy(entity))
    share = F.when(whole > 0, F.floor((200 * F.col("bytes") + whole) / (2 * whole))).otherwise(0)
    return got.select(entity, language, "bytes", share.cast("long").alias("share"))


def releases(entities: DataFrame, entity: str, released: DataFrame, tagged: DataFrame, most: int = 30) -> DataFrame:
    """(entity, count, latest, source): releases if there are any, else tags, else none; counts stop at a page of most."""
    one = lambda rows, name: rows.groupBy(F.col(entity).alias(f"e_{name}")).agg(F.count("*").alias(f"n_{name}"), F.max_by("name", F.struct("at", "name")).alias(f"l_{name}"))
    r, t = one(released, "r"), one(tagged, "t")
    rows = entities.select(entity).distinct().join(r, F.col(entity) == F.col("e_r"), "left").join(t, F.col(entity) == F.col("e_t"), "left")
    first, second = F.col("n_r").isNotNull(), F.col("n_t").isNotNull()
    source = F.when(first, "releases").when(second, "tags").otherwise("none")
    return rows.select(entity, F.least(F.lit(most), F.coalesce("n_r", "n_t", F.lit(0))).cast("long").alias("count"), F.when(first, F.col("l_r")).otherwise(F.col("l_t")).alias("latest"), source.alias("source"))


def contributors(commits: DataFrame, entity: str, author: str) -> DataFrame:
    return commits.groupBy(entity).agg(F.countDistinct(author).alias("contributors"))


def tree(files: DataFrame, path: str) -> DataFrame:
    """files with their paths in plain form; unsafe ones are left out."""
    return files.withColumn(path, safe_path(F.col(path))).filter(F.col(path).isNotNull())


def admission(path: Column) -> Column:
    """Why a file is not read, or null."""
    plain = safe_path(path)
    return F.when(plain.isNull(), "path traversal or malformed path rejected").when(path_is_sensitive(plain), "sensitive file type; contents are not retrieved")


def file_text(path: Column, content: Column) -> Column:
    """The text of a file's bytes; null if it isn't admitted or has a zero byte among its first 8192."""
    binary = F.contains(F.hex(F.substring(content, 1, 8192)), F.lit("00")) & (F.position(F.unhex(F.lit("00")), F.substring(content, 1, 8192)) > 0)
    return F.when(admission(path).isNull() & ~binary, F.decode(content, "UTF-8"))


def well_known(files: DataFrame, entity: str, path: str, content: str, most: int = 20_000) -> DataFrame:
    """(entity, readme, licence): the first files of those names at the top, the licence's first most characters."""
    name = F.lower(path)
    first = lambda p: F.min_by(F.when(name.rlike(p), F.col(content)), F.when(name.rlike(p), F.col(path)))
    return files.groupBy(entity).agg(first(r"^readme(\.[a-z]+)?$").alias("readme"), F.left(first(r"^(licen[cs]e|copying)(\.[a-z]+)?$"), F.lit(most)).alias("licence"))


def field(text: Column, most: int) -> Column:
    """Untrusted text as one line without control characters, cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}-\x{2064}\x{feff}]", " "), r" +", " ")), F.lit(most))


def metadata(raw: DataFrame) -> DataFrame:
    """Rows of a source's own shape as repositories: names that aren't owner/name go, texts are narrowed, NOASSERTION is no licence."""
    name = F.col("full_name")
    valid = name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*$") & (F.length(name) <= 200) & ~F.contains(name, F.lit(".."))
    topics = F.filter(F.transform(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 25), lambda t: field(t, 50)), lambda t: t != "")
    return raw.filter(valid).select(
        "full_name", field(F.col("description"), 400).alias("description"), topics.alias("topics"), F.nullif(field(F.col("homepage"), 200), F.lit("")).alias("homepage"),
        F.coalesce("stargazers_count", F.lit(0)).cast("long").alias("stars"), F.coalesce("fork", F.lit(False)).alias("is_fork"), F.nullif("spdx_id", F.lit("NOASSERTION")).alias("license_spdx"),
    )


def admitted_to_index(indexed: Column, size_kb: Column, available: Column, most: int = 250_000) -> Column:
    """Why a repository isn't sent to the code index, or null."""
    return F.when(~available, "code index not available").when(indexed, F.lit(None).cast("string")).when(size_kb > most, "too large to index")


def outline(symbols: DataFrame, file: str, kind: str) -> DataFrame:
    """(file, kind, n): what each file declares."""
    return symbols.groupBy(file, kind).agg(F.count("*").alias("n"))


def symbol_search(symbols: DataFrame, name: str, text: str, most: int, key: str) -> DataFrame:
    """The symbols whose names hold the text, those that are or begin with it first."""
    low = F.lower(name)
    rank = F.when(low == text.lower(), 0).when(low.startswith(text.lower()), 1).otherwise(2)
    return symbols.filter(F.contains(low, F.lit(text.lower()))).withColumn("rank", rank).orderBy("rank", low, key).limit(most)


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, relation): callees first, then callers, then related ones; an other that comes twice keeps the first relation."""
    sides = [("callee", "call", "src", "dst"), ("caller", "call", "dst", "src"), ("related", "related", "src", "dst")]
    parts = None
    for k, (relation, kind, a, b) in enumerate(sides):
        part = edges.filter(F.col("kind") == kind).select(F.col(a).alias("node"), F.col(b).alias("other"), F.struct(F.lit(k).alias("ord"), F.lit(relation).alias("relation")).alias("r"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("node", "other").agg(F.min("r").alias("r")).select("node", "other", "r.relation")


def payload_kind(payload: Column) -> Column:
    """json, table or text, by how a payload begins."""
    start = F.ltrim(payload)
    return F.when(start.rlike(r"^[\[{]") & F.try_parse_json(payload).isNotNull(), "json").when(start.rlike(r"^#?MUNCH\b"), "table").otherwise("text")


def first_of(value: Column, names: tuple[str, ...]) -> Column:
    """The first of several fields of a JSON text that is there."""
    return F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in names])


# Directories that a walk doesn't enter.
IGNORED = ("node_modules", ".git", "build", "dist", "target", ".gradle", ".idea", "Pods", "vendor", ".venv", "__pycache__")


def walked(files: DataFrame, root: str, path: str, depth: int = 4, most: int = 4000) -> DataFrame:
    """The files of each root that a walk would list: not deep, not in ignored directories, not sensitive, the first most by path."""
    parts = F.split(path, "/")
    rows = files.filter((F.size(parts) <= depth + 1) & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED))) & admission(F.col(path)).isNull())
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(root).orderBy(path))).filter(F.col("_n") <= most).drop("_n")


# Facets of an answer and the columns of each.
FACETS = {"metadata": ("stars", "language"), "licence": ("spdx",), "quality": ("has_tests", "has_ci"), "score": ("total", "confidence")}


def faceted(rows: DataFrame, key: str, include: list[str]) -> DataFrame:
    """key and the columns of the facets asked for, in their order; none asked for gives all."""
    wanted = [c for f in FACETS if f in include or not include for c in FACETS[f] if c in rows.columns]
    return rows.select(key, *wanted)


# Namespaces whose entries never expire.
IMMUTABLE = ("analysis", "symbols", "license", "deps", "tests", "fingerprint", "content")


def immutable_namespace(namespace: Column) -> Column:
    return namespace.isin(*IMMUTABLE)


def commit_pinned(key: Column) -> Column:
    return key.rlike(r"@[0-9a-f]{7,40}(?::|$)")


def guarded(rows: DataFrame, key: str, stages: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(values, degradations): stages is name -> (value, why it failed or null). A stage that failed has a null value and a row with its reason."""
    values = rows.select(key, *[F.when(why.isNull(), value).alias(n) for n, (value, why) in stages.items()])
    made = F.array_compact(F.array(*[F.when(why.isNotNull(), F.struct(F.lit(n).alias("stage"), why.alias("reason"))) for n, (_, why) in stages.items()]))
    return values, rows.select(key, F.explode(made).alias("d")).select(key, "d.stage", "d.reason")


def merged_symbols(symbols: DataFrame, key: str, relevance: str) -> DataFrame:
    """One row of each symbol, the one with most relevance (none counts as 0), whatever the batch it came in."""
    rows = symbols.withColumn("_r", F.struct(F.coalesce(relevance, F.lit(0.0)).alias("r"), F.struct(*[c for c in symbols.columns if c != key]).alias("s")))
    return rows.groupBy(key).agg(F.max("_r").alias("_r")).select(key, "_r.s.*")


def languages(choices: DataFrame, entity: str, language: str, target: str) -> DataFrame:
    """(language, n_entities, differs): entities of each language; all but the target's are for reference unless ported."""
    got = choices.filter(F.col(language).isNotNull()).groupBy(language).agg(F.countDistinct(entity).alias("n_entities"))
    return got.withColumn("differs", F.lower(language) != target.lower())


def hydrated(pool: DataFrame, found: DataFrame, entity: str, size: int) -> DataFrame:
    """(entity, known, place): the pool, tagged where the knowledge base has the entity; what it has besides follows, by strength, while the pool has room."""
    have = pool.select(entity, F.lit(0).alias("late"), F.col("place").cast("double").alias("o")).join(found.select(F.col(entity).alias("_e"), "strength"), F.col(entity) == F.col("_e"), "left")
    extra = found.join(pool.select(entity), entity, "left_anti").select(entity, F.lit(1).alias("late"), (-F.col("strength")).cast("double").alias("o"), F.col(entity).alias("_e"))
    rows = have.select(entity, "late", "o", F.col("_e").isNotNull().alias("known")).union(extra.select(entity, "late", "o", F.lit(True)))
    top = rows.orderBy("late", "o", entity).limit(size)
    return top.select(entity, "known", F.row_number().over(Window.orderBy("late", "o", entity)).cast("long").alias("place"))


def missing(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """wanted without what is present."""
    return wanted.join(present, on, "left_anti")
