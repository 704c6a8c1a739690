"""From what a requirement says to tasks: capabilities, units, what is left over, strategies, queries, budgets, order.

The vocabulary is a table that callers pass: (id, label, reuse, foundational, triggers, implies,
narrows, checklist, search_terms, topics), arrays of strings from triggers on. It has the size of
a word list that people keep; its size is looked at before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.text import compact_requirement, contains_phrase, normalise, stem_phrase, topic_or_null, words
from evidra.operators.lineage import cut
from evidra.operators.matching import closure, phrase_matches, primary, small, unit_priority


def exploded(vocabulary: DataFrame, column: str, name: str) -> DataFrame:
    return vocabulary.select("id", F.explode(column).alias(name))


# Where a requirement is cut into fragments, and what a fragment may begin with.
FRAGMENTS = r"(?i)[,;\n·•]|\band\b|\bwith\b|\bplus\b"
LEADING = r"^((build|create|add|implement|support|need|want|it needs|a|an|the)\s+)"


def unrecognised(requirements: DataFrame, key: str, text: str, units: DataFrame, vocabulary: DataFrame, most: int = 8) -> DataFrame:
    """(key, fragment), from units (_key, unit): pieces of a requirement of 4 to 60 plain characters that no trigger is in and less than half of whose stems the found capabilities' words cover; the first most."""
    fragments = requirements.select(F.col(key).alias("_key"), F.posexplode(F.split(F.col(text), FRAGMENTS)).alias("at", "raw"))
    clean = F.trim(F.regexp_replace(F.lower(F.trim("raw")), LEADING, ""))
    fragments = fragments.select("_key", "at", clean.alias("fragment")).filter(F.length("fragment").between(4, 60) & F.col("fragment").rlike("^[a-z][a-z0-9 /_-]*$"))
    fragments = fragments.groupBy("_key", "fragment").agg(F.min("at").alias("at"))
    known = phrase_matches(fragments.select("fragment").distinct(), "fragment", "fragment", exploded(vocabulary, "triggers", "trigger").withColumnRenamed("id", "capability"))
    fragments = fragments.join(known.select("fragment").distinct(), "fragment", "left_anti")
    said = vocabulary.select(F.col("id").alias("unit"), F.explode(F.concat(F.array("label"), "checklist", "search_terms", "triggers")).alias("t")).select("unit", F.explode(F.split(stem_phrase(F.col("t")), " ")).alias("stem")).distinct()
    covered = units.join(small(said), "unit").select("_key", "stem").distinct()
    stems = fragments.select("_key", "fragment", "at", F.explode_outer(F.filter(F.split(stem_phrase(F.col("fragment")), " "), lambda w: F.length(w) >= 3)).alias("stem"))
    got = stems.join(covered.withColumn("in", F.lit(1)), ["_key", "stem"], "left").groupBy("_key", "fragment", "at").agg(F.count("stem").alias("n"), F.count("in").alias("known"))
    got = got.filter((F.col("n") == 0) | (2 * F.col("known") < F.col("n")))
    return got.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("at", "fragment"))).filter(F.col("_n") <= most).select(F.col("_key").alias(key), "fragment")


def decompose(requirements: DataFrame, key: str, text: str, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, primary, unrecognised) of each requirement.

    units (key, unit, name, implied, hits, priority, place): capabilities whose triggers are in the
    text, and all that these imply, however far; the most urgent first, then by name. primary
    (key, capability) is what the text is mainly about, unrecognised (key, fragment) what nothing covers.
    """
    units, main = recognised(requirements, key, text, vocabulary)
    return units, main, unrecognised(requirements, key, text, units.select(F.col(key).alias("_key"), "unit"), vocabulary)


def recognised(requirements: DataFrame, key: str, text: str, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, primary) of decompose. Texts are read and stemmed once; all else is made from what was found in them."""
    triggers = exploded(vocabulary, "triggers", "trigger").withColumnRenamed("id", "capability")
    found = cut(phrase_matches(requirements, key, text, triggers, head=True))
    reach = closure(exploded(vocabulary, "implies", "needs"), "id", "needs").select(F.col("origin").alias("capability"), "reached")
    implied = found.select(key, "capability").join(small(reach), "capability").select(key, F.col("reached").alias("capability")).distinct().join(found.select(key, "capability"), [key, "capability"], "left_anti")
    units = found.select(key, F.col("capability").alias("unit"), F.lit(False).alias("implied"), "hits").union(implied.select(key, "capability", F.lit(True), F.lit(0).cast("long")))
    facts = vocabulary.select(F.col("id").alias("unit"), F.col("label").alias("name"), "reuse", "foundational")
    units = units.join(small(facts), "unit").withColumn("priority", unit_priority(F.col("foundational"), F.col("reuse"), F.col("implied"), F.col("hits")).cast("long"))
    units = units.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), "name")).cast("long")).select(key, "unit", "name", "implied", "hits", "priority", "place")
    narrows = exploded(vocabulary, "narrows", "wide").select(F.col("id").alias("narrow"), "wide")
    return units, primary(found, key, narrows)


# Capabilities that libraries solve, and those whose approach is to be studied.
LIBRARY_SHAPED = ("http-client", "persistence", "image-loading", "media-playback", "oauth", "secure-storage", "payments", "search-indexing", "validation", "i18n", "file-parsing")
ALGORITHM_SHAPED = ("realtime-collab", "offline-sync", "search-indexing")
#: Weight of a strategy, in tenths.
WEIGHT = {"reuse-library": 13, "reuse-pattern": 11, "study-reference": 8}


def strategy(capability: Column, reuse: Column, library: tuple[str, ...] = LIBRARY_SHAPED, algorithm: tuple[str, ...] = ALGORITHM_SHAPED) -> Column:
    return F.when(reuse.isNull() | (reuse == "low"), "build-from-scratch").when(capability.isin(*library), "reuse-library").when(capability.isin(*algorithm), "study-reference").otherwise("reuse-pattern")


def rationale(name: Column, chosen: Column) -> Column:
    return (
        F.when(chosen == "reuse-library", F.concat(name, F.lit(": libraries solve this well; depend on one")))
        .when(chosen == "study-reference", F.concat(name, F.lit(": subtle and tied to its host; study a proven one")))
        .when(chosen == "reuse-pattern", F.concat(name, F.lit(": many follow one pattern; adapt it")))
        .otherwise(F.concat(name, F.lit(": too specific for another's code to fit; build it")))
    )


def plan(units: DataFrame, key: str, vocabulary: DataFrame, total: int | None = None, library: tuple[str, ...] = LIBRARY_SHAPED, algorithm: tuple[str, ...] = ALGORITHM_SHAPED) -> DataFrame:
    """(key, unit, name, strategy, priority, share, queries): what is worth a search, with its share of the budget in hundredths and its number of queries (one at least; total, or three a task, by weight, half up).

    Units to build from scratch have strategy build-from-scratch and no share. Weights are
    priority times the strategy's weight, at least 50 thousandths.
    """
    rows = units.join(small(vocabulary.select(F.col("id").alias("unit"), "reuse")), "unit", "left").withColumn("strategy", strategy(F.col("unit"), F.col("reuse"), library, algorithm))
    weight = F.greatest(F.lit(50), F.col("priority") * F.coalesce(*[F.when(F.col("strategy") == s, w) for s, w in WEIGHT.items()]))
    rows = rows.withColumn("w", F.when(F.col("strategy") != "build-from-scratch", weight).cast("long"))
    all_ = Window.partitionBy(key)
    rows = rows.withColumn("sum", F.sum("w").over(all_)).withColumn("budget", F.lit(total).cast("long") if total else 3 * F.count("w").over(all_))
    share = F.floor((200 * F.col("w") + F.col("sum")) / (2 * F.col("sum"))).cast("long")
    queries = F.greatest(F.lit(1), F.floor((2 * F.col("w") * F.col("budget") + F.col("sum")) / (2 * F.col("sum")))).cast("long")
    return rows.select(key, "unit", "name", "strategy", "priority", share.alias("share"), F.when(F.col("w").isNotNull(), queries).alias("queries"))


# How much a shape of query tells, in hundredths, in the order in which shapes take turns.
SHAPES = {"vendor-sdk": 90, "stack-idiom": 95, "domain-term": 80, "topic": 70, "requirement": 60, "generic": 50}


def queries(tasks: DataFrame, key: str, vocabulary: DataFrame, idioms: DataFrame, language: str | None, limit: str) -> DataFrame:
    """(key, place, shape, query): the queries of each task, a shape at a time, the sharpest of each first, as many as the column limit says.

    tasks (key, id, feature, requirements, must_mention, limit); idioms (id, idiom, ord) of the
    stack. A query that comes again, without case, is left out in its turn; six turns at most.
    """
    known = vocabulary.select(F.col("id").alias("_id"), "label", "search_terms", "topics")
    own = idioms.groupBy(F.col("id").alias("_i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "idiom"))), lambda x: x["idiom"]).alias("idioms"))
    rows = tasks.join(small(known), F.col("id") == F.col("_id"), "left").join(small(own), F.col("id") == F.col("_i"), "left")
    none = F.expr("cast(array() as array<string>)")
    tongue = lambda q: F.concat_ws(" ", q, F.lit(language))
    made_topic = F.array_compact(F.array(topic_or_null(F.coalesce("_id", "feature"))))
    labelled = (F.lower(F.trim("feature")) == F.lower("label")) | (F.lower(F.trim("feature")) == F.replace(F.lower("_id"), F.lit("-"), F.lit(" ")))
    vendors = F.filter(F.transform(F.slice(F.coalesce("must_mention", none), 1, 2), lambda v: F.trim(v)), lambda v: v != "")
    made = {
        "vendor-sdk": F.concat(vendors, F.transform(vendors, lambda v: F.concat(v, F.lit(" sdk")))),
        "stack-idiom": F.slice(F.coalesce("idioms", none), 1, 3),
        "domain-term": F.slice(F.coalesce("search_terms", none), 1, 4),
        "topic": F.transform(F.slice(F.when(F.size(F.coalesce("topics", none)) > 0, F.col("topics")).otherwise(made_topic), 1, 2), lambda t: F.concat(F.lit("topic:"), t)),
        "requirement": F.transform(F.array_compact(F.transform(F.slice(F.coalesce("requirements", none), 1, 2), compact_requirement)), tongue),
        "generic": F.when(F.coalesce(labelled, F.lit(False)), none).otherwise(F.array(tongue(F.lower("feature")))),
    }
    shaped = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("shape"), F.filter(q, lambda x: F.trim(x) != "").alias("queries")) for k, (s, q) in enumerate(made.items())])
    out = rows.select(key, limit, F.explode(shaped).alias("s")).select(key, limit, "s.ord", "s.shape", F.posexplode("s.queries").alias("turn", "query")).filter("turn < 6")
    first = Window.partitionBy(key, F.lower(F.trim("query"))).orderBy("turn", "ord")
    out = out.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("turn", "ord")).cast("long"))
    return out.filter(F.col("place") <= F.greatest(F.lit(1), F.col(limit))).select(key, "place", "shape", "query")


def stack_idioms(texts: DataFrame, key: str, text: str, markers: DataFrame) -> DataFrame:
    """(key, stack, hits): the stack most of whose markers are in a text, the first listed among equals. markers (stack, ord, marker)."""
    rows = texts.select(key, F.lower(text).alias("t")).join(small(markers), F.contains(F.col("t"), F.lower("marker")))
    hits = rows.groupBy(key, "stack", "ord").agg(F.countDistinct("marker").alias("hits"))
    return hits.groupBy(key).agg(F.max(F.struct("hits", (-F.col("ord")).alias("o"), "stack")).alias("m")).select(key, "m.stack", "m.hits")


# Words without content for the match of a feature with a capability; names of stacks and the like, which are no products.
PHRASE_STOP = ("and", "or", "the", "a", "an", "with", "for", "to", "of", "in", "on", "at", "by", "using", "via", "support", "supports", "handling", "based")
NOT_A_PRODUCT = (
    "android", "ios", "web", "kotlin", "java", "swift", "python", "javascript", "typescript", "http", "https", "rest", "api", "sdk", "url", "json", "xml", "csv", "pdf", "sql", "ui",
    "oauth", "jwt", "rtl", "e2ee", "aes", "rsa", "tls", "ssl", "crud", "mvi", "mvvm", "build", "create", "add", "the", "and", "with", "for", "full", "text",
)


def content_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: (F.length(w) >= 3) & ~w.isin(*PHRASE_STOP))


def best_capability(features: DataFrame, key: str, name: str, vocabulary: DataFrame, least: float = 0.4) -> DataFrame:
    """(key, capability, coverage): the capability whose triggers and label explain most of a feature's words, at least that share; of several as good (within a hundredth) one that narrows another of them, else the one with most words."""
    own = vocabulary.select(F.col("id").alias("capability"), F.explode(F.concat("triggers", F.array("label"))).alias("t")).select("capability", F.explode(content_words(F.col("t"))).alias("w")).distinct()
    tokens = features.select(key, content_words(F.col(name)).alias("ws")).filter(F.size("ws") > 0).select(key, F.size("ws").alias("n"), F.explode("ws").alias("w"))
    got = tokens.join(small(own), "w").groupBy(key, "capability", "n").agg(F.count("*").alias("explained")).withColumn("coverage", F.col("explained") / F.col("n")).filter(F.col("coverage") >= least)
    tied = got.withColumn("top", F.max("coverage").over(Window.partitionBy(key))).filter(F.col("top") - F.col("coverage") < 0.01)
    wide = exploded(vocabulary, "narrows", "wide").select(F.col("id").alias("capability"), "wide")
    narrow = tied.select(key, "capability").join(small(wide), "capability").join(tied.select(key, F.col("capability").alias("wide")), [key, "wide"], "left_semi").select(key, "capability", F.lit(1).alias("narrow")).distinct()
    best = tied.join(narrow, [key, "capability"], "left").groupBy(key).agg(F.min(F.struct(F.coalesce(-F.col("narrow"), F.lit(0)).alias("a"), (-F.col("coverage")).alias("b"), (-F.col("explained")).alias("c"), "capability")).alias("m"))
    return best.select(key, "m.capability", F.floor(-F.col("m.b") * 100 + 0.5).cast("long").alias("coverage"))


def named_products(feature: Column, declared: Column) -> Column:
    """Products that a feature names: those declared, else capitalised words after the first that are no stack or plain word."""
    low = F.filter(F.transform(declared, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    spoken = F.filter(F.split(F.trim(feature), r"\s+"), lambda w: w != "")
    found = F.transform(F.filter(F.slice(spoken, F.lit(2), F.greatest(F.size(spoken), F.lit(1))), lambda w: w.rlike("^[A-Z][A-Za-z0-9.+-]{2,}$")), F.lower)
    return F.when(F.size(declared) > 0, low).otherwise(F.filter(found, lambda w: ~w.isin(*NOT_A_PRODUCT)))


def exclusion_hits(excluded: Column, declared: Column) -> Column:
    return F.filter(F.transform(excluded, lambda t: F.lower(F.trim(t))), lambda t: (t != "") & F.contains(F.lower(declared), t))


def ordered_union(most: int | None, *lists: Column) -> Column:
    """What several lists name, in their order, once; the first most."""
    all_ = F.array_distinct(F.concat(*lists))
    return F.slice(all_, 1, most) if most else all_


def enriched(features: DataFrame, key: str, vocabulary: DataFrame, language: str | None, budget: int) -> DataFrame:
    """(key, id, strategy, priority, checklist, searches): caller features as tasks. The caller's hints come before a vendor's, the name and the vocabulary's terms; its requirements before the checklist.

    features (key, ord, name, requirements, search_hints, must_mention). A feature that no capability explains stays, with its own words.
    """
    none = F.expr("cast(array() as array<string>)")
    got = features.join(best_capability(features, key, "name", vocabulary), key, "left")
    facts = vocabulary.select(F.col("id").alias("capability"), "reuse", "checklist", "search_terms")
    got = got.join(small(facts), "capability", "left")
    vendors = F.slice(F.coalesce("must_mention", none), 1, 2)
    vendor = F.concat(vendors, F.transform(vendors, lambda v: F.concat(v, F.lit(" sdk"))))
    searches = F.filter(ordered_union(None, F.coalesce("search_hints", none), vendor, F.array(F.concat_ws(" ", "name", F.lit(language))), F.coalesce("search_terms", none)), lambda q: q != "")
    chosen = F.when(F.col("capability").isNull(), "reuse-pattern").when(F.col("reuse") == "high", "reuse-library").when(F.col("reuse") == "low", "study-reference").otherwise("reuse-pattern")
    return got.select(
        key, F.coalesce("capability", F.regexp_replace(normalise(F.col("name")), " ", "-")).alias("id"), chosen.alias("strategy"), F.greatest(F.lit(10), 90 - 5 * F.col("ord")).cast("long").alias("priority"),
        ordered_union(12, F.coalesce("requirements", none), F.coalesce("checklist", none)).alias("checklist"), F.slice(searches, F.lit(1), F.greatest(F.lit(2), budget + F.size(vendor))).alias("searches"),
    )


def declared_needs(features: DataFrame, key: str, name: str, needs: str) -> DataFrame:
    """(key, needed): features that a feature names as needed, by name without case; not itself."""
    named = features.select(F.col(key).alias("needed"), F.lower(name).alias("_n"))
    return features.select(key, F.explode(needs).alias("d")).join(named, F.lower("d") == F.col("_n")).filter(F.col(key) != F.col("needed")).select(key, "needed").distinct()


def chosen_in_order(tasks: DataFrame, key: str, priority: str, place: str, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(chosen, not searched): the most urgent tasks, four unless told, twenty at most, in build order; and the others."""
    top = tasks.orderBy(F.desc(priority), key).limit(min(most if most is not None else 4, 20)).select(key)
    return tasks.join(F.broadcast(top), key, "left_semi").orderBy(place), tasks.join(F.broadcast(top), key, "left_anti")


def composite(units: DataFrame, key: str, main: DataFrame, vocabulary: DataFrame, most: int = 12, heads: int = 2) -> DataFrame:
    """(key, id, capabilities, checklist): one task for a requirement: the main capability's checklist, then the first items of the others'."""
    lists = small(vocabulary.select(F.col("id").alias("unit"), "checklist"))
    rows = units.join(main.select(key, F.col("capability").alias("main")), key).join(lists, "unit").withColumn("first", F.col("unit") == F.col("main"))
    item = F.struct((~F.col("first")).alias("late"), "place", F.when(F.col("first"), F.col("checklist")).otherwise(F.slice("checklist", 1, heads)).alias("list"), "unit")
    got = rows.groupBy(key, "main").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return got.select(key, F.col("main").alias("id"), F.transform("all", lambda x: x["unit"]).alias("capabilities"), ordered_union(most, F.flatten(F.transform("all", lambda x: x["list"]))).alias("checklist"))


def covers(text: Column, phrase: Column) -> Column:
    return contains_phrase(stem_phrase(text), stem_phrase(phrase))
