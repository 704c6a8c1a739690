"""What a text asks for: capabilities by stemmed phrases, their closure, checklists and their coverage, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import contains_phrase, content_terms, phrase_position, stem_phrase, topic
from evidra.operators import containment
from evidra.operators.lineage import SMALL, cut, small

# Words that part a sentence's head from what qualifies it, and words without content.
QUALIFIERS = ("with", "that", "which", "supporting", "support", "including", "include", "featuring", "having", "plus", "and", "or")
STOP = ("the", "and", "for", "with", "that", "this", "from", "into", "are", "was", "has", "have", "its", "can", "able", "support", "supports")


def phrase_matches(texts: DataFrame, key: str, text: str, triggers: DataFrame, capability: str = "capability", trigger: str = "trigger", head: bool = False) -> DataFrame:
    """(key, capability, hits, position): triggers found as whole stemmed words. With head also head_end of the text.

    A trigger, of which there may be any number, is looked up in the texts by the
    rarest of its words (see containment.contained).
    """
    stems = triggers.select(F.col(capability).alias("capability"), stem_phrase(F.col(trigger)).alias("phrase")).distinct().filter("phrase <> ''")
    stems = cut(stems.withColumn("form", F.lit(0)))
    rows = texts.select(F.col(key).alias("_of"), F.lit(0).alias("form"), stem_phrase(F.col(text)).alias("s"))
    met = containment.contained(rows, stems, containment.words, contains_phrase)
    end = [stemmed_head_end(F.col("s")).alias("head_end")] if head else []
    hits = met.join(small(stems.drop("form")), "phrase").select(F.col("_of").alias(key), "capability", phrase_position(F.col("s"), F.col("phrase")).alias("p"), *end)
    return hits.groupBy(key, "capability").agg(F.count("*").alias("hits"), F.min("p").alias("position"), *([F.max("head_end").alias("head_end")] if head else []))


def head_end(text: Column) -> Column:
    """Number of words before the first qualifier."""
    return stemmed_head_end(stem_phrase(text))


def stemmed_head_end(s: Column) -> Column:
    """head_end of a text that is stemmed already."""
    head = F.regexp_replace(s, rf"\b(?:{'|'.join(QUALIFIERS)})\b.*$", "")
    return F.length(head) - F.length(F.replace(head, F.lit(" "))) + F.when(F.length(head) == F.length(s), 1).otherwise(0)


def closure(edges: DataFrame, src: str, dst: str, depth: int | None = None) -> DataFrame:
    """(origin, reached, steps): everything reachable (within depth steps if given), the fewest steps of each; cycles end by themselves."""
    step = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    wave = step.select(F.col("s").alias("origin"), F.col("d").alias("reached"))
    out, k = wave.withColumn("steps", F.lit(1).cast("long")), 1
    while depth is None or k < depth:
        k += 1
        wave = wave.join(step, F.col("reached") == F.col("s")).select("origin", F.col("d").alias("reached")).distinct()
        wave = cut(wave.join(out.select("origin", "reached"), ["origin", "reached"], "left_anti"))
        if wave.isEmpty():
            break
        out = out.unionByName(wave.withColumn("steps", F.lit(k).cast("long")))
    return out


def primary(matches: DataFrame, key: str, narrows: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """(key, capability): the main capability of each text.

    Those in the head clause count, if there are any; a capability that a matching one narrows is
    out; the last one named wins, then the one with most hits. head is (key, head_end), if matches don't hold head_end; narrows (narrow, wide).
    """
    rows = (matches if head is None else matches.join(head, key)).withColumn("inside", F.col("position") < F.col("head_end"))
    some = rows.groupBy(key).agg(F.max("inside").alias("any"))
    rows = rows.join(some, key).filter("inside or not any")
    wide = rows.select(key, F.col("capability").alias("narrow")).join(small(narrows), "narrow").select(key, F.col("wide").alias("capability"))
    left = rows.join(wide, [key, "capability"], "left_anti")
    return left.groupBy(key).agg(F.max_by("capability", F.struct("position", "hits", "capability")).alias("capability"))


def unit_priority(foundational: Column, reuse: Column, implied: Column, hits: Column) -> Column:
    value = F.lit(50) + F.when(foundational, 25).otherwise(0) + F.when(reuse == "high", 15).when(reuse == "low", -15).otherwise(0) - F.when(implied, 20).otherwise(0) + F.least(F.lit(10), 3 * hits)
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def coverage(requirements: DataFrame, requirement: str, text: str, corpora: DataFrame, entity: str, body: str, weight: str, group: str | None = None) -> DataFrame:
    """(entity, requirement, covered, terms, coverage, best, status): each requirement's terms held against each entity's corpora.

    weight is a corpus's reliability in hundredths. Evidenced: half the terms and a corpus of 30 or
    more, or a term of five letters in one of 85 or more. With no corpus of 55 or more what isn't
    found is unknown, else absent. A term is in a body as it is, without separators if it has four
    letters then, or without a plural's s. Terms, of which there may be any number, are letters and digits: they are looked up in
    the entities' distinct words by the rarest of their three-letter pieces (see containment.contained), and where words meet by the four letters about
    the seam (see containment.across). With group, a column of both tables, an entity is held against the requirements of its own group alone.
    """
    of_group = (F.col(group).cast("string") if group else F.lit("")).alias("_group")
    wanted = requirements.select(of_group, F.col(requirement).alias("requirement"), content_terms(F.col(text), STOP).alias("terms")).filter(F.size("terms") > 0)
    each = cut(wanted.select("_group", "requirement", F.size("terms").alias("terms"), F.explode("terms").alias("t")))
    one = F.when(F.endswith("t", F.lit("s")) & (F.length("t") > 3), F.regexp_replace("t", "s$", ""))
    forms = [("0", F.col("t")), ("1", F.when(F.length("t") >= 4, F.col("t"))), ("0", one)]
    form = lambda f: F.concat_ws("|", F.lit(f), "_group").alias("form")
    listed = F.inline(F.array(*[F.struct(form(f), c.alias("phrase")) for f, c in forms]))
    phrases = cut(each.select("_group", "t").distinct().select("t", listed).filter("phrase is not null"))
    bodies = corpora.select(of_group, F.col(entity).alias("_entity"), F.lower(body).alias("b"), F.col(weight).alias("w"))
    reliable = cut(bodies.groupBy("_entity", "_group").agg(F.max("w").alias("reliable")))
    known = lambda met: met.join(small(phrases), ["form", "phrase"]).groupBy("_entity", F.expr("substring(form, 3)").alias("_group"), "t").agg(F.max("w").alias("w"))
    # letters and digits lie within runs of these, which entities have few of; those of two words and more lie about a seam
    runs = bodies.select("_entity", "w", form("0"), F.explode_outer(F.split("b", "[^a-z0-9]+")).alias("s")).filter(F.length("s") > 2)
    runs = cut(runs.groupBy("form", "_entity", "s").agg(F.max("w").alias("w")))
    met = containment.contained(cut(runs.select("form", "s").distinct()), phrases.filter(F.startswith("form", F.lit("0"))), containment.grams, F.contains)
    plain = cut(known(runs.join(met, ["form", "s"])))
    # a term that every entity of the group has in a corpus of its highest weight isn't looked for about seams
    most = reliable.groupBy("_group").agg(F.count("*").alias("entities"))
    sure = plain.join(reliable, ["_entity", "_group"]).filter(F.col("w") >= F.col("reliable")).groupBy("_group", "t").agg(F.count("*").alias("n"))
    sure = sure.join(most, "_group").filter(F.col("n") == F.col("entities")).select(form("1"), F.col("t").alias("phrase"))
    seams = cut(phrases.filter(F.startswith("form", F.lit("1"))).join(sure, ["form", "phrase"], "left_anti"))
    about = cut(known(containment.across(bodies.select("_entity", "w", form("1"), F.col("b").alias("s")), seams)))
    found = plain.unionByName(about).groupBy("_entity", "_group", "t").agg(F.max("w").alias("w"))
    best = [F.count("*").alias("covered"), F.max("w").alias("best"), F.max((F.length("t") >= 5) & (F.col("w") >= 85)).alias("distinctive")]
    found = found.join(small(each.select("_group", "requirement", "t")), ["_group", "t"]).groupBy("_entity", "_group", "requirement").agg(*best)
    # every entity is held against every requirement of its group, in blocks of a bounded size
    names = cut(wanted.select("_group", "requirement", F.size("terms").alias("terms")))
    blocks, got = -(-max(1, names.count()) // SMALL), None
    for k in range(blocks):
        part = names.filter(F.pmod(F.xxhash64("requirement"), F.lit(blocks)) == k)
        part = part.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("requirement", "terms"))).alias("all"))
        part = reliable.join(small(part), "_group").select("_entity", "_group", "reliable", F.inline("all"))
        got = part if got is None else got.union(part)
    got = got.join(found, ["_entity", "_group", "requirement"], "left")
    got = got.withColumns({"covered": F.coalesce("covered", F.lit(0)), "best": F.coalesce("best", F.lit(0)), "distinctive": F.coalesce("distinctive", F.lit(False))})
    seen = ((2 * F.col("covered") >= F.col("terms")) & (F.col("best") >= 30)) | F.col("distinctive")
    status = F.when(seen, "evidenced").when(F.col("reliable") < 55, "unknown").otherwise("absent")
    whole = [F.col(c).cast("long").alias(c) for c in ("covered", "terms", "best")]
    return got.select(F.col("_entity").alias(entity), "requirement", *whole, status.alias("status"))


def completeness(items: DataFrame, entity: str) -> DataFrame:
    """(entity, satisfied, decidable, ratio in hundredths, undetermined): unknown items don't count against an entity."""
    got = items.groupBy(entity).agg(
        F.count_if(F.col("status") == "evidenced").alias("satisfied"), F.count_if(F.col("status") != "unknown").alias("decidable"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "unknown", F.col("requirement").cast("string")))), ",").alias("undetermined"),
    )
    ratio = F.when(F.col("decidable") > 0, F.floor((200 * F.col("satisfied") + F.col("decidable")) / (2 * F.col("decidable")))).cast("long")
    return got.select(entity, "satisfied", "decidable", ratio.alias("ratio"), "undetermined")


# Precision of each shape of query, in hundredths, in the order in which they take turns.
SHAPES = {"idiom": 95, "vendor": 90, "domain": 80, "topic": 70, "requirement": 60, "generic": 50}


def query_shapes(tasks: DataFrame, key: str, label: str, requirement: str, terms: str, language: str) -> DataFrame:
    """(key, shape, shape_ord, precision, query): the queries each task can ask, by shape."""
    order = list(SHAPES)
    made = {
        "domain": F.transform(F.col(terms), lambda t: t),
        "topic": F.array(F.concat(F.lit("topic:"), topic(F.col(label)))),
        "requirement": F.array(F.array_join(content_terms(F.col(requirement), STOP, 3, 4), " ")),
        "generic": F.array(F.concat_ws(" ", F.lower(label), F.lower(language))),
    }
    out = None
    for shape, queries in made.items():
        part = tasks.select(key, F.lit(shape).alias("shape"), F.lit(order.index(shape)).alias("shape_ord"), F.lit(SHAPES[shape]).alias("precision"), F.explode(queries).alias("query"))
        out = part if out is None else out.unionByName(part)
    return out.filter("query <> ''")


def relaxed(queries: DataFrame, query: str, most: int = 2, least_terms: int = 2) -> DataFrame:
    """queries with drop (terms left out at the end, 0 to most) and variant; none with a qualifier such as a:b."""
    parts = F.split(query, " ")
    rows = queries.withColumn("drop", F.explode(F.sequence(F.lit(0), F.lit(most))))
    rows = rows.filter((F.col("drop") == 0) | ((F.size(parts) - F.col("drop") >= least_terms) & ~F.contains(F.col(query), F.lit(":"))))
    return rows.withColumn("variant", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - F.col("drop")), " "))
