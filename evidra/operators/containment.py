"""Many phrases against many texts: an inverted table of keys, of which each phrase looks up its rarest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.lineage import cut, small
from evidra.operators.membership import Members

#: So many phrases or fewer aren't looked up by keys.
FEW = 32
#: Letters of a key of texts that are searched for parts of words.
GRAM = 3
#: What parts words, and is left out where words are read as one.
SEPARATORS = r"[\s_.\-]+"


def grams(text: Column) -> Column:
    """Each stretch of GRAM characters; texts that are shorter have none."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1))


def words(text: Column) -> Column:
    return F.split(text, " ")


def _passing(wanted: DataFrame, texts: DataFrame, keys: Column) -> DataFrame:
    """texts (form, ...) with key: each distinct one of keys that may be in wanted (form, key)."""
    members = Members(wanted, "form", "key")
    each = texts.join(members.row).withColumn("key", F.explode_outer(F.array_distinct(keys)))  # not a filter of the array: that isn't compiled, and copies the bits for each text
    return each.filter(F.col("key").isNotNull() & members.hit(F.col("form"), F.col("key"))).drop("_bits")


def contained(texts: DataFrame, phrases: DataFrame, keys: Callable[[Column], Column], inside: Callable[[Column, Column], Column]) -> DataFrame:
    """texts (form, s, further columns) with phrase: each phrase (form, phrase) that is inside a text of its form.

    keys(s) are a text's keys and keys(phrase) those of which the text must have all: words, or grams.
    A phrase is looked up by the one of its keys that fewest texts have, so a text meets no more phrases
    than share its rare keys, whatever their number; a phrase with a key that no text has meets none.
    What meets is decided by inside(s, phrase). FEW phrases or less are held against each text of their form, which is
    read once then. Phrases without a key meet all texts of their form.
    """
    wanted = cut(phrases.select("form", "phrase").distinct().withColumn("keys", F.array_distinct(keys(F.col("phrase")))))
    if wanted.limit(FEW + 1).count() <= FEW:
        listed = wanted.groupBy("form").agg(F.collect_list("phrase").alias("_all"))
        return texts.join(F.broadcast(listed), "form").withColumn("phrase", F.explode(F.filter("_all", lambda p: inside(F.col("s"), p)))).drop("_all")
    some = wanted.select("form", "phrase", F.explode("keys").alias("key"))
    met = _passing(some.select("form", "key"), texts.select("form", "s"), keys(F.col("s")))
    often = met.groupBy("form", "key").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("m")
    chosen = some.join(often, ["form", "key"], "left").groupBy("form", "phrase").agg(rarest).filter("m.n > 0")
    chosen = cut(chosen.select(F.col("form").alias("_form"), "phrase", F.col("m.key").alias("_key")))
    near = _passing(chosen.select(F.col("_form").alias("form"), F.col("_key").alias("key")), texts, keys(F.col("s")))
    found = near.join(small(chosen), (F.col("form") == F.col("_form")) & (F.col("key") == F.col("_key"))).drop("key", "_form", "_key")
    short = wanted.filter(F.size("keys") == 0).select(F.col("form").alias("_form"), "phrase")
    everywhere = texts.join(small(short), F.col("form") == F.col("_form")).drop("_form")
    return found.unionByName(everywhere).filter(inside(F.col("s"), F.col("phrase")))


#: So many keys of seams or fewer are broadcast: their rows are a word long.
SEAMS = 100_000


def across(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts (form, s, further columns) without s, with phrase: each phrase (form, phrase) that is in a text of its form once SEPARATORS are left out, but not within a word.

    Phrases have no separators and four characters or more. Such a phrase starts in one word, whose end is the phrase's head, and
    goes on in the next ones. Up to three characters before the seam and up to three of the next word (a space stands
    for its end) are a key. Seams whose key a phrase may have, by a filter of fixed size, meet the phrases of that key; head and tail decide.
    A text gives a row or more for each seam at which a phrase is found.
    """
    size = F.length("phrase")
    parts = phrases.select("form", "phrase", F.explode(F.sequence(F.lit(1), size - 1)).alias("at"))
    parts = parts.select("form", "phrase", F.left("phrase", F.col("at")).alias("_head"), F.substring("phrase", F.col("at") + 1, size).alias("_tail"))
    behind = F.least(F.length("_tail"), F.lit(3))
    parts = parts.withColumns({"_behind": behind, "_before": F.least(F.length("_head"), F.when(behind < 3, 3).otherwise(2))})
    # the next word has so many characters of the tail, or is shorter and ends there
    begins = F.transform(F.sequence(F.lit(1), F.col("_behind")), lambda n: F.concat(F.left("_tail", n), F.when(n < F.col("_behind"), " ").otherwise("")))
    parts = parts.withColumns({"_left": F.right("_head", F.col("_before")), "_right": F.explode(begins)})
    parts = cut(parts.withColumn("_key", F.concat_ws("|", "form", "_left", "_right")))
    shapes = parts.select("_before", "_behind").distinct().collect()  # (1, 3), (2, 2), (2, 3), (3, 1), (3, 2) at most
    if not shapes:
        return texts.join(phrases.select("form", "phrase").limit(0), "form").drop("s")
    most = parts.agg(F.max(F.length("phrase"))).first()[0] - 1  # characters on either side of a seam
    members = Members(parts, "form", "_left", "_right")
    kept = [c for c in texts.columns if c != "s"]
    rows = texts.select(*kept, F.split("s", SEPARATORS, -1).alias("_words")).join(members.row)
    # outer, as Spark would split once more to leave out empty ones; one hit a row, as much code in one step isn't compiled by the JVM
    rows = rows.select(*kept, "_bits", "_words", F.posexplode_outer("_words").alias("_at", "_word")).filter(F.col("_at") < F.size("_words") - 1)
    # pieces are columns of their own, so that each is taken once
    ended = F.concat(F.get("_words", F.col("_at") + 1), F.lit(" "))
    rows = rows.select("*", *[F.right("_word", F.lit(n)).alias(f"_l{n}") for n in (1, 2, 3)], *[F.left(ended, F.lit(n)).alias(f"_r{n}") for n in (1, 2, 3)])
    slots = F.array(*[members.slot(F.col("form"), F.col(f"_l{b}"), F.col(f"_r{a}")) for b, a in shapes])
    rows = rows.select("*", F.posexplode_outer(slots).alias("_shape", "_slot")).filter(members.marked(F.col("_slot")))
    of = lambda names: F.get(F.array(*names), F.col("_shape"))
    key = F.concat_ws("|", "form", of([f"_l{b}" for b, _ in shapes]), of([f"_r{a}" for _, a in shapes]))
    rows = rows.select(*kept, key.alias("_key"), F.right("_word", F.lit(most)).alias("_word"), F.slice("_words", F.col("_at") + 2, F.lit(most)).alias("_next"))
    found = rows.join(small(parts.select("_key", "_head", "_tail", "phrase"), SEAMS), "_key")
    then = F.get("_next", F.lit(0))
    goes_on = F.startswith(then, F.col("_tail")) | (F.startswith(F.col("_tail"), then) & F.startswith(F.array_join("_next", ""), F.col("_tail")))
    return found.filter(F.endswith("_word", "_head") & goes_on).select(*kept, "phrase")
