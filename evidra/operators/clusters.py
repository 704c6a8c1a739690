"""Near-duplicate entities: blocked candidate pairs, components, one representative each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import bigrams, plain_name
from evidra.operators.lineage import cut


def wide(rows: DataFrame) -> DataFrame:
    """rows, to be joined by a shuffle however small they look when compressed: a broadcast of millions of short rows is built in the driver's memory."""
    return rows.hint("merge")


def star_links(rows: DataFrame, key: Column, entity: str, reason: str) -> DataFrame:
    """(a, b, reason): each entity that shares a key with the least entity of that key. Linear in the key's size, however hot."""
    keyed = rows.select(F.col(entity).alias("b"), key.alias("k")).filter("k is not null")
    least = keyed.groupBy("k").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(wide(least), "k").filter(F.col("a") != F.col("b")).select("a", "b", F.lit(reason).alias("reason"))


def fork_links(rows: DataFrame, entity: str, parent: str) -> DataFrame:
    own = rows.select(F.col(entity).alias("a"))
    child = rows.filter(F.col(parent).isNotNull() & (F.col(parent) != F.col(entity))).select(F.col(parent).alias("a"), F.col(entity).alias("b"))
    return child.join(own, "a").select("a", "b", F.lit("fork").alias("reason"))


def piece_sets(rows: DataFrame, entity: str, block: list[str], name: str) -> DataFrame:
    """(block, name, entity, pieces): each distinct name of a block once, with its least entity and its pieces.

    Pieces are two-letter ones, numbered where they come again in a name, in order of how many names of
    the block have them: the rarest first.
    """
    names = rows.groupBy(*block, F.lower(name).alias("name")).agg(F.min(entity).alias("entity")).withColumn("bare", bigrams(F.col("name")))
    before = lambda p, i: F.size(F.filter(F.slice("bare", 1, i), lambda q: q == p))
    numbered = F.transform("bare", lambda p, i: F.concat(p, before(p, i).cast("string")))
    each = names.withColumn("piece", F.explode(numbered)).drop("bare")
    often = each.groupBy(*block, "piece").agg(F.count("*").alias("often"))
    ordered = F.array_sort(F.collect_list(F.struct("often", "piece")))
    return each.join(often, [*block, "piece"]).groupBy(*block, "name", "entity").agg(F.transform(ordered, lambda x: x["piece"]).alias("pieces"))


def dice_keys(sets: DataFrame, block: list[str], over: float, *more: str) -> DataFrame:
    """(block, name, n, more, k, at, shared): keys of each name, from rows of piece_sets; two like names have one in common.

    Two names with more than over of their n and m pieces in common share more than over / (2 - over)
    of the longer one's. So, in an order that all names keep, each has two common ones among its first
    n - ceil(n * over / (2 - over)) + 2: names meet under each two pieces of this prefix, the rarest
    that they have. Names so short that one common piece may do also meet under each one.
    """
    share = over / (2 - over)
    n = F.size("pieces")
    sized = sets.withColumn("n", n).withColumn("prefix", F.slice("pieces", F.lit(1), (n - F.ceil(n * share - 1e-9) + 2).cast("int")))
    after = lambda i: F.slice("prefix", i + 2, F.size("prefix"))
    twos = F.flatten(F.transform("prefix", lambda x, i: F.transform(after(i), lambda y, j: F.struct(F.concat_ws("|", x, y).alias("k"), (i + j + 1).alias("at"), F.lit(2).alias("shared")))))
    ones = F.transform("prefix", lambda x, i: F.struct(x.alias("k"), i.alias("at"), F.lit(1).alias("shared")))
    keys = F.when(F.col("n") * share <= 1, F.concat(twos, ones)).otherwise(twos)
    return sized.select(*block, "name", "n", *more, F.inline(keys))


def _enough(over: float) -> Column:
    """Whether two rows of dice_keys under one key may be alike: a pair needs lengths near enough, and where the key is the first that it shares, enough places after it."""
    most = F.col("shared") + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) - 1
    return 2 * F.least("n", "n2", most) > over * (F.col("n") + F.col("n2"))


def dice_candidates(sets: DataFrame, block: list[str], over: float) -> DataFrame:
    """(block, name, name2): pairs of a block that may be alike, from rows of piece_sets (see dice_keys)."""
    keyed = dice_keys(sets, block, over)
    other = keyed.withColumnsRenamed({"name": "name2", "n": "n2", "at": "at2"})
    return keyed.join(wide(other), [*block, "k", "shared"]).filter((F.col("name") < F.col("name2")) & _enough(over)).select(*block, "name", "name2").distinct()


def _alike(pairs: DataFrame, own: DataFrame, block: list[str], over: float) -> DataFrame:
    """Those of pairs (block, name, name2) that are alike, with their score and what else own (block, name, pieces) says of both."""
    other = own.withColumnsRenamed({c: f"{c}2" for c in own.columns if c not in block})
    both = pairs.join(wide(own), [*block, "name"]).join(wide(other), [*block, "name2"])
    score = 2.0 * F.size(F.array_intersect("pieces", "pieces2")) / (F.size("pieces") + F.size("pieces2"))
    return both.withColumn("score", score).filter(F.col("score") > over).drop("pieces", "pieces2")


def dice_links(rows: DataFrame, entity: str, block: list[str], name: str, over: float = 0.85) -> DataFrame:
    """(block, name, name2, entity, entity2, score): pairs of a block with like names (Dice of their two-letter pieces above over).

    Distinct names are paired, not entities: a name's entities share its class. Each name is taken apart once;
    which pairs are compared is told by dice_candidates, and no like pair is missed.
    """
    sets = cut(piece_sets(rows, entity, block, name))
    found = _alike(dice_candidates(sets, block, over), sets.select(*block, "name", "entity", "pieces"), block, over)
    return found.select(*block, "name", "name2", "entity", "entity2", "score")


def dice_classes(sets: DataFrame, block: list[str], over: float) -> DataFrame:
    """(a, b): classes that like names join, from rows of piece_sets with the class (label) that each name is in already.

    Names of one class are never compared, so names that are all alike don't give all their pairs. First each
    name meets the least one of its keys; what these join is one class. Then, under keys with several classes left,
    every name outside the key's largest class meets all names of other classes: no join of classes is missed.
    """
    own, key = sets.select(*block, "name", "label", "pieces"), [*block, "k", "shared"]
    of = lambda rows: rows.withColumnsRenamed({"name": "name2", "n": "n2", "at": "at2", "label": "label2"})
    pair = [F.least("name", "name2").alias("name"), F.greatest("name", "name2").alias("name2")]
    joined = lambda near: cut(_alike(near.filter(_enough(over)).select(*block, *pair).distinct(), own, block, over).select(F.col("label").alias("a"), F.col("label2").alias("b")).filter("a <> b").distinct())
    keyed = dice_keys(sets, block, over, "label")
    least = keyed.groupBy(*key).agg(F.min(F.struct("name", "n", "at", "label")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    keyed = cut(keyed.join(wide(least), key).select(*keyed.columns, "m"))
    centre = [F.col(f"m.{c}").alias(f"{c}2") for c in ("name", "n", "at", "label")]
    links = joined(keyed.select(*keyed.columns[:-1], *centre).filter("label <> label2"))
    classes = connected(links).select(F.col("v").alias("_v"), F.col("label").alias("_to"))
    left = cut(keyed.drop("m").join(wide(classes), F.col("label") == F.col("_v"), "left").withColumn("label", F.coalesce("_to", "label")).drop("_v", "_to"))
    sizes = left.groupBy(*key, "label").agg(F.count("*").alias("size"))
    top = sizes.groupBy(*key).agg(F.max(F.struct("size", "label"))["label"].alias("top"), F.count("*").alias("classes")).filter("classes > 1").drop("classes")
    left = cut(left.join(wide(top), key))
    once = (F.col("label2") == F.col("top")) | (F.col("name") < F.col("name2"))
    near = left.filter("label <> top").join(wide(of(left.drop("top"))), key).filter((F.col("label") != F.col("label2")) & once)
    return links.union(joined(near))


def plain_key(name: str) -> Column:
    return F.nullif(plain_name(F.col(name)), F.lit(""))


def description_key(text: str, over: int = 40) -> Column:
    """Texts longer than that are the same if they are equal apart from case and white space."""
    clean = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    return F.when(F.length(clean) > over, F.sha2(clean, 256))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): the least member of each component.

    Each round a class hooks to the least label that any of its members sees; hooks are followed
    to their ends by halving, until no class sees a lesser one. Two rounds leave half the classes
    at most, whatever the order of ids.
    """
    both = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("v")).agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(wide(labels), F.col("y") == F.col("v")).groupBy("x").agg(F.min("label").alias("least"))
        seen = labels.join(wide(near), F.col("v") == F.col("x")).groupBy("label").agg(F.min(F.least("label", "least")).alias("to"))
        hooks = cut(seen)
        if not hooks.filter("to < label").limit(1).count():
            break
        while True:
            ends = hooks.select(F.col("label").alias("w"), F.col("to").alias("end"))
            ahead = cut(hooks.join(wide(ends), F.col("to") == F.col("w")).select("label", "to", "end"))
            hooks = ahead.select("label", F.col("end").alias("to"))
            if not ahead.filter("end < to").limit(1).count():
                break
        labels = cut(labels.join(wide(hooks), "label").select("v", F.col("to").alias("label")))
    return labels


def representative_score(archived: Column, days: Column, stars: Column, fork: Column) -> Column:
    """Live and recent before popular, forks a little behind; an archive is last, whatever else it is."""
    recency = F.when(days <= 90, 100).when(days <= 365, 60).when(days <= 730, 25).otherwise(0)
    return F.when(archived, -1000.0).otherwise(recency + 8 * F.log10(stars + 1) - F.when(fork, 15).otherwise(0))


def representatives(members: DataFrame, group: str, entity: str, score: str) -> DataFrame:
    """(group, representative, members): the best member of each group, the least id among equals."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(entity).alias("e")))
    return members.groupBy(group).agg(best.alias("m"), F.count("*").alias("members")).select(group, F.col("m.e").alias("representative"), "members")


def folded(rows: DataFrame, over: float = 0.85, block: str | None = None) -> DataFrame:
    """(id, cluster, representative, members, kept): near-duplicates folded into one of them.

    rows (id, owner, name, parent, is_fork, archived, days, stars, description), names in lower
    case, days since the last push (null: long ago). Linked are a fork and its parent, equal names, names
    that are equal without affixes, like names of one owner (Dice over), and equal long descriptions. A cluster
    is all that such links join; its best member stays, the least id among equals. A name that is
    nothing but affixes is like no other. With block only rows of the same block are linked.
    """
    blocks = [block] if block else []
    within = lambda key: F.when(key.isNotNull(), F.concat_ws("|", *blocks, key))
    links = _forks(rows).union(star_links(rows, within(F.col("name")), "id", "copy")).union(star_links(rows, within(plain_key("name")), "id", "name")).union(star_links(rows, within(description_key("description")), "id", "description"))
    named = cut(_labelled(rows.select("id", *blocks, "owner", "name"), connected(links)))
    # like names join classes: blocks within one class have nothing to compare
    of = [*blocks, "owner"]
    mixed = named.groupBy(*of).agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo <> hi").select(*of)
    own = named.join(wide(mixed), of, "left_semi").groupBy(*of, "name").agg(F.min("id").alias("entity"))
    sets = piece_sets(own, "entity", of, "name").join(wide(named.select(F.col("id").alias("entity"), F.col("cluster").alias("label")).distinct()), "entity")
    joined = connected(dice_classes(cut(sets), of, over)).select(F.col("v").alias("_v"), F.col("label").alias("_to"))
    named = named.join(wide(joined), F.col("cluster") == F.col("_v"), "left").select("id", F.coalesce("_to", "cluster").alias("cluster"))
    score = representative_score(F.col("archived"), F.coalesce("days", F.lit(3650)), F.col("stars"), F.col("is_fork"))
    scored = cut(rows.join(wide(named.distinct()), "id").select("id", "cluster", score.alias("score")))
    best = representatives(scored, "cluster", "id", "score")
    return scored.join(wide(best), "cluster").select("id", "cluster", "representative", "members", (F.col("id") == F.col("representative")).alias("kept"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (id, ...) with cluster: the label (v, label) of an id, itself without one."""
    return rows.join(wide(labels), F.col("id") == F.col("v"), "left").withColumn("cluster", F.coalesce("label", "id")).drop("v", "label")


def _forks(rows: DataFrame) -> DataFrame:
    """(a, b, reason): forks whose parent is there."""
    forks = rows.filter(F.col("is_fork") & F.col("parent").isNotNull()).select(F.col("parent").alias("a"), F.col("id").alias("b"))
    return forks.join(wide(rows.select(F.col("id").alias("a"))), "a").filter("a <> b").select("a", "b", F.lit("fork").alias("reason"))
