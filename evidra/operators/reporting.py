"""Results as text, a row each, and what a plan takes for granted and risks: columns and groups, nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by the extension of a file.
LANGUAGES = {
    "kt": "Kotlin", "kts": "Kotlin", "java": "Java", "swift": "Swift", "m": "Objective-C", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript",
    "py": "Python", "go": "Go", "rs": "Rust", "rb": "Ruby", "php": "PHP", "cs": "C#", "scala": "Scala", "dart": "Dart", "c": "C", "cc": "C++", "cpp": "C++", "h": "C", "hpp": "C++",
}
#: Days without a push from which a selection is said to be unmaintained, and hundredths below which tests and architecture are doubtful.
OLD, TESTED, SHAPED = 730, 40, 50


def language_of(path: Column) -> Column:
    extension = F.lower(F.substring_index(path, ".", -1))
    return F.coalesce(*[F.when(extension == e, name) for e, name in LANGUAGES.items()])


def primary_language(files: DataFrame, entity: str, path: str) -> DataFrame:
    """(entity, language, n): the language that most of an entity's files have by their extension, of equal ones the first by name."""
    counted = files.groupBy(entity, language_of(F.col(path)).alias("language")).agg(F.count("*").alias("n")).filter("language is not null")
    return counted.groupBy(entity).agg(F.min(F.struct((-F.col("n")).alias("m"), "language")).alias("b")).select(entity, "b.language", (-F.col("b.m")).alias("n"))


def adaptation_risks(stack_match: Column, confidence: Column, profiled: Column) -> Column:
    """What may go wrong with an adaptation: tests don't come along into another language, the source's shape is a guess, the target is unknown."""
    said = [
        F.when(stack_match < 0.35, "tests have to be written anew in the other language"),
        F.when(confidence < 0.5, "the source's architecture is a guess: look at it first"),
        F.when(~profiled, "the target was not looked at: places to connect are general ones"),
    ]
    return F.array_compact(F.array(*said))


def kept_in_adaptation(components: Column) -> Column:
    """What an adaptation is for and has to keep, with the first four components."""
    first = F.array_join(F.slice(components, 1, 4), ", ")
    always = ["logic and changes of state", "edge cases: errors, retries, timeouts", "public interfaces that fit the target"]
    return F.array_compact(F.array(*map(F.lit, always), F.when(F.size(components) > 0, F.concat(F.lit("borders between components: "), first))))


def assumptions(selections: DataFrame, plan: str, unrecognised: DataFrame, unenriched: DataFrame, not_searched: DataFrame) -> DataFrame:
    """(plan, place, text): what each plan takes for granted.

    selections (plan, feature, candidate, undetermined, tested, shaped): items that couldn't be looked up, and how sure
    tests and architecture are, in hundredths (null: not measured). The other tables are (plan, name). Doubts about selections come
    first, by feature, then what wasn't planned, searched in own words, or not searched; that licences are to be confirmed is last.
    """
    about = lambda text: F.concat(F.col("feature"), F.lit(": "), text)
    doubts = [
        F.when(F.col("undetermined") > 0, about(F.concat(F.col("undetermined").cast("string"), F.lit(" requirements couldn't be looked up in "), F.col("candidate")))),
        F.when(F.col("tested") < TESTED, about(F.concat(F.lit("hardly any sign that "), F.col("candidate"), F.lit(" tests this")))),
        F.when(F.col("shaped") < SHAPED, about(F.concat(F.lit("the architecture of "), F.col("candidate"), F.lit(" is a guess")))),
    ]
    listed = selections.select(plan, "feature", F.posexplode(F.array(*doubts)).alias("k", "text")).filter("text is not null")
    rows = listed.select(plan, F.lit(0).alias("part"), F.concat_ws("|", "feature", F.col("k").cast("string")).alias("by"), "text")
    for k, (names, said) in enumerate(((unrecognised, "not planned, as no capability is known for it: "), (unenriched, "searched in the words given: "), (not_searched, "not searched, the limit was reached: ")), 1):
        text = F.concat(F.lit(said), F.array_join(F.array_sort(F.collect_set("name")), ", ")).alias("text")
        rows = rows.union(names.groupBy(plan).agg(text).select(plan, F.lit(k), F.lit(""), "text"))
    last = selections.select(plan).distinct().select(plan, F.lit(9), F.lit(""), F.lit("licences are to be confirmed before anything is shipped"))
    return _placed(rows.union(last), plan)


def risks(selections: DataFrame, plan: str, conflicts: DataFrame, versions: DataFrame, licences: DataFrame) -> DataFrame:
    """(plan, place, text): what each plan risks.

    selections (plan, candidate, days since the last push), conflicts (plan, kind, severity, issue), versions (plan, name) with several
    majors, licences (plan, strictest, risk). High licence conflicts come first, then conflicts of architecture, versions, the
    risk of all licences together, and selections without a push for OLD days.
    """
    own = conflicts.filter("(kind = 'licence' and severity = 'high') or kind = 'architecture'")
    rows = own.select(plan, F.when(F.col("kind") == "licence", 0).otherwise(1).alias("part"), F.col("issue").alias("by"), F.col("issue").alias("text"))
    listed = lambda df, name, said, part: df.groupBy(plan).agg(F.concat(F.lit(said), F.array_join(F.array_sort(F.collect_set(name)), ", ")).alias("text")).select(plan, F.lit(part), F.lit(""), "text")
    rows = rows.union(listed(versions, "name", "several major versions of: ", 2))
    strict = licences.filter("risk = 'high'").select(plan, F.lit(3), F.lit(""), F.concat(F.lit("the strictest licence governs all: "), "strictest"))
    return _placed(rows.union(strict).union(listed(selections.filter(F.col("days") > OLD), "candidate", "no longer maintained: ", 4)), plan)


def _placed(rows: DataFrame, plan: str) -> DataFrame:
    """(plan, place, text) by part, then by; a plan has no more lines than it has features and conflicts."""
    lists = rows.groupBy(plan).agg(F.array_sort(F.collect_list(F.struct("part", "by", "text"))).alias("l"))
    return lists.select(plan, F.posexplode(F.transform("l", lambda x: x["text"])).alias("at", "text")).select(plan, (F.col("at") + 1).alias("place"), "text")


def lines(rows: DataFrame, group: str, order: list[str], line: Column, head: Column) -> DataFrame:
    """(group, report): a head and a line for each row of a group, in order; head is made of columns that a group shares."""
    named = rows.select(group, head.alias("_head"), F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], line.alias("_line")).alias("_l"))
    listed = named.groupBy(group).agg(F.min("_head").alias("h"), F.array_sort(F.collect_list("_l")).alias("l"))
    return listed.select(group, F.concat_ws("\n", "h", F.array_join(F.transform("l", lambda x: x["_line"]), "\n")).alias("report"))


def discovery_report(found: DataFrame) -> DataFrame:
    """(task, report) from ranked candidates (task, rank, full_name, total, confidence, verdict, unmeasured), a short list for each task."""
    gone = F.when(F.col("unmeasured") != "", F.concat(F.lit("; not measured: "), "unmeasured")).otherwise("")
    text = F.concat(F.col("rank").cast("string"), F.lit(". "), "full_name", F.lit(" "), F.col("total").cast("string"), F.lit("/100, sure "), F.col("confidence").cast("string"), F.lit("%, "), F.coalesce("verdict", F.lit("not looked into")), gone)
    return lines(found, "task", ["rank"], text, F.concat(F.lit("CANDIDATES for "), "task"))


def comparison_report(compared: DataFrame, group: str) -> DataFrame:
    """(group, report) from rows of bundling.compare."""
    some = lambda said, c: F.when(F.size(c) > 0, F.concat(F.lit(said), F.array_join(c, ", ")))
    parts = [F.concat(F.lit("TAKE "), F.col("recommendation").cast("string")), some("blocked: ", "blockers"), some("they differ in: ", "differentiators"), some("they are alike in: ", "tied"), some("switch for: ", "switch_if")]
    return compared.select(group, F.concat_ws("\n", *parts).alias("report"))


def bundle_report(bundles: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, report) from rows of bundling.bundle: its confidence, and each part that was kept."""
    shown = [F.when(F.array_contains("kept", p), F.concat(F.lit(f"{p}: "), F.col(p))) for p in parts]
    left = F.size(F.filter(F.array(*map(F.lit, parts)), lambda p: ~F.array_contains("kept", p)))
    more = F.when(left > 0, F.concat(F.lit("left out for the budget: "), left.cast("string")))
    return bundles.select(key, F.concat_ws("\n", F.concat(F.lit("BUNDLE, sure "), F.col("confidence").cast("string"), F.lit("%")), *shown, more).alias("report"))


def plan_report(steps: DataFrame, plan: str, assumed: DataFrame, risked: DataFrame) -> DataFrame:
    """(plan, report): steps, assumptions and risks of each plan, numbered."""
    said = None
    for k, (rows, number, title) in enumerate(((steps, "step", "PLAN"), (assumed, "place", "TAKEN FOR GRANTED"), (risked, "place", "RISKS"))):
        text = F.concat(F.col(number).cast("string"), F.lit(". "), "text")
        part = lines(rows.withColumn("_n", F.col(number).cast("long")), plan, ["_n"], text, F.lit(title)).select(plan, F.lit(k).alias("_part"), "report")
        said = part if said is None else said.union(part)
    return said.groupBy(plan).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "report"))), lambda x: x["report"]), "\n\n").alias("report"))


def metrics_report(rows: DataFrame, key: str, raw: str, returned: str, reduction: str) -> DataFrame:
    """(key, report): tokens read and returned, and how much less that is."""
    text = F.concat(F.lit("read "), F.col(raw).cast("string"), F.lit(" tokens, returned "), F.col(returned).cast("string"), F.lit(" ("), F.col(reduction).cast("string"), F.lit(" % less)"))
    return rows.select(key, text.alias("report"))
