"""Licences: what a text or an identifier says, what that allows, and how a set of them fits together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier and category.
CATEGORY = {
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive",
    "Unlicense": "public-domain", "CC0-1.0": "public-domain", "0BSD": "public-domain", "Zlib": "permissive",
    "MPL-2.0": "weak-copyleft", "EPL-2.0": "weak-copyleft", "LGPL-2.1": "weak-copyleft", "LGPL-3.0": "weak-copyleft",
    "GPL-2.0": "strong-copyleft", "GPL-3.0": "strong-copyleft", "AGPL-3.0": "network-copyleft", "SSPL-1.0": "network-copyleft",
    "BUSL-1.1": "proprietary", "Elastic-2.0": "proprietary", "CC-BY-4.0": "permissive", "CC-BY-SA-4.0": "strong-copyleft",
}
# How strict a category is (in halves), and its score in hundredths (open source, closed).
STRICTNESS = {"public-domain": 0, "permissive": 2, "weak-copyleft": 4, "strong-copyleft": 6, "network-copyleft": 8, "unknown": 9, "none": 9, "proprietary": 10}
SCORE = {"public-domain": (100, 100), "permissive": (100, 100), "weak-copyleft": (70, 70), "strong-copyleft": (50, 35), "network-copyleft": (20, 20), "proprietary": (5, 5), "unknown": (15, 15), "none": (15, 15)}
# Phrases of licence texts, the first that fits decides. The last four are the notes met in prose.
SIGNATURES = (
    (r"(?i)GNU AFFERO GENERAL PUBLIC LICENSE\s+Version 3", "AGPL-3.0"),
    (r"(?i)GNU LESSER GENERAL PUBLIC LICENSE\s+Version 3", "LGPL-3.0"),
    (r"(?i)GNU LESSER GENERAL PUBLIC LICENSE\s+Version 2\.1", "LGPL-2.1"),
    (r"(?i)GNU GENERAL PUBLIC LICENSE,?\s+Version 3", "GPL-3.0"),
    (r"(?i)GNU GENERAL PUBLIC LICENSE,?\s+Version 2", "GPL-2.0"),
    (r"(?i)Apache License,?\s+Version 2\.0", "Apache-2.0"),
    (r"(?i)Mozilla Public License,? Version 2\.0", "MPL-2.0"),
    (r"(?i)Eclipse Public License - v ?2\.0", "EPL-2.0"),
    (r"(?i)Server Side Public License", "SSPL-1.0"),
    (r"(?i)Business Source License", "BUSL-1.1"),
    (r"(?i)Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"),
    (r"(?i)Redistributions of source code must retain[\s\S]{0,400}Neither the name", "BSD-3-Clause"),
    (r"(?i)Redistributions of source code must retain", "BSD-2-Clause"),
    (r"(?i)Permission to use, copy, modify, and/or distribute this software", "ISC"),
    (r"(?i)This is free and unencumbered software released into the public domain", "Unlicense"),
    (r"(?i)under the MIT License", "MIT"),
    (r"(?i)under CC BY-NC", "CC-BY-NC"),
)


def by_text(text: Column) -> Column:
    """The identifier of the first signature in the text, or null."""
    case = F.when(text.rlike(SIGNATURES[0][0]), SIGNATURES[0][1])
    for pattern, spdx in SIGNATURES[1:]:
        case = case.when(text.rlike(pattern), spdx)
    return case


def normal_spdx(spdx: Column) -> Column:
    """The identifier without -only, -or-later and +, in the spelling of the table; others as they are."""
    bare = F.regexp_replace(F.trim(spdx), r"(?i)(-only|-or-later|\+)$", "")
    case = F.when(F.upper(bare).isin("NOASSERTION", "NONE", ""), F.lit(None).cast("string"))
    for name in CATEGORY:
        case = case.when(F.lower(bare) == name.lower(), name)
    return case.otherwise(bare)


def category(spdx: Column) -> Column:
    case = F.when(spdx.isNull(), "none")
    for kind in dict.fromkeys(CATEGORY.values()):
        case = case.when(spdx.isin(*[k for k, v in CATEGORY.items() if v == kind]), kind)
    return case.otherwise("unknown")


def _look(kind: Column, table: dict[str, int]) -> Column:
    case = F.lit(None).cast("int")
    for k, v in table.items():
        case = F.when(kind == k, v).otherwise(case)
    return case


def strictness(kind: Column) -> Column:
    return _look(kind, STRICTNESS)


def score(kind: Column, open_source: bool = False) -> Column:
    return _look(kind, {k: v[0 if open_source else 1] for k, v in SCORE.items()})


def compatible(kind: Column, distribution: str) -> Column:
    """true, false or unclear for a way to distribute: internal, closed, service or open."""
    bad = {"internal": (), "closed": ("strong-copyleft", "network-copyleft", "proprietary"), "service": ("network-copyleft", "proprietary"), "open": ("proprietary",)}[distribution]
    return F.when(kind.isin("unknown", "none"), "unclear").when(kind.isin(*bad), "false").otherwise("true")


def strictest(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, strictest, risk, n_kinds): the strictest category of each group and its band."""
    rank = strictness(F.col(kind))
    got = rows.groupBy(group).agg(F.max(F.struct(rank.alias("r"), F.col(kind).alias("k"))).alias("m"), F.countDistinct(kind).alias("n_kinds"))
    risk = F.when(F.col("m.r") >= 8, "high").when(F.col("m.r") >= 4, "medium").otherwise("low")
    return got.select(group, F.col("m.k").alias("strictest"), risk.alias("risk"), "n_kinds")


def conflicts(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, conflict, severity) for each problem that a group's categories make."""
    has = lambda *k: F.max(F.col(kind).isin(*k))
    got = rows.groupBy(group).agg(has("strong-copyleft", "network-copyleft").alias("copyleft"), has("permissive", "public-domain").alias("permissive"), has("proprietary").alias("proprietary"), has("unknown", "none").alias("unknown"))
    found = F.array_compact(F.array(
        F.when(F.col("copyleft") & F.col("permissive"), F.struct(F.lit("copyleft-with-permissive").alias("conflict"), F.lit("high").alias("severity"))),
        F.when(F.col("proprietary"), F.struct(F.lit("proprietary").alias("conflict"), F.lit("high").alias("severity"))),
        F.when(F.col("unknown"), F.struct(F.lit("unknown").alias("conflict"), F.lit("caution").alias("severity"))),
    ))
    return got.select(group, F.explode(found).alias("x")).select(group, "x.*")
