"""What the files of finalists tell, one row a repository: what accompanies the code, dependencies, symbols, signs of a library or an application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators import profiles
from evidra.operators.lineage import cut, small
from evidra.operators.membership import Members
from evidra.sources import manifests, symbols

# Signs of a library and of an application: in paths, in manifests, in what a repository says of itself.
LIBRARY_PATHS = (r"(?i)(^|/)(gradle/libs\.versions\.toml)$", r"(?i)(^|/)(api|public)/.*\.api$", r"(?i)(^|/)\.api/")
APP_PATHS = (
    r"(?i)(^|/)Dockerfile$", r"(?i)(^|/)docker-compose\.ya?ml$", r"(?i)(^|/)(fastlane|Fastfile)", r"(?i)(^|/)(screenshots?|fastlane/metadata)/",
    r"(?i)(^|/)\.github/workflows/.*(deploy|release-app|publish-app)", r"(?i)(^|/)(k8s|kubernetes|helm|terraform)/", r"(?i)(^|/)(procfile|vercel\.json|netlify\.toml|app\.yaml)$",
)
PUBLISHED = (
    r"(?i)\bmaven-publish\b|\bcom\.vanniktech\.maven\.publish\b|\bsigning\b.*\bpublish", r"(?i)\bpublishing\s*\{", r"""(?i)\bapply\s+plugin:\s*['"]com\.jfrog\.bintray['"]""", r'(?i)"private"\s*:\s*false',
    r"(?i)\b(setuptools|poetry|hatchling|flit)\b", r"(?i)\[project\]|\[tool\.poetry\]", r"(?i)\bcrate-type\b|\[lib\]", r"(?i)\bs\.summary\b|\bspec\.summary\b", r"(?i)\bproducts:\s*\[[\s\S]{0,200}\.library\(",
    r"(?m)^\s*module\s+[\w./-]+", r"(?i)<packaging>\s*(jar|bundle)\s*</packaging>|<groupId>[\s\S]{0,400}<artifactId>", r'(?i)"type"\s*:\s*"library"|"autoload"\s*:', r"(?i)\bGem::Specification\b|\bspec\.add_dependency\b",
    r"(?i)<GeneratePackageOnBuild>|<PackageId>|<IsPackable>\s*true",
)
APP_BUILDS = (r"(?i)\bapplicationId\s*[=\s]", r"(?i)\bcom\.android\.application\b", r"(?i)\[\[bin\]\]|\bsrc/main\.rs\b", r"(?i)\bexecutable\(", r'(?i)"bin"\s*:', r"(?i)<OutputType>\s*Exe\s*</OutputType>")
LIBRARY_WORDS = r"\b(library|libraries|sdk|framework|toolkit|wrapper|binding|plugin|package)\b|\bclient (library|sdk)\b"
APP_WORDS = r"\b(app|application|android-app|ios-app|demo|sample|example|tutorial|starter|boilerplate|template|clone|portfolio)\b"
EXAMPLE_WORDS = r"\b(demo|sample|example|tutorial|starter|boilerplate|playground)\b"
DEMO_MODULE = r"(?i)^(app|sample|samples|sampleapp|demo|demos|example|examples|playground|server|web|website|site|backend|frontend|desktop|cli|bot|daemon|service)$|app$"
MODULE_FILE = r"^([^/]+)/build\.gradle(\.kts)?$"
INSTALLED = r"""(?i)\bimplementation\s*\(?["']|\bnpm i(nstall)?\s+[\w@/-]|\bpip install\s+[\w-]"""
# Classes by which others come in, and files of code.
ENTRANCE = r"(?i)manager|service|client|facade|api|provider|factory|builder"
CODE = r"\.(kt|java|ts|tsx|js|jsx|py|rs|go|swift|cs|rb|php|scala|dart)$"
#: Manifests whose text is looked at, and how much of each.
MANIFEST_TEXTS, TEXT_CHARS = 3, 20_000


def files_of(names: DataFrame, files: DataFrame) -> DataFrame:
    """The files of the repositories in names (full_name): a filter of a fixed size passes over the others before any join."""
    wanted = cut(names.select("full_name").distinct())
    return Members(wanted, "full_name").passing(files, "full_name").join(small(wanted), "full_name", "left_semi")


def facts(names: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each repository in names with files (full_name, path, content).

    (full_name, those of profiles.quality, readme, mean_depth, runtime (names of dependencies; null without a manifest),
    manifest_text, symbols and kinds (arrays), points (places to come in), library_paths, app_paths, modules (of gradle)).
    Each table is one aggregate over the files of finalists; files of others are not read past the filter.
    """
    own = cut(files_of(names, files).select("full_name", "path", F.coalesce("content", F.lit("")).alias("content")))
    hits = lambda patterns: sum((F.max(F.col("path").rlike(p)).cast("int") for p in patterns), F.lit(0))
    module = F.nullif(F.regexp_extract("path", MODULE_FILE, 1), F.lit(""))
    paths = own.groupBy("full_name").agg(
        hits(LIBRARY_PATHS).alias("library_paths"), hits(APP_PATHS).alias("app_paths"), F.array_sort(F.collect_set(module)).alias("modules"),
        F.array_join(F.array_sort(F.collect_list("path")), " ").alias("paths"),
    )
    readme = own.filter(F.col("path").rlike(r"(?i)^readme(\.|$)")).groupBy("full_name").agg(F.min_by("content", "path").alias("readme"))
    found = cut(manifests.find_manifests(own, "full_name", "path", "path"))
    declared = manifests.dependencies(found, "path", "content").withColumn("low", F.lower("name"))
    best = manifests.best_declaration(declared, ["full_name", "ecosystem", "low"], "depth").filter(manifests.runs(F.col("scope")))
    ordered = lambda c, by: F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c])
    read = found.groupBy("full_name").agg(F.array_join(F.transform(F.slice(ordered("content", "place"), 1, MANIFEST_TEXTS), lambda t: F.left(t, F.lit(TEXT_CHARS))), "\n").alias("manifest_text"))
    runtime = best.groupBy("full_name").agg(F.array_sort(F.collect_list("name")).alias("names"))
    read = read.join(runtime, "full_name", "left").select("full_name", "manifest_text", F.coalesce("names", F.expr("cast(array() as array<string>)")).alias("runtime"))
    code = symbols.declarations(own.filter(F.col("path").rlike(CODE)), ["full_name", "path"], "content")
    entrance = (F.col("kind") == "interface") | ((F.col("kind") == "class") & F.col("name").rlike(ENTRANCE))
    named = code.groupBy("full_name").agg(F.array_sort(F.collect_list("name")).alias("symbols"), F.greatest(F.lit(1), F.count_if(entrance)).alias("points"))
    got = profiles.quality(own, "full_name", "path")
    for part in (paths, readme, profiles.mean_depth(own, "full_name", "path"), read, named):
        got = got.join(part, "full_name", "left")
    return got


def library_signs(said: Column) -> Column:
    """struct(library, application, signs, example): points of either side from a row of facts, and what the repository says of itself."""
    any_of = lambda patterns: F.coalesce(*[F.when(F.col("manifest_text").rlike(p), True) for p in patterns], F.lit(False))
    own = F.size(F.filter("modules", lambda m: ~m.rlike(DEMO_MODULE)))
    demos = F.size("modules") - own
    words = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]+", " "), r"\s+", " "))
    signs = [  # test, points for a library, points for an application
        (any_of(PUBLISHED), 3.0, 0.0),
        (any_of(APP_BUILDS) & ~((own > 0) & (demos > 0)), 0.0, 3.0),
        (own > 0, 2.0, 0.0),
        ((own == 0) & (demos > 0), 0.0, 2.5),
        (words.rlike(LIBRARY_WORDS), 1.5, 0.0),
        (words.rlike(APP_WORDS), 0.0, 1.5),
        (F.col("readme").rlike(INSTALLED), 2.0, 0.0),
    ]
    met = [(F.coalesce(t, F.lit(False)).cast("int"), a, b) for t, a, b in signs]
    of = lambda c: F.coalesce(c, F.lit(0))
    library = sum((t * a for t, a, _ in met), of("library_paths") * 1.0)
    application = sum((t * b for t, _, b in met), of("app_paths") * 1.5)
    count = sum((t for t, _, _ in met), of("library_paths") + of("app_paths"))
    return F.struct(library.alias("library"), application.alias("application"), count.alias("signs"), words.rlike(EXAMPLE_WORDS).alias("example"))
