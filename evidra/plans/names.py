"""Queries about names, keys, paths and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.operators import matching, pool, profiles, safety
from evidra.plans.literals import values
from evidra.plans.reads import _at, _pick
from evidra.sources import symbols
from evidra.sources.tables import table


def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat(_pick(key, "awesome-", "my", "", "go_"), F.replace("p_name", F.lit(" "), F.lit("-")), _pick(key, "-android", "lib", ".js", "", "-sdk"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.plain_name(name).alias("plain"))


def feature_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"), tx.topic_or_null(F.col("text")).alias("topic"))


def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat(_pick(key, "test_", "", "Should", "get"), F.replace("p_name", F.lit(" "), F.lit("_")), _pick(key, "Manager", "HTTPClient", "-spec"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.split_identifier(name).alias("words"), tx.looks_like_test(name).alias("test"), tx.describe_test(name).alias("told"))


DEPENDENCIES = ("libs.okhttp", "libs.androidx.core.ktx", "androidx.room.ktx:room-runtime", "org.slf4j:slf4j-api", "ch.qos.logback:logback-classic", "@types/node", "date-fns", "io.ktor:ktor_client", "a:b", "axios")


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(F.col("s_suppkey"), *DEPENDENCIES).alias("name"))
    return rows.select("s_suppkey", F.array_join(F.array_sort(tx.identity_keys(F.col("name"))), "|").alias("keys"), tx.dependency_name(F.col("name")).alias("name"))


def compact_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", tx.compact_requirement(F.col("text")).alias("query"), tx.capability_label(F.col("text"), F.col("text"), F.lit("a-b")).alias("label"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is around the first comma of a document, on one line."""
    at = F.position(F.lit(","), F.col("text"))
    return table(spark, sf_dir, "documents").filter(at > 0).select("doc_id", tx.excerpt(F.col("text"), at, F.lit(1)).alias("around"))


def json_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.estimate_json_tokens(F.struct("p_partkey", "p_name", "p_size")).alias("tokens"))


def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.cache_key(F.lit("search"), tx.query_key(F.concat_ws(" ", "p_type", "p_name")), F.col("p_brand")).alias("key"))


def hidden_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), _pick(F.col("turn"), "", "​‍", "\U000e0041", "‮"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.regexp_count(text, F.lit(safety.HIDDEN)).cast("long").alias("hidden"))


def head_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before the first qualifier of a benchmark item's stemmed words."""
    return table(spark, sf_dir, "benchmark").select("item_id", matching.head_end(F.col("text")).cast("long").alias("head_end"))


def mean_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return profiles.mean_depth(rows, "host", "path").select("host", tx.half_up(F.col("mean_depth"), 2).alias("mean_depth"))


def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 50 tokens at a line's end; a first line that doesn't fit is cut hard."""
    return table(spark, sf_dir, "documents").select("doc_id", pool.truncated(F.col("text"), 50).alias("text"))


def relaxed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_name"), _pick(F.col("p_partkey"), "one two", "topic:x", "three")).alias("query"))
    return matching.relaxed(rows, "query").select("p_partkey", F.col("drop"), "variant")


def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(_pick(key, "src/", "test/", "demo/", "src/data/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", path.alias("path"))
    return rows.select("p_partkey", F.round(symbols.path_score(F.col("path"), ["data", "red", "small"]) * 10).cast("long").alias("tenths"))


QUERIES = {f.__name__: f for f in (
    plain_names, feature_slugs, identifier_words, identity_keys, compact_requirements, excerpts, json_tokens, search_keys, hidden_characters, head_clauses, mean_depths, truncated_texts, relaxed_queries,
    file_scores,
)}

_PLAIN = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[-_.]', '', 'g'), '^(awesome|simple|easy|my|the|go|py|js|ts|kt)', ''), '(lib|library|sdk|kit|android|ios|js|ts|kt|py|go|java|swift|demo|example|sample|clone|fork|mirror)$', '')"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: cast(ascii(c) as bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, cast(2166136261 as bigint))"
_IDENT = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_.\\-/]+', ' ', 'g')))"
_STEM_ONE = "case when regexp_matches(w, '^.{2,}ies$') then regexp_replace(w, 'ies$', 'y') else regexp_replace(w, '^(.{4,}?)(ings|ing|ers|er|ed|es|s)$', '\\1') end"
_STEMMED = f"list_transform(list_filter(string_split({_NORM.format('text')}, ' '), lambda w: w <> ''), lambda w: case when length({_STEM_ONE}) >= 5 then regexp_replace({_STEM_ONE}, 'e$', '') else {_STEM_ONE} end)"
_STOPS = ", ".join(f"'{w}'" for w in tx.QUERY_STOP)
_KEYS = {"libs.okhttp": "okhttp", "libs.androidx.core.ktx": "androidx|androidx.core.ktx", "androidx.room.ktx:room-runtime": "androidx.room.ktx|room", "org.slf4j:slf4j-api": "ch.qos.logback|log4j|logback|org.apache.logging.log4j|org.slf4j|slf4j",
         "ch.qos.logback:logback-classic": "ch.qos.logback|logback|org.slf4j|slf4j", "@types/node": "@types", "date-fns": "date", "io.ktor:ktor_client": "io.ktor|ktor", "a:b": "a", "axios": "axios"}
_SHORT = {"@types/node": "node", "date-fns": "date-fns", "axios": "axios", "libs.okhttp": "libs.okhttp", "libs.androidx.core.ktx": "libs.androidx.core.ktx"}
SQL = {
    "plain_names": f"select p_partkey, {_PLAIN.format(_at('p_partkey', 'awesome-', 'my', '', 'go_') + chr(32) + '|| replace(p_name, chr(32), chr(45)) ||' + _at('p_partkey', '-android', 'lib', '.js', '', '-sdk'))} as plain from part",
    "feature_slugs": f"""with f as (select doc_id, replace({_NORM.format('text')}, ' ', '-') as f, replace({_NORM.format('text')}, ' ', '-') as t from documents),
        c as (select *, regexp_replace(case when contains(left(f, 32), '-') then regexp_extract(left(f, 32), '^(.*)-', 1) else left(f, 32) end, '-+$', '') as head from f)
        select doc_id, case when f = '' then 'feature' when length(f) <= 40 then f else case when head = '' then left(f, 32) else head end || '-' || left(lower(to_base({_FNV.format('f')}, 36)), 6) end as slug,
               case when length(t) between 3 and 35 then t end as topic from c""",
    "identifier_words": f"""with n as (select p_partkey, {_at('p_partkey', 'test_', '', 'Should', 'get')} || replace(p_name, ' ', '_') || {_at('p_partkey', 'Manager', 'HTTPClient', '-spec')} as n from part), w as (select *, {_IDENT.format('n')} as w from n),
        c as (select *, trim(regexp_replace(w, '^(test|it|should|when|given)\\s+', '')) as c from w)
        select p_partkey, w as words, regexp_matches(lower(n), '^(test|it|should|when|given)|(test|spec)$') as test, case when c <> '' then upper(left(c, 1)) || substr(c, 2) else n end as told from c""",
    "identity_keys": f"select s_suppkey, k.keys, k.name from supplier join {values([(n, _KEYS[n], _SHORT.get(n, n.split(':')[-1])) for n in DEPENDENCIES], 'dep, keys, name').replace(' as t(', ' as k(')} on dep = {_at('s_suppkey', *DEPENDENCIES)}",
    "compact_requirements": f"""select item_id, nullif(array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 and w not in ({_STOPS})), 1, 4), ' '), '') as query, true as label from benchmark""",
    "excerpts": "select doc_id, left(trim(regexp_replace(substr(text, greatest(1, strpos(text, ',') - 20), strpos(text, ',') - greatest(1, strpos(text, ',') - 20) + 21), '\\s+', ' ', 'g')), 120) as around from documents where strpos(text, ',') > 0",
    "json_tokens": """select p_partkey, cast(greatest(1, ceil(length('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}') / 3.2e0)) as bigint) as tokens from part""",
    "search_keys": "select p_partkey, 'search:' || sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(trim(p_type || ' ' || p_name)), '\\s+'), lambda w: w <> ''))), ' ') || chr(31) || p_brand) as key from part",
    "hidden_characters": "select conv_id || '-' || turn as key, case turn % 4 when 0 then 0 when 1 then 2 else 1 end + length(text) - length(regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}\\x{E0000}-\\x{E007F}]', '', 'g')) as hidden from conversations",
    "head_clauses": f"""with s as (select item_id, {_STEMMED} as ws from benchmark), p as (select item_id, len(ws) as n, list_filter(range(1, len(ws) + 1), lambda i: ws[i] in ({', '.join(f"'{q}'" for q in matching.QUALIFIERS)})) as hits from s)
        select item_id, coalesce(hits[1] - 1, n) as head_end from p""",
    "mean_depths": "with p as (select regexp_extract(url, '://([^/]*)', 1) as host, regexp_replace(url, '^[a-z]+://', '') as path from pages) select host, floor(avg(len(string_split(path, '/'))) * 100e0 + 0.5e0) / 100e0 as mean_depth from p group by 1",
    "truncated_texts": """with t as (select doc_id, text, greatest(1, ceil(length(text) / 4e0 + (length(text) - length(replace(text, chr(10), ''))) * 0.3e0)) as whole from documents),
        l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
        c as (select doc_id, line, n, sum(greatest(1, ceil((length(line) + 1) / 4e0 + 0.3e0))) over (partition by doc_id order by n) as upto from l),
        k as (select doc_id, string_agg(line, chr(10) order by n) as kept from c where upto <= 50 group by 1)
        select doc_id, case when length(text) = 0 or whole <= 50 then text else coalesce(kept, left(text, 200)) || chr(10) || '… [truncated]' end as text from t left join k using (doc_id)""",
    "relaxed_queries": f"""with q as (select p_partkey, lower(p_name) || ' ' || {_at('p_partkey', 'one two', 'topic:x', 'three')} as q from part), d as (select p_partkey, q, string_split(q, ' ') as parts, cast(unnest([0, 1, 2]) as integer) as "drop" from q)
        select p_partkey, "drop", array_to_string(list_slice(parts, 1, len(parts) - "drop"), ' ') as variant from d where "drop" = 0 or (len(parts) - "drop" >= 2 and not contains(q, ':'))""",
    "file_scores": f"""with p as (select p_partkey, {_at('p_partkey', 'src/', 'test/', 'demo/', 'src/data/')} || replace(lower(p_name), ' ', '_') || '.py' as path from part), f as (select *, string_split(path, '/')[-1] as file from p),
        s as (select p_partkey, path, {' + '.join(f"case when contains(file, '{t}') then 4 when contains(path, '{t}') then 2 else 0 end" for t in ('data', 'red', 'small'))} as s from f)
        select p_partkey, cast(case when starts_with(path, 'test/') then s * 4 when starts_with(path, 'demo/') then s * 3 else s * 10 end as bigint) as tenths from s""",
}
