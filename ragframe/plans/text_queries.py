"""Scalar, list, map and JSON functions: each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X, tools as T
from . import inputs as I
from .ingest_queries import TRIM

_PLAIN = TRIM.format("CASE WHEN contains(content, '</think>') THEN split_part(content, '</think>', 2) ELSE content END")
_LABELS = ", ".join(f"'{x}'" for x in X.QUERY_TYPES)


def strip_thoughts(spark, d):
    return I.outputs(spark, d).select("doc_id", X.strip_thoughts(F.col("content")).alias("answer"), X.thought(F.col("content")).alias("thought"))


STRIP = f"WITH {I.OUTPUTS} SELECT doc_id, {_PLAIN} AS answer, CASE WHEN contains(content, '</think>') THEN {TRIM.format(chr(115) + 'plit_part(content, ' + chr(39) + '</think>' + chr(39) + ', 1)')} END AS thought FROM outputs"


def parse_json(spark, d):
    k = X.parse_json(F.col("props"), "k long, missing string", {"k": -1, "missing": "none"})
    return I.table(spark, d, "events").select("event_id", k["k"].cast("long").alias("k"), k["missing"].alias("missing"))


PARSE = "SELECT event_id, coalesce((props->>'k')::BIGINT, -1) AS k, coalesce(props->>'missing', 'none') AS missing FROM events"


def coerce_output(spark, d):
    return I.outputs(spark, d).select("doc_id", X.coerce_output(F.col("content")).alias("label"))


COERCE = f"""WITH {I.OUTPUTS}, p AS (SELECT doc_id, {_PLAIN} AS plain FROM outputs),
l AS (SELECT doc_id, coalesce(CASE WHEN json_valid(plain) THEN json_extract_string(plain, '$.query_type') END, plain) AS label FROM p)
SELECT doc_id, CASE WHEN label IN ({_LABELS}) THEN label ELSE 'undefined' END AS label FROM l"""


def enum_check(spark, d):
    return I.table(spark, d, "orders").select("o_orderkey", X.enum_check(F.col("o_orderstatus"), ("O", "F")).alias("status"))


ENUM = "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'undefined' END AS status FROM orders"


def contains_ci(spark, d):
    return I.table(spark, d, "documents").select("doc_id", X.contains_ci(F.col("text"), "The ").alias("hit"))


CONTAINS = "SELECT doc_id, contains(lower(text), 'the ') AS hit FROM documents"


def starts_with(spark, d):
    return I.table(spark, d, "pages").select("page_id", X.starts_with_ci(F.col("url"), "HTTPS:").alias("secure"))


STARTS = "SELECT page_id, starts_with(lower(url), 'https:') AS secure FROM pages"


def split_fixed(spark, d):
    p = X.split_fixed(F.col("model"))
    return I.models(spark, d).select("doc_id", F.get(p, 0).alias("provider"), F.get(p, 1).alias("name"), F.get(p, 2).alias("routing"))


SPLIT = f"WITH {I.MODELS}, s AS (SELECT doc_id, string_split(model, ':') AS p FROM models) SELECT doc_id, CASE WHEN len(p) = 3 THEN p[1] END AS provider, CASE WHEN len(p) = 3 THEN p[2] END AS name, CASE WHEN len(p) = 3 THEN p[3] END AS routing FROM s"


def replace_join(spark, d):
    p = F.split(F.replace("url", F.lit("http://"), F.lit("https://")), "/", -1)
    return I.table(spark, d, "pages").select("page_id", F.array_join(F.slice(p, 3, 2), "_").alias("name"))


REPLACE = "SELECT page_id, array_to_string(string_split(replace(url, 'http://', 'https://'), '/')[3:4], '_') AS name FROM pages"


def default_if_null(spark, d):
    v = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.col("source"))
    return I.table(spark, d, "documents").select("doc_id", X.default_if_null(v, "none").alias("value"))


DEFAULTS = "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN coalesce(nullif(source, ''), 'none') ELSE 'none' END AS value FROM documents"


def doc_summary(spark, d):
    t = F.concat(F.lit("  "), "text", F.when(F.col("doc_id") % 2 == 0, "\n\n:param x: y\n:param z: w").otherwise(" \n"))
    return I.table(spark, d, "documents").select("doc_id", X.doc_summary(t).alias("summary"))


SUMMARY = f"WITH t AS (SELECT doc_id, '  ' || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || ':param x: y' || chr(10) || ':param z: w' ELSE ' ' || chr(10) END AS t FROM documents) SELECT doc_id, {TRIM.format('string_split(t, ' + chr(39) + ':param' + chr(39) + ')[1]')} AS summary FROM t"


def render_tools(spark, d):
    t = I.table(spark, d, "pages").select(
        (F.col("page_id") + 1).cast("int").alias("ord"), F.concat(F.lit("t"), F.col("page_id").cast("string"), F.lit("_tool")).alias("name"),
        F.concat(F.col("url"), F.lit(" :param a: b")).alias("description"), F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("int"), F.lit("a"), F.lit("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("args"),
    )
    return t.select("ord", T.tool_text(F.col("ord"), F.col("name"), F.col("description"), F.col("args")).alias("text"))


RENDER = f"SELECT (page_id + 1)::INT AS ord, '## ' || (page_id + 1) || '. t' || page_id || '_tool' || chr(10) || {TRIM.format('url')} || CASE WHEN page_id % 2 = 0 THEN ' Inputs:' || chr(10) || '- a: string' || chr(10) || '- b: int' || chr(10) ELSE '' END AS text FROM pages"


def word_count(spark, d):
    return I.messages(spark, d).select("conv_id", "turn", X.word_count(F.col("text")).alias("n_words"))


WORD_COUNT = "SELECT conv_id, turn, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_words FROM conversations"


def strip_spaces(spark, d):
    return I.table(spark, d, "part").select("p_partkey", X.strip_spaces(F.col("p_name")).alias("name"))


STRIP_SPACES = "SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part"


def escape_braces(spark, d):
    return I.table(spark, d, "events").select("event_id", X.escape_braces(F.col("props")).alias("text"))


ESCAPE = "SELECT event_id, replace(replace(props, '{', '{{'), '}', '}}') AS text FROM events"


def negative_slice(spark, d):
    m = I.messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return m.select("conv_id", F.array_join(X.last_n(F.col("turns"), 3), ",").alias("last"))


SLICE = "SELECT conv_id, array_to_string(list(turn ORDER BY turn)[-3:], ',') AS last FROM conversations GROUP BY conv_id"


def map_update(spark, d):
    a = F.create_map(F.lit("store"), F.col("source"), F.lit("lang"), F.lit("?"))
    b = F.create_map(F.lit("lang"), F.col("lang"), F.lit("id"), F.col("doc_id").cast("string"))
    m = X.map_update(a, b)
    return I.table(spark, d, "documents").select("doc_id", F.map_keys(m)[0].alias("first"), m["lang"].alias("lang"), m["id"].alias("id"), F.size(m).alias("n"))


MAP_UPDATE = "SELECT doc_id, 'store' AS first, lang, doc_id::VARCHAR AS id, 3 AS n FROM documents"

QUERIES = {
    "strip_thoughts": (strip_thoughts, STRIP), "parse_json": (parse_json, PARSE), "coerce_output": (coerce_output, COERCE), "enum_check": (enum_check, ENUM), "contains_ci": (contains_ci, CONTAINS), "starts_with": (starts_with, STARTS), "split_fixed": (split_fixed, SPLIT),
    "replace_join": (replace_join, REPLACE), "default_if_null": (default_if_null, DEFAULTS), "doc_summary": (doc_summary, SUMMARY), "render_tools": (render_tools, RENDER), "word_count": (word_count, WORD_COUNT), "strip_spaces": (strip_spaces, STRIP_SPACES),
    "escape_braces": (escape_braces, ESCAPE), "negative_slice": (negative_slice, SLICE), "map_update": (map_update, MAP_UPDATE),
}
