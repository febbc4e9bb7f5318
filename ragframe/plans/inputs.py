"""The inputs of the registered queries, made from the driver's tables; each with the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import name_hash
from ..operators.ingest import chunk_fixed, split_lines

EVERY = 100  # vec_ids divisible by this ask; all are stores' chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents"), "doc_id")


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


def marked_lines(spark, sf_dir) -> DataFrame:
    """Lines with the markup that the page sources have, by line number."""
    n = F.col("line_no")
    text = (
        F.when(n % 11 == 0, F.concat(F.lit("# "), F.col("line")))
        .when(n % 11 == 2, F.concat(F.lit("## "), F.col("line")))
        .when(n % 11 == 4, F.concat(F.lit("#### "), F.col("line")))
        .when(n % 13 == 5, "```")
        .when(n % 13 == 7, F.concat(F.lit("```{literalinclude} f"), (F.col("doc_id") + 1).cast("string"), F.lit(".txt")))
        .when(n % 17 == 6, ":width: 80%")
        .when(n % 17 == 8, F.concat(F.lit("(sec"), F.col("doc_id").cast("string"), F.lit("_"), n.cast("string"), F.lit(")=")))
        .when(n % 17 == 9, F.concat(F.lit("{ref}`see <sec"), F.col("doc_id").cast("string"), F.lit("_8>` and {cite}`"), F.col("line"), F.lit("` <sec1_8>")))
        .when(n % 17 == 10, F.concat(F.lit("{note} "), F.col("line")))
        .otherwise(F.col("line"))
    )
    return lines(spark, sf_dir).select(F.col("doc_id").alias("file_ord"), F.concat(F.when(F.col("doc_id") % 7 == 0, "Schemas/p").otherwise("book/p"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "line_no", text.alias("line"))


MARKED = LINES + """,
marked AS (
  SELECT doc_id AS file_ord, (CASE WHEN doc_id % 7 = 0 THEN 'Schemas/p' ELSE 'book/p' END) || doc_id || '.md' AS path, line_no,
    CASE WHEN line_no % 11 = 0 THEN '# ' || line WHEN line_no % 11 = 2 THEN '## ' || line WHEN line_no % 11 = 4 THEN '#### ' || line
         WHEN line_no % 13 = 5 THEN '```' WHEN line_no % 13 = 7 THEN '```{literalinclude} f' || (doc_id + 1) || '.txt'
         WHEN line_no % 17 = 6 THEN ':width: 80%' WHEN line_no % 17 = 8 THEN '(sec' || doc_id || '_' || line_no || ')='
         WHEN line_no % 17 = 9 THEN '{ref}`see <sec' || doc_id || '_8>` and {cite}`' || line || '` <sec1_8>'
         WHEN line_no % 17 = 10 THEN '{note} ' || line ELSE line END AS line
  FROM lines)"""


def files(spark, sf_dir) -> DataFrame:
    exts = F.array(*map(F.lit, [".md", ".MARKDOWN", ".txt", ".html", "", ".xyz"]))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("store"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.element_at(exts, (F.col("doc_id") % 6 + 1).cast("int"))).alias("file_name"))


FILES = "files AS (SELECT doc_id, text, source AS store, 'doc_' || doc_id || ['.md', '.MARKDOWN', '.txt', '.html', '', '.xyz'][doc_id % 6 + 1] AS file_name FROM documents)"


def md_files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", F.col("source").alias("store"), name.alias("file_name"), name_hash(name).alias("file_hash"))


def known_files(spark, sf_dir) -> DataFrame:
    """Files that are in the store: the labelled documents."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_semi").select(F.col("source").alias("store"), name_hash(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("file_hash"))


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("label").alias("store"), F.col("vec_id").alias("chunk_id"), "embedding")


def chunks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return chunk_fixed(d.select("doc_id", "source", "text")).select(F.col("source").alias("store"), (F.col("doc_id") * 1_000_000 + F.col("chunk_ix")).alias("chunk_id"), F.col("chunk").alias("text"))


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def summaries(spark, sf_dir) -> DataFrame:
    """A state for every other conversation, as if a summary had been made."""
    c = messages(spark, sf_dir).where("conv_id % 2 = 0").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.select("conv_id", F.concat(F.lit("summary "), F.col("conv_id").cast("string")).alias("context_summary"), F.floor(F.col("n") / 3).cast("long").alias("summarised_till"))


SUMMARIES = "state AS (SELECT conv_id, 'summary ' || conv_id AS context_summary, count(*) // 3 AS summarised_till FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id)"


def grades(spark, sf_dir) -> DataFrame:
    """Grades made of line items' numbers."""
    steps = F.array(*map(F.lit, ["continue", "retrieve_more_info", "modify_query", "rewrite_answer", "undefined"]))
    g = lambda c, m: F.round(F.col(c) / m, 2)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 6 + 5).cast("int").alias("k"),
        F.struct(g("l_quantity", 50.0).alias("confidence"), F.round(F.col("l_discount") * 10, 2).alias("coverage"), F.round(F.col("l_tax") * 12.5, 2).alias("relevance"),
                 F.round((F.col("l_partkey") % 100) / 100.0, 2).alias("groundedness"), F.round((F.col("l_suppkey") % 10) / 10.0, 2).alias("coherence"),
                 F.round((F.col("l_orderkey") % 20) / 20.0, 2).alias("conciseness"), F.element_at(steps, (F.col("l_partkey") % 5 + 1).cast("int")).alias("next_step")).alias("e"),
    )


GRADES = """grades AS (
  SELECT l_orderkey, l_linenumber, (l_orderkey % 6 + 5)::INT AS k, round(l_quantity / 50.0, 2) AS confidence, round(l_discount * 10, 2) AS coverage, round(l_tax * 12.5, 2) AS relevance,
         round((l_partkey % 100)::DOUBLE / 100, 2) AS groundedness, round((l_suppkey % 10)::DOUBLE / 10, 2) AS coherence, round((l_orderkey % 20)::DOUBLE / 20, 2) AS conciseness,
         ['continue', 'retrieve_more_info', 'modify_query', 'rewrite_answer', 'undefined'][l_partkey % 5 + 1] AS next_step
  FROM lineitem)"""


def outputs(spark, sf_dir) -> DataFrame:
    """Model outputs of many shapes, made of documents."""
    i, t = F.col("doc_id"), F.col("text")
    plain = F.regexp_replace(t, r'["\\\x00-\x1F]', " ")
    body = (
        F.when(i % 7 == 0, F.concat(F.lit('{"query_type": "domain_question", "note": "'), plain, F.lit('"}')))
        .when(i % 7 == 1, " general_question\n").when(i % 7 == 2, F.concat(F.lit('{"query_type": "other"}'))).when(i % 7 == 3, "{broken").when(i % 7 == 4, F.concat(F.lit("  "), t, F.lit(" \n")))
        .when(i % 7 == 5, '{"note": "x"}').otherwise("domain_code_generation")
    )
    content = F.when(i % 3 == 0, F.concat(F.lit("<think>"), plain, F.lit("</think>"), body)).when(i % 3 == 1, body).otherwise(F.concat(F.lit("a</think>\n"), body, F.lit("</think>"), plain))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


OUTPUTS = """outputs AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>' || plain || '</think>' || body WHEN 1 THEN body ELSE 'a</think>' || chr(10) || body || '</think>' || plain END AS content
  FROM (SELECT doc_id, plain, CASE doc_id % 7 WHEN 0 THEN '{"query_type": "domain_question", "note": "' || plain || '"}' WHEN 1 THEN ' general_question' || chr(10) WHEN 2 THEN '{"query_type": "other"}'
          WHEN 3 THEN '{broken' WHEN 4 THEN '  ' || t || ' ' || chr(10) WHEN 5 THEN '{"note": "x"}' ELSE 'domain_code_generation' END AS body
        FROM (SELECT doc_id, text AS t, regexp_replace(text, '["\\\\\\x00-\\x1F]', ' ', 'g') AS plain FROM documents)))"""


def questions(spark, sf_dir) -> DataFrame:
    """First turns, some with the domain word and a verb of making."""
    i = F.col("conv_id")
    first = messages(spark, sf_dir).where("turn = 0")
    q = F.when(i % 4 == 0, F.concat(F.lit("What is the Domain of "), F.col("text"))).when(i % 4 == 1, F.concat(F.lit("please WRITE code for the domain: "), F.col("text"))).when(i % 4 == 2, F.col("text")).otherwise(" ")
    return first.select(i.alias("qid"), q.alias("query"))


QUESTIONS_SQL = """questions AS (
  SELECT conv_id AS qid, CASE conv_id % 4 WHEN 0 THEN 'What is the Domain of ' || text WHEN 1 THEN 'please WRITE code for the domain: ' || text WHEN 2 THEN text ELSE ' ' END AS query
  FROM conversations WHERE turn = 0)"""


def models(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, ["ollama:bge-m3", "huggingface:org/name/part:cheapest", "HuggingFace:org/x", "huggingface:plain:fastest", "local:model:1", "Ollama:q"]))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("model"))


MODELS = "models AS (SELECT doc_id, source, ['ollama:bge-m3', 'huggingface:org/name/part:cheapest', 'HuggingFace:org/x', 'huggingface:plain:fastest', 'local:model:1', 'Ollama:q'][doc_id % 6 + 1] AS model FROM documents)"
