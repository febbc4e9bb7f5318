"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing of sources, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents:

- language_id keeps the documents whose language the model tells and sets lang to it; texts without a letter go.
- line_dedup removes later copies of repeated line runs; documents that lose every line go; n_chars is counted anew.
- near_dedup keeps one document (the smallest doc_id) of each near-duplicate group.
- mix_sources emits each document as often as its source's rate says.
- pack returns one row for each piece of a document, with its place in a sequence.

The order is given. Line dedup comes first, so of a near copy it leaves the lines that differ; what is left is no near copy
of anything, and stays.

Defined cases: an empty table gives an empty result; a null text or one without a letter goes in the first stage; a null id
is an id like any other, last in order, and rows without one are told apart by their texts; rows that agree in id and text
are cut alike, and one of them stays; the smaller id, then the smaller text hash, decides ties; columns beyond those of
documents pass through all stages but the last, whatever their names: a stage works on the columns that it knows and on one
struct that carries the row.
DuckDB has neither the hashes nor the tokenizer of these stages, so the pipeline is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragframe.llm import langid, lines, mix, pack, simhash
from ragframe.llm.common import saved


#: Columns that stages know; all others are carried.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = "carried_row"


def carrying(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage applied to the known columns and one struct of all others, so that no name can clash with the stage's own."""
    names, plain = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    known = [F.col(f"c{names.index(k)}").alias(k) for k in KNOWN if k in names]
    others = [f"c{i}" for i, n in enumerate(names) if n not in KNOWN]
    out = stage(plain.select(*known, *([F.struct(*others).alias(CARRIED)] if others else [])))
    return out.select(*[F.col(n) if n in KNOWN else F.col(CARRIED)[f"c{i}"].alias(n) for i, n in enumerate(names)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(rows: DataFrame) -> DataFrame:
        found = langid.predicted(rows, rows.columns, ("told", "score"))
        return found.where(F.col("told") != langid.UND).withColumn("lang", F.col("told"))

    return carrying(docs, stage)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return carrying(docs, lines.deduped)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return carrying(docs, simhash.one_of_each)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return carrying(docs, mix.mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.packed_documents(docs.toDF(*[c if c in KNOWN else f"c{i}" for i, c in enumerate(docs.columns)]))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
