"""What the vector searches share: vectors that take part, an index table of blocks, and passes of queries over it."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from ..sources.shared import shared_dir
from .common import saved

#: Every QUERY_EVERY-th id is a query.
QUERY_EVERY, TOP = 50, 5
#: Rows of an index block, and queries that go over the index in one pass (what is broadcast); both whatever the cluster.
ROW_BLOCK, QUERY_BLOCK = 8192, 16_384

#: (ids, numbers, vectors) of a block, ids ascending -> its index.
Build = Callable[[np.ndarray, np.ndarray, np.ndarray], Any]
#: (index, numbers, vectors) of queries -> (number of the query, ids, scores) of the best of the block.
Ask = Callable[[Any, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def cleaned(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = False) -> tuple[DataFrame, list[tuple[int, int]]]:
    """row (a number of each row's own), vec_id, v (array<double>) of the vectors that take part, saved; and (dimension, count) of them.

    No part is taken by null ids, and by vectors that are null or empty, hold null or non-finite components, or are all
    zero (unless zero). Rows that share an id take part each.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    if not zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    some = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    clean = saved(some.withColumn("row", F.monotonically_increasing_id()), "vectors")
    return clean, sorted((r["d"], r["count"]) for r in clean.groupBy(F.size("v").alias("d")).count().collect())


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy())


def searched(clean: DataFrame, n: int, build: Build, ask: Ask, kind: str, top: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """query (the row), query_id, rank, vec_id, score: the best `top` rows of each query among vectors of one dimension.

    Rows are dealt by hash to blocks of about ROW_BLOCK, each is indexed once, and the index is a table of its own. The
    queries go over it in passes: about QUERY_BLOCK of them are on the driver and in a broadcast at a time, each pass adds
    its rows to a table, and then its broadcast goes. Each block gives at most `top` rows a query.
    """
    spark = clean.sparkSession
    dealt = clean.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // ROW_BLOCK)))))

    def built(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        index = build(pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), _matrix(pdf["v"]))
        return pd.DataFrame({"block": [key[0]], "index": [pickle.dumps(index, protocol=5)]})

    blocks = saved(dealt.groupBy("block").applyInPandas(built, "block long, index binary"), "vector-index")
    asked = clean.where(F.pmod("vec_id", F.lit(every)) == 0)
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    nth = F.pmod(F.xxhash64("row", F.lit("pass")), F.lit(passes))
    path = f"{shared_dir(spark)}/vector-hits-{uuid.uuid4().hex}"
    schema = f"query long, query_id long, rank int, vec_id long, score {kind}"
    spark.createDataFrame([], schema).write.parquet(path)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    for i in range(passes):
        some = asked.where(nth == i).toArrow()
        if not len(some):
            continue
        numbers = some["row"].to_numpy()
        queries = some["v"].combine_chunks().flatten().to_numpy().reshape(len(numbers), -1)
        shared = spark.sparkContext.broadcast((numbers, some["vec_id"].to_numpy(), queries))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            numbers, names, queries = shared.value
            name = dict(zip(numbers.tolist(), names.tolist()))
            for b in batches:
                for blob in b["index"]:
                    rows = [(q, name[q], x, s) for q, ids, scores in ask(pickle.loads(blob), numbers, queries) for x, s in zip(ids.tolist(), scores.tolist())]
                    yield pd.DataFrame(rows, columns=["query", "query_id", "vec_id", "score"])

        found = blocks.mapInPandas(run, f"query long, query_id long, vec_id long, score {kind}").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        found.select(*[c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def best(ids: np.ndarray, scores: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The top of (ids, scores): largest score first, ties to the smaller id."""
    if len(ids) > 4 * top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, ~scores if scores.dtype.kind == "i" else -scores))[:top]  # ~ has no overflow
    return ids[order], scores[order]


def none_found(spark, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"query long, query_id long, rank int, vec_id long, score {kind}")
