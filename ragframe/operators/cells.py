"""A clustered vector store: chunks dealt to the cells of a k-means partition, searched by a probe list.

    <path>/vectors/cell=.../block=.../   store, chunk_id, embedding; a cell of many rows has several blocks
    <path>/cells/                        cell, centre, reach (largest angle between the centre and a vector), n_rows, n_blocks

Vectors and centres lie on the unit sphere, where angles obey the triangle inequality: no vector of a cell is nearer to a
question than the angle to the cell's centre less the cell's reach. A search probes each question's nearest cells first. The
approximate mode ends there. The exact mode takes the k-th best score of each store as a bound, or the threshold where a store
has fewer, and visits in a second pass the cells that can still hold a hit that matters. Both read only probed partitions.

Tasks score one block against the questions that probe it, so memory is bounded by a block and its questions, which come in
batches; hits are at most k a question, store and block. Centres (at most MOST_CELLS x dimension doubles) are all that is
broadcast, and they are fitted on a sample of at most FIT rows; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT
from ..sources.shared import saved
from .retrieve import _best, _matrix

#: Rows that centres are fitted on, most cells, rows of a block, questions that meet a block at a time.
FIT, MOST_CELLS, BLOCK, ASKED = 65_536, 4096, 16_384, 2048
#: Visits that a task hands on at a time, each with its question's vector: the exact mode can have a question visit most cells.
PROBED = 8192
ROUNDS, SEED = 12, 7
#: Angles are computed with an error far below this; scores count at 6 decimals.
SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ centres.T, -1.0, 1.0))


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centres of spherical k-means over unit vectors; a cell that loses all its vectors takes one of the worst placed."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        of = near.argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centres)) == 0)
        total[empty] = sample[near.max(axis=1).argsort()[: len(empty)]]
        centres = _unit(total)
    return centres


@dataclass(frozen=True)
class Cells:
    """A clustered store that was built under a path."""

    spark: SparkSession
    path: str

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")


def build(chunks: DataFrame, path: str, cells: int | None = None, fit: int = FIT) -> Cells:
    """chunks (store, chunk_id, embedding) -> a clustered store; null, empty and zero vectors never hit and are left out. All have one dimension. cells: by default the square root of the rows."""
    spark = chunks.sparkSession
    fine = chunks.select("store", "chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.exists("embedding", lambda x: x != 0))
    n = fine.count()
    k = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    order = F.xxhash64("store", "chunk_id", F.lit(SEED))
    sample = fine.where(F.pmod(order, F.lit(max(1, n // fit))) == 0).orderBy(order, "chunk_id").limit(fit)
    centres = fitted(_unit(np.array([r["embedding"] for r in sample.select("embedding").collect()], np.float64).reshape(min(n, sample.count()), -1)), k) if n else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)
    kind = dict(fine.dtypes)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            angle = _angles(_unit(_matrix(b["embedding"])), shared.value)
            at = angle.argmin(axis=1)
            yield b.assign(cell=at.astype(np.int32), angle=angle[np.arange(len(b)), at])

    placed = saved(fine.mapInPandas(dealt, f"store {kind['store']}, chunk_id {kind['chunk_id']}, embedding array<double>, cell int, angle double"), "cells-placed")
    about = saved(placed.groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n_rows")).withColumn("n_blocks", F.ceil(F.col("n_rows") / BLOCK).cast("int")), "cells-about")
    block = F.pmod(F.xxhash64("chunk_id", "store"), F.col("n_blocks")).cast("int")
    stored = placed.join(F.broadcast(about.select("cell", "n_blocks")), "cell").withColumn("block", block)  # at most MOST_CELLS rows
    written = stored.select("store", "chunk_id", "embedding", "cell", "block").repartition("cell", "block").write.mode("overwrite")
    (written.partitionBy("cell", "block") if n else written).parquet(f"{path}/vectors")  # without rows a schema is left
    centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    centre.join(about, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return Cells(spark, path)


def _probed(asked: DataFrame, about: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], probes: int, exact: bool) -> DataFrame:
    """qid, embedding, cell, block: each question's nearest cells; or, with bounds and done (the angle of the last cell probed), the others that can hold what beats the bound."""
    shared = asked.sparkSession.sparkContext.broadcast(about)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, centres, reach, blocks = shared.value
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                angle = _angles(_matrix(part["embedding"]), centres)
                order = np.lexsort((np.broadcast_to(cells, angle.shape), angle), axis=1)
                first = np.zeros(angle.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                if exact:
                    best = np.cos(np.maximum(0.0, angle - reach - SLACK))
                    first = ~first & (best >= part["bound"].to_numpy()[:, None] - SLACK)
                q, c = np.nonzero(first)
                n = blocks[c].astype(np.int64)
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, c = np.repeat(q, n), np.repeat(c, n)
                for at in range(0, len(q), PROBED):
                    some = slice(at, at + PROBED)
                    yield pd.DataFrame({"qid": part["qid"].to_numpy()[q[some]], "embedding": part["embedding"].to_numpy()[q[some]], "cell": cells[c[some]], "block": block[some].astype(np.int32)})

    return asked.mapInPandas(run, f"qid {dict(asked.dtypes)['qid']}, embedding array<double>, cell int, block int")


def _scored(index: Cells, probed: DataFrame, k: int, threshold: float, cells: list[int]) -> DataFrame:
    """The k best over the threshold of each (question, store) in each block, only the cells named being read."""
    vectors = index.vectors().where(F.col("cell").isin(cells))
    schema = f"qid long, store {dict(vectors.dtypes)['store']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, score double"
    none = {"qid": "int64", "store": "object", "chunk_id": "int64", "score": "float64"}

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in none.items()})]
        found += _best(a["qid"].to_numpy(), _matrix(a["embedding"]), b["chunk_id"].to_numpy(), b["store"].to_numpy(), _matrix(b["embedding"]), k, threshold) if len(a) else []
        return pd.concat(found)

    # Of a block's many questions ASKED at a time: each such batch meets the block once more.
    batches = saved(probed.groupBy("cell", "block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("batches")), "cells-batches")
    left = probed.join(batches, ["cell", "block"]).withColumn("batch", F.pmod(F.xxhash64("qid"), F.col("batches")).cast("int")).drop("batches")
    right = vectors.join(batches, ["cell", "block"]).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")
    keys = ["cell", "block", "batch"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def search(index: Cells, questions: DataFrame, k: int = DEFAULT.k, threshold: float = DEFAULT.threshold, probes: int = 8, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """questions (qid unique, embedding) -> hits (qid, store, chunk_id, score, rank), as vector_topk gives them if exact; and the visits (qid, pass, cell)."""
    about = index.cells().orderBy("cell").collect()  # at most MOST_CELLS rows
    rows = [np.array([r[c] for r in about], t) for c, t in (("cell", np.int32), ("centre", np.float64), ("reach", np.float64), ("n_blocks", np.int32))]

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=list(_unit(_matrix(b["embedding"]))))

    fine = questions.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    asked = saved(fine.mapInPandas(unit, f"qid {dict(questions.dtypes)['qid']}, embedding array<double>"), "cells-asked")
    w = Window.partitionBy("qid", "store").orderBy(F.desc("score"), "chunk_id")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not about:
        none = index.vectors()
        return none.select(F.lit(0).cast("long").alias("qid"), "store", "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0), asked.select("qid", F.lit(1).alias("pass"), F.lit(0).alias("cell")).limit(0)

    def visit(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
        probed = saved(probed, "cells-probed")
        cells = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most MOST_CELLS
        return saved(_scored(index, probed, k, threshold, cells), "cells-hits"), probed.select("qid", "cell").distinct()

    hits, first = visit(_probed(asked, tuple(rows), probes, False))
    visits = first.select("qid", F.lit(1).alias("pass"), "cell")
    if exact:
        stores = index.vectors().select("store").distinct().count()
        kth = ranked(hits).where(F.col("rank") == k).groupBy("qid").agg(F.count("*").alias("full"), F.min("score").alias("least"))
        bound = F.when(F.col("full") == stores, F.greatest(F.col("least"), F.lit(threshold))).otherwise(F.lit(float(threshold)))
        bounded = asked.join(kth, "qid", "left").select("qid", "embedding", bound.alias("bound"))
        more, second = visit(_probed(bounded, tuple(rows), probes, True))
        hits, visits = hits.unionByName(more), visits.unionByName(second.select("qid", F.lit(2).alias("pass"), "cell"))
    return ranked(hits).select("qid", "store", "chunk_id", "score", "rank"), visits
