"""Approximate nearest neighbours by a permutation index (Chavez et al. 2008, Amato et al. 2014).

PIVOTS pivots are drawn by hash from the vectors (a bounded sample). A vector is represented by its PREFIX nearest
pivots in order, and posted with its rank in each one's inverted file. A query goes through the files of its own
nearest pivots and accumulates, for the induced Spearman footrule with missing pivots at rank PREFIX, what each common
pivot saves against that maximum: 2 * (PREFIX - max(rank, rank)). The SHARE of a block's vectors of least footrule
distance, CANDIDATES at least, and all that are as near as the last of them, are compared exactly by cosine in double
precision. Equal vectors count as one, in the pivots and in a block's index; their smallest ids are all reported.

All rows are indexed; the index is a table of blocks of rows (each with its inverted files), so that memory is bounded
and candidates grow with the rows, whatever the cluster.

Defined cases: see vectors.cleaned; rows that share an id are candidates each, and queries each; vectors of different
lengths don't meet; ties go to the smaller id; fewer candidates than asked for give fewer rows; an empty table gives no
rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import table
from .vectors import TOP, best, cleaned, none_found, searched

PIVOTS, PREFIX, SHARE, CANDIDATES = 256, 64, 0.08, 256


def pivots(clean: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """The vectors of least hash, as unit vectors; at most n, all different."""
    some = clean.groupBy(F.xxhash64("v", F.lit("pivot")).alias("h")).agg(F.min("v").alias("v")).orderBy("h").limit(n)
    p = np.array([r["v"] for r in some.orderBy("h").collect()])  # n at most
    return p / np.linalg.norm(p, axis=1, keepdims=True) if len(p) else p


def prefixes(unit: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    near = unit @ p.T
    part = np.argpartition(-near, length - 1, axis=1)[:, :length] if length < len(p) else np.broadcast_to(np.arange(len(p)), near.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)


class InvertedFiles:
    """For each pivot the vectors that have it in their prefix, with its rank there."""

    def __init__(self, prefix: np.ndarray, n_pivots: int):
        n, self.length = prefix.shape
        flat = prefix.ravel()
        order = np.argsort(flat, kind="stable")
        self.vectors, self.ranks = (order // self.length).astype(np.int32), (order % self.length).astype(np.int16)
        self.starts = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        self.n = n

    def nearness(self, prefix: np.ndarray) -> np.ndarray:
        """Half of what each vector saves against the largest footrule distance from a query of this prefix."""
        out = np.zeros(self.n, np.int32)
        for r, p in enumerate(prefix.tolist()):
            a, b = self.starts[p], self.starts[p + 1]
            out[self.vectors[a:b]] += self.length - np.maximum(self.ranks[a:b], r)
        return out


class Block:
    """The index of some rows. Equal vectors are indexed once; of each the TOP + 1 smallest ids are reported (one may be the query's own row)."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray, p: np.ndarray):
        rows = np.ascontiguousarray(rows + 0.0)  # -0.0 equals 0.0
        _, first, group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")  # ids ascend
        starts = np.searchsorted(group[order], np.arange(len(first)))
        kept = np.sort(order[np.arange(len(ids)) - starts[group[order]] <= TOP])
        self.n, self.rows, self.ids, self.numbers, self.group = len(ids), rows[first], ids[kept], numbers[kept], group[kept]
        self.norm = np.linalg.norm(self.rows, axis=1)
        self.alone = np.bincount(self.group) == 1
        self.files = InvertedFiles(prefixes(self.rows / self.norm[:, None], p, min(PREFIX, len(p))), len(p))

    def best(self, number: int, v: np.ndarray, prefix: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
        near = self.files.nearness(prefix)
        own = self.group[self.numbers == number]
        near[own[self.alone[own]]] = -1
        some = near >= (np.partition(near, len(near) - take)[len(near) - take] if take < len(near) else 0)
        scores = np.full(len(self.rows), -np.inf)
        scores[some] = np.einsum("ij,j->i", self.rows[some], v) / (self.norm[some] * np.linalg.norm(v))  # row by row: equal rows score alike
        which = some[self.group] & (self.numbers != number)
        return best(self.ids[which], scores[self.group[which]])


def nearest(clean: DataFrame, n: int, share: float = SHARE, candidates: int = CANDIDATES) -> DataFrame:
    """The search among vectors of one dimension."""
    p = pivots(clean)
    shared = clean.sparkSession.sparkContext.broadcast(p)

    def ask(block: Block, numbers: np.ndarray, queries: np.ndarray):
        take = max(candidates, int(np.ceil(share * block.n)))
        norms = np.linalg.norm(queries, axis=1, keepdims=True)
        for q, v, prefix in zip(numbers.tolist(), queries, prefixes(queries / norms, shared.value, min(PREFIX, len(p))) if len(queries) else ()):
            yield q, *block.best(q, v, prefix, take)

    return searched(clean, n, lambda ids, numbers, rows: Block(ids, numbers, rows, shared.value), ask, "double")


def op1_permutation_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame) -> DataFrame:
    """query, query_id, rank, vec_id, score: the nearest found of each query; each dimension has an index of its own."""
    clean, dims = cleaned(vectors)
    return reduce(DataFrame.unionByName, [nearest(clean.where(F.size("v") == d), n) for d, n in dims], none_found(vectors.sparkSession, "double"))
