"""Exact top-k search in an impact-ordered index, score at a time (Anh and Moffat 2006, Lin and Trotman 2015).

Components are floor(256 * x). A component's impact is quantised to levels of STEP; a dimension's postings are ordered
by level, so that a (dimension, level) segment is a slice. A query takes all segments whose largest contribution
(query component times a bound of the level) is above a falling limit: every component not seen yet contributes less
than that limit, so seen contributions plus limit * unseen count bound each score from above. The exact scores of the
best accumulators give a threshold; vectors whose bound is below it are proven out. When the rest is a small share
(or all segments are done), the rest is rescored exactly: nothing is dropped without proof.

The index is a table of blocks of rows, each proven by itself; only a block's best leave it.

Defined cases: see vectors.cleaned (all-zero vectors do take part); rows that share an id are candidates each, and
queries each; vectors of different lengths don't meet; ties go to the smaller id; fewer candidates than asked for give
fewer rows; components of any size are scored exactly, and a score beyond a long is the largest or smallest long; an
empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import table
from .vectors import TOP, best, cleaned, none_found, searched

SCALE, STEP = 256, 8
#: Limits of the rounds, as shares of the largest contribution; share of a block that is rescored rather than narrowed.
LIMITS, RESCORED, PROBES = (0.2, 0.05, 0.0, -0.03, -0.08), 0.1, 32


class ImpactIndex:
    def __init__(self, x: np.ndarray):
        self.x = x
        self.n, self.d = x.shape
        level = np.floor_divide(x, STEP)
        self.order = np.argsort(-level, axis=0, kind="stable").T.astype(np.int32).copy()  # largest level first
        self.levels = np.take_along_axis(level, self.order.T.astype(np.int64), 0).T.copy() * STEP
        self.rising = -self.levels

    def _slices(self, q: np.ndarray, limit: float) -> np.ndarray:
        """For each dimension, how many of its postings (from its best end) may contribute above the limit."""
        out = np.zeros(self.d, np.int64)
        for d, c in enumerate(q.tolist()):
            if c > 0:  # c * (level + STEP - 1) > limit
                out[d] = self.rising[d].searchsorted(math.ceil(STEP - 1 - limit / c), side="left")
            elif c < 0:  # from the low end: c * level > limit
                out[d] = self.n - self.rising[d].searchsorted(math.floor(-limit / c), side="right")
            elif limit < 0:
                out[d] = self.n
        return out

    def members(self, q: np.ndarray, own: np.ndarray, top: int = TOP) -> np.ndarray:
        """Rows that may be among the top, proven; own: rows that don't count."""
        if self.n - len(own) <= 4 * PROBES:
            return np.setdiff1d(np.arange(self.n), own)
        # Bound of what was seen, times unit, plus the number of components seen: one addition for both.
        both = np.zeros(self.n, np.int64)
        bits = int(self.d).bit_length()
        unit = 1 << bits
        done = np.zeros(self.d, np.int64)
        most = float(np.maximum(q * (self.levels[:, 0] + STEP - 1), q * self.levels[:, -1]).max(initial=1))
        alive = np.ones(self.n, bool)
        alive[own] = False
        for share in LIMITS:
            limit = share * most
            to = np.maximum(done, self._slices(q, limit))
            for d in np.flatnonzero(to > done).tolist():
                c, a, b = int(q[d]), int(done[d]), int(to[d])
                part = slice(a, b) if c >= 0 else slice(self.n - b, self.n - a)
                both[self.order[d, part]] += self.levels[d, part] * (c * unit) + ((c * (STEP - 1) if c > 0 else 0) * unit + 1)
            done = to
            bound = (both >> bits) + math.ceil(limit) * (self.d - (both & (unit - 1)))
            bound[~alive] = np.iinfo(np.int64).min
            probe = np.argpartition(-bound, PROBES)[:PROBES]
            exact = np.sort(self.x[probe] @ q)
            maybe = np.flatnonzero(bound >= exact[-top])
            if len(maybe) <= max(4 * PROBES, RESCORED * self.n) or (done == self.n).all():
                break
        return maybe


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 * x); as Python's integers where a long is too small."""
    x = np.floor(SCALE * v)
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 2**53 else np.array([[int(c) if np.isfinite(c) else SCALE * int(o) for c, o in zip(r, w)] for r, w in zip(x, v)], object).reshape(x.shape)


class Block:
    """The index of some rows; without one, if scores could leave 62 bits: then all rows are scored with Python's integers."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray):
        x = quantised(rows)
        self.ids, self.numbers, self.x = ids, numbers, x
        self.index = ImpactIndex(x) if x.dtype != object and self._most(x) < 2**31 else None

    @staticmethod
    def _most(x: np.ndarray) -> float:
        """So large that the product of two such numbers bounds what the search computes."""
        return (float(np.abs(x).max(initial=0)) + STEP) * (2 * x.shape[1] + 2)

    def best(self, number: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.index is not None and q.dtype != object and self._most(q[None, :]) < 2**31:
            some = self.index.members(q, np.flatnonzero(self.numbers == number))
            return best(self.ids[some], self.x[some] @ q)
        some = np.flatnonzero(self.numbers != number)
        exact = (self.x[some].astype(object) @ q.astype(object)).tolist()
        return best(self.ids[some], np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64))


def top_scores(clean: DataFrame, n: int) -> DataFrame:
    """The search among vectors of one dimension."""

    def ask(block: Block, numbers: np.ndarray, queries: np.ndarray):
        for q, v in zip(numbers.tolist(), quantised(queries)):
            yield q, *block.best(q, v)

    return searched(clean, n, Block, ask, "long")


def scores(vectors: DataFrame) -> DataFrame:
    """query, query_id, rank, vec_id, score: the highest scores of each query; each dimension has an index of its own."""
    clean, dims = cleaned(vectors, zero=True)
    return reduce(DataFrame.unionByName, [top_scores(clean.where(F.size("v") == d), n) for d, n in dims], none_found(vectors.sparkSession, "long"))


def op3_impact_topk(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")
