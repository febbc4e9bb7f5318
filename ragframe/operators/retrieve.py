"""Vector retrieval: k best per store over a threshold, union of stores, global re-rank, context text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..config import DEFAULT
from ..functions.text import escape_braces
from ..sources.shared import saved, shared_dir

#: Questions up to this number are broadcast to the chunks' tasks at once; more in passes of about so many, whose hits are saved.
BROADCAST_QUESTIONS, QUESTION_BLOCK = 2048, 40_960
#: Hits up to this number are broadcast to the chunks when these give them their texts; of more, both sides are shuffled.
BROADCAST_HITS = 250_000
#: Chunks that a task scores at a time (fewer at first, so that bounds are there early), and best hits (16 bytes each) that it holds before it hands them on.
CHUNK_BLOCK, FIRST_BLOCK, HELD = 131_072, 2048, 10_000_000
#: Scores in single precision are off by far less than this; only those that near a bound are computed again, in double.
SLACK = 2e-5
#: Buckets of a question that is screened by sums of bytes; of more a matrix product is as fast.
MOST_BUCKETS = 12
#: Chunks that lie side by side: of those in one lane the greatest sum is looked at first.
LANES = 4096


def _best(qids, questions, ids, stores, chunks, k, threshold) -> Iterator[pd.DataFrame]:
    """Top k over the threshold of each (question, store) among these chunks, for 256 questions at a time; scores at 6 decimals."""
    if not len(ids) or not len(qids):
        return
    norm = np.linalg.norm(chunks, axis=1)
    fine = np.flatnonzero(norm > 0)
    names, code = np.unique(stores[fine], return_inverse=True)
    fine = fine[order := np.lexsort((ids[fine], code))]  # by store, then id: of equal scores the first is the smaller id
    cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
    ids, unit = ids[fine], chunks[fine] / norm[fine][:, None]
    for at in range(0, len(qids), 256):
        found = []
        for store, a, b in zip(names, cuts, cuts[1:]):
            score = np.round(questions[at : at + 256] @ unit[a:b].T, 6)
            least = np.full(len(score), threshold) if b - a <= k else np.maximum(threshold, np.partition(score, b - a - k, axis=1)[:, b - a - k])
            q, c = np.nonzero(score >= least[:, None])
            rank = np.lexsort((c, -score[q, c], q))  # with ties at the k-th place more than k may be left
            q, c = q[rank], c[rank]
            some = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, c = q[some], c[some]
            found.append(pd.DataFrame({"qid": qids[at + q], "store": store, "chunk_id": ids[a + c], "score": score[q, c]}))
        if found:
            yield pd.concat(found)


def _cosines(questions: np.ndarray, chunks: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of pairs of unit vectors, in double precision at 6 decimals."""
    return np.round(np.einsum("ij,ij->i", questions[q], chunks[c]), 6)


class _Held:
    """The k best hits so far of each question in one store: ids and scores, best first; -inf where there are fewer."""

    def __init__(self, n: int, k: int, threshold: float):
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.scores = np.full((n, k), -np.inf)
        self.least = np.full(n, float(threshold))  # what a further hit must reach

    def add(self, at: np.ndarray, unit: np.ndarray, single: np.ndarray, ids: np.ndarray, chunks: np.ndarray, narrow: np.ndarray, threshold: float, floor: np.ndarray) -> None:
        """Let chunks (unit vectors, also in single precision) meet the questions at these places. floor: what hits of all stores must reach (-inf if nothing)."""
        k = self.ids.shape[1]
        score = single[at] @ narrow.T
        bound = np.maximum(self.least[at], floor[at]) - SLACK
        fresh = np.flatnonzero(np.isinf(self.scores[at, -1]) & np.isinf(floor[at]))
        if len(ids) > k and len(fresh):  # no bound yet but the threshold: the block's own k-th best
            bound[fresh] = np.maximum(bound[fresh], np.partition(score[fresh], len(ids) - k, axis=1)[:, len(ids) - k] - 2 * SLACK)
        some = np.flatnonzero(score.max(axis=1) >= bound.astype(np.float32))  # most questions find nothing better in a block
        q, c = np.divmod(np.flatnonzero(score[some] >= bound[some, None].astype(np.float32)), len(ids))
        q = at[some[q]]
        for i in range(0, len(q), 1 << 16):  # as many pairs in double precision at a time
            self._merge(q[i : i + (1 << 16)], _cosines(unit, chunks, q[i : i + (1 << 16)], c[i : i + (1 << 16)]), ids[c[i : i + (1 << 16)]], threshold)

    def _merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, threshold: float) -> None:
        k = self.ids.shape[1]
        last, worst = self.scores[q, -1], self.ids[q, -1]
        better = (score >= threshold) & ((score > last) | ((score == last) & (ids < worst)))
        q, score, ids = q[better], score[better], ids[better]
        if not len(q):
            return
        mine = np.unique(q)
        q, score, ids = np.concatenate((np.repeat(mine, k), q)), np.concatenate((self.scores[mine].ravel(), score)), np.concatenate((self.ids[mine].ravel(), ids))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k  # k or more of each
        self.scores[mine], self.ids[mine] = score[kept].reshape(-1, k), ids[kept].reshape(-1, k)
        self.least[mine] = np.maximum(threshold, self.scores[mine, -1])

    def hits(self, qids: np.ndarray, store, floor: np.ndarray) -> pd.DataFrame:
        q, r = np.nonzero(np.isfinite(self.scores) & (self.scores >= floor[:, None]))
        return pd.DataFrame({"qid": qids[q], "store": store, "chunk_id": self.ids[q, r], "score": self.scores[q, r]})


def _raised(floor: np.ndarray, held: list[_Held], k: int, n: int, some: np.ndarray | None = None) -> np.ndarray:
    """The floor, raised to each question's n-th best score among the k best hits held of each store. some: only for the questions at these places."""
    k = min(k, held[0].scores.shape[1]) if held else 0
    if len(held) * k < n:
        return floor
    some, out = np.arange(len(floor)) if some is None else some, floor.copy()
    for at in range(0, len(some), 256):
        rows = some[at : at + 256]
        best = np.concatenate([h.scores[rows, :k] for h in held], axis=1)
        out[rows] = np.maximum(out[rows], np.partition(best, best.shape[1] - n, axis=1)[:, best.shape[1] - n])
    return out


def _counted(questions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their least component, and which of them are then whole numbers in few buckets, as those of short texts are."""
    some = (questions > 0).sum(axis=1)
    least = np.where(questions > 0, questions, np.inf).min(axis=1, initial=np.inf)
    counts = questions / np.where(np.isfinite(least), least, 1.0)[:, None]
    whole = np.rint(counts)
    fine = (questions >= 0).all(axis=1) & (some > 0) & (some <= MOST_BUCKETS) & (np.abs(counts - whole) < 1e-6).all(axis=1) & (whole.sum(axis=1) < 128)
    return np.where(fine[:, None], whole, 0).astype(np.int64), fine


class _Screen:
    """Upper bounds of cosines between questions of counts in few buckets and chunks without negative components, at a byte each.

    A chunk's components, times a count and a scale, are rounded up to bytes; a question's bound is the sum over its buckets,
    which fits a byte by the choice of the scale. Questions are taken in the order of their buckets, common ones first, so that
    those with the same first buckets share these sums. A sum of bytes costs a small part of a product of vectors, and few pairs
    near a bound remain for that.
    """

    def __init__(self, questions: np.ndarray):
        counts, self.fine = _counted(questions)
        self.norm = np.sqrt((counts * counts).sum(axis=1))
        q, d = np.nonzero(counts)
        used, word, n = np.unique(d * 128 + counts[q, d], return_inverse=True, return_counts=True)
        common = np.argsort(-n, kind="stable")
        self.words = [divmod(int(x), 128) for x in used[common]]  # (bucket, count) of each sum, common ones first
        word = np.argsort(common)[word]
        order = np.lexsort((word, q))
        cuts, word = np.searchsorted(q, np.arange(len(counts) + 1)), word[order]
        self.level = np.zeros(len(counts), np.int64)  # the scale is 2 ** (level / 4)
        some = np.flatnonzero(self.fine)
        self.level[some] = np.floor(4 * np.log2((254 - np.diff(cuts)[some]) / self.norm[some]))
        self.plan: dict[int, list[tuple[int, list[int], int]]] = {}  # of each level: place of a question, its words, how many it shares with the one before
        for level, words, i in sorted((int(self.level[i]), word[cuts[i] : cuts[i + 1]].tolist(), int(i)) for i in some):
            mine, shared = self.plan.setdefault(level, []), 0
            while mine and shared < min(len(words), len(mine[-1][1])) and words[shared] == mine[-1][1][shared]:
                shared += 1
            mine.append((i, words, shared))

    def near(self, across: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of questions and chunks whose cosine may reach the question's bound, some at a time. across: a row of each component of the chunks' unit vectors, in single precision; bound: inf for questions that are left out."""
        rows = -(-across.shape[1] // LANES)
        asked, least = np.isfinite(bound), np.full(len(bound), 256)  # above any sum
        least[asked] = np.maximum(1, np.ceil((bound - SLACK)[asked] * (self.norm * 2.0 ** (self.level / 4))[asked]))
        least, spare, best = least.tolist(), [np.empty((rows, LANES), np.uint8) for _ in range(MOST_BUCKETS)], np.empty(LANES, np.uint8)
        q, c, n = [], [], 0
        for level, plan in self.plan.items():
            columns: dict[int, np.ndarray] = {}
            for w in {w for i, words, _ in plan if least[i] <= 255 for w in words}:
                bucket, count = self.words[w]
                columns[w] = np.zeros((rows, LANES), np.uint8)
                columns[w].ravel()[: across.shape[1]] = np.ceil(across[bucket] * np.float32(count * 2.0 ** (level / 4)))
            sums, deep = [best] * MOST_BUCKETS, 0
            for i, words, shared in plan:
                deep = min(deep, shared)  # sums up to here are those of this question
                if least[i] > 255:
                    continue
                for j in range(deep, len(words)):
                    sums[j] = np.add(sums[j - 1], columns[words[j]], spare[j]) if j else columns[words[0]]
                deep = len(words)
                last, bar = sums[deep - 1], least[i]
                lanes = (np.maximum.reduce(last, 0, None, best) >= bar).nonzero()[0]
                if len(lanes):
                    row, lane = (last.take(lanes, 1) >= bar).nonzero()
                    q.append(i)
                    c.append(row * LANES + lanes[lane])
                    n += len(row)
                    if n >= 1 << 16:
                        yield np.repeat(q, [len(x) for x in c]), np.concatenate(c)
                        q, c, n = [], [], 0
        if q:
            yield np.repeat(q, [len(x) for x in c]), np.concatenate(c)


def _products(single: np.ndarray, narrow: np.ndarray, some: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _Screen.near, by matrix products that stay in the cache: for the questions at these places."""
    room, found, n = np.empty(256 * 4096, np.float32), [], 0
    for i in range(0, len(some), 256):
        at = some[i : i + 256]
        asked, least = single[at], (bound[at] - SLACK).astype(np.float32)
        for j in range(0, len(narrow), 4096):
            part = narrow[j : j + 4096]
            score = np.matmul(asked, part.T, out=room[: len(at) * len(part)].reshape(len(at), len(part)))
            few = np.flatnonzero(score.max(axis=1) >= least)  # most questions find nothing better in a block
            if len(few):
                q, c = np.divmod(np.flatnonzero(score[few] >= least[few, None]), len(part))
                found.append((at[few[q]], j + c))
                n += len(q)
            if n >= 1 << 16:
                yield tuple(map(np.concatenate, zip(*found)))
                found, n = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def _seeded(floor: np.ndarray, at: np.ndarray, single: np.ndarray, narrow: np.ndarray, cuts: np.ndarray, k: int, n: int, threshold: float) -> None:
    """Raise the floor of the questions at these places to just below their n-th best score over the threshold among the k best of each store in a block."""
    score = single[at] @ narrow.T
    best = np.concatenate([np.partition(score[:, a:b], max(0, b - a - k), axis=1)[:, max(0, b - a - k) :] for a, b in zip(cuts, cuts[1:])] + [np.zeros((len(at), 0), np.float32)], axis=1)
    if best.shape[1] >= n:
        nth = np.partition(best, best.shape[1] - n, axis=1)[:, best.shape[1] - n].astype(np.float64) - 2 * SLACK
        floor[at] = np.maximum(floor[at], np.where(nth >= threshold, nth, -np.inf))


def _best_of_task(qids: np.ndarray, questions: np.ndarray, batches: Iterator[pd.DataFrame], k: int, threshold: float, reach: tuple[int, int] | None = None) -> Iterator[pd.DataFrame]:
    """Top k over the threshold of each (question, store) among all chunks of a task, whatever the number of its batches; scores at 6 decimals.

    With reach (k, n) hits below the n-th best of the k best of each store are left out: other tasks can only raise that.
    A task that holds HELD hits hands them on and begins anew, so that many stores and questions don't fill its memory.
    """
    single, held, floor = questions.astype(np.float32), {}, np.full(len(qids), -np.inf)
    screen = _Screen(questions) if reach else None

    def room(store) -> Iterator[pd.DataFrame]:
        nonlocal held, floor
        if store not in held:
            if held and (len(held) + 1) * len(qids) * k > HELD:
                floor = _raised(floor, list(held.values()), *reach) if reach else floor
                yield from (h.hits(qids, s, floor) for s, h in held.items())
                held = {}
            held[store] = _Held(len(qids), k, threshold)

    for ids, stores, chunks in _blocks(batches):
        if not len(qids):
            continue
        norm = np.linalg.norm(chunks, axis=1)
        fine = np.flatnonzero((norm > 0) & np.isfinite(norm))
        code, names = pd.factorize(stores[fine], use_na_sentinel=False)
        fine = fine[order := np.argsort(code, kind="stable")]
        cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
        ids, unit = ids[fine], chunks[fine]
        unit /= norm[fine][:, None]
        del chunks
        narrow = unit.astype(np.float32)
        raised, fresh = [np.zeros(0, np.int64)], np.flatnonzero(np.isinf(floor)) if reach else []
        for at in range(0, len(fresh), 256):
            _seeded(floor, fresh[at : at + 256], single, narrow, cuts, min(k, reach[0]), reach[1], threshold)
        # Questions with a bound over all stores meet all stores at once, and most of them by way of the screen.
        others, bounded = np.flatnonzero(np.isinf(floor)), np.isfinite(floor)
        screened = bounded & screen.fine if screen and (narrow >= 0).all() else np.zeros(len(qids), bool)
        bound = np.maximum(floor, threshold)
        for store, a, b in zip(names, cuts, cuts[1:]) if len(others) else ():
            yield from room(store)
            for at in range(0, len(others), 256):
                held[store].add(others[at : at + 256], questions, single, ids[a:b], unit[a:b], narrow[a:b], threshold, floor)
        near = [screen.near(np.ascontiguousarray(narrow.T), np.where(screened, bound, np.inf))] if screened.any() else []
        for q, c in chain(*near, _products(single, narrow, np.flatnonzero(bounded & ~screened), bound)):
            for i in range(0, len(q), 1 << 16):  # as many pairs in double precision at a time
                some, at = q[i : i + (1 << 16)], c[i : i + (1 << 16)]
                score = _cosines(questions, unit, some, at)
                few = np.flatnonzero(score >= bound[some])
                few = few[np.argsort(at[few], kind="stable")]
                some, at, score = some[few], at[few], score[few]
                raised.append(np.unique(some))
                for store, a, b in zip(names, *np.searchsorted(at, (cuts[:-1], cuts[1:]))):
                    if a < b:
                        yield from room(store)
                        held[store]._merge(some[a:b], score[a:b], ids[at[a:b]], threshold)
        floor = _raised(floor, list(held.values()), *reach, np.unique(np.concatenate((others, *raised)))) if reach else floor
    yield from (h.hits(qids, s, floor) for s, h in held.items())


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, stores and vectors of about CHUNK_BLOCK chunks at a time, after smaller blocks that double."""
    some, n, size = [], 0, min(FIRST_BLOCK, CHUNK_BLOCK)

    def joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = tuple(map(np.concatenate, zip(*parts)))
        parts.clear()  # they go before the block is worked on
        return out

    for b in batches:
        ids, stores, vectors = _columns(b)
        for at in range(0, len(ids), FIRST_BLOCK):
            some.append((ids[at : at + FIRST_BLOCK], stores[at : at + FIRST_BLOCK], vectors[at : at + FIRST_BLOCK]))
            n += len(some[-1][0])
            if n >= size:
                yield joined(some)
                n, size = 0, min(CHUNK_BLOCK, 2 * size)
    if some:
        yield joined(some)


def _columns(b: pd.DataFrame | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, stores and vectors of a batch; those of an Arrow batch (arrays or bytes of doubles), which all have one length, are taken as they lie in memory."""
    if isinstance(b, pd.DataFrame):
        return b["chunk_id"].to_numpy(), b["store"].to_numpy(), _matrix(b["embedding"])
    ids, stores, vectors = b.column("chunk_id"), b.column("store"), b.column("embedding")
    if pa.types.is_binary(vectors.type):
        bounds = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(ids) + 1]
        flat = np.frombuffer(vectors.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.float64) if len(ids) else np.zeros(0)
        lengths = pa.array(np.diff(bounds) // 8)
    else:
        flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), pc.list_value_length(vectors)
    if pc.min_max(lengths).as_py() != {"min": (n := len(flat) // max(1, len(ids))), "max": n} and len(ids):
        raise ValueError("vectors of one search must have one length")
    return ids.to_numpy(zero_copy_only=False), stores.to_numpy(zero_copy_only=False), flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 0))


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = DEFAULT.k, threshold: float = DEFAULT.threshold, reach: tuple[int, int] | None = None) -> DataFrame:
    """questions (qid, embedding), chunks (store, chunk_id, embedding: an array, or packed by `embed`) -> qid, store, chunk_id, score, rank.

    Cosine in double precision, at 6 decimals before threshold and rank; ties to the smaller chunk_id; zero vectors
    never hit. Tasks score matrix blocks and keep k a question and store over all their chunks, so no pair table is
    built; only those rows are shuffled. There are at most as many tasks as cores, so that the hits that are shuffled
    grow with the questions alone, not with questions times chunks. Each task reads its chunks once, whatever the
    number of stores.

    reach: (least k, n) of a `reachable` that follows. Tasks then leave out hits below the n-th best of the k best of each
    store, which can't be reachable, so that they hand on some n a question instead of k a store; `reachable` finds the same
    rows with the same ranks. Without that step the ranks of the lowest hits may be too good.
    """
    size = lambda df: F.octet_length("embedding") if dict(df.dtypes)["embedding"] == "binary" else F.size("embedding")
    fine = lambda df: df.where(F.col("embedding").isNotNull() & (size(df) > 0))
    chunks, questions = fine(chunks.select("store", "chunk_id", "embedding")), fine(questions.select("qid", "embedding"))
    first = questions.limit(BROADCAST_QUESTIONS + 1).collect()
    if len(first) <= BROADCAST_QUESTIONS:
        return _topk(first, chunks, k, threshold, reach)[0]
    spark, path = chunks.sparkSession, f"{shared_dir(chunks.sparkSession)}/topk-{uuid.uuid4().hex}"
    questions = saved(questions, "topk-questions")
    passes = max(1, -(-questions.count() // QUESTION_BLOCK))
    schema = None
    for i in range(passes):
        some = questions.where(F.pmod(F.xxhash64("qid", F.lit("pass")), F.lit(passes)) == i).collect()
        hits, asked = _topk(some, chunks, k, threshold, reach)
        schema = hits.schema
        hits.write.mode("append").parquet(path)
        asked.destroy()
    return spark.read.schema(schema).parquet(path)


def distinct_topk(questions: DataFrame, chunks: DataFrame, k: int = DEFAULT.k, threshold: float = DEFAULT.threshold, reach: tuple[int, int] | None = None) -> DataFrame:
    """vector_topk for questions (qid unique) of which many may have equal vectors, as short queries do: each different vector is searched for once, and its hits go to all its questions."""
    questions = saved(questions.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("qid", "embedding"), "topk-asked")
    firsts = saved(questions.groupBy("embedding").agg(F.min("qid").alias("first")), "topk-distinct")
    hits = vector_topk(firsts.select(F.col("first").alias("qid"), "embedding"), chunks, k, threshold, reach)
    return hits.withColumnRenamed("qid", "first").join(questions.join(firsts, "embedding").select("qid", "first"), "first").select(*hits.columns)


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """hits (store, chunk_id, ...; saved) with the other columns of texts (store, chunk_id, ...)."""
    return (F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits).join(texts, ["store", "chunk_id"])


def _topk(rows: list, chunks: DataFrame, k: int, threshold: float, reach: tuple[int, int] | None = None) -> tuple[DataFrame, Broadcast]:
    """The hits of questions that are on the driver, and what was broadcast for them."""
    m = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["embedding"]) if rows else 0)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    asked = chunks.sparkSession.sparkContext.broadcast((np.array([r["qid"] for r in rows], np.int64), unit))

    def run(batches: Iterator[pa.RecordBatch]):
        (qids, q), first = asked.value, next(batches, None)
        for hits in _best_of_task(qids, q, chain([first], batches), k, threshold, reach) if first is not None else ():
            store = pa.array(hits["store"], first.schema.field("store").type)
            yield pa.RecordBatch.from_arrays([pa.array(hits["qid"]), store, pa.array(hits["chunk_id"]), pa.array(hits["score"])], names=["qid", "store", "chunk_id", "score"])

    tasks = max(1, chunks.sparkSession.sparkContext.defaultParallelism)
    hits = chunks.coalesce(tasks).mapInArrow(run, f"qid long, store {dict(chunks.dtypes)['store']}, chunk_id long, score double")
    w = Window.partitionBy("qid", "store").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), asked


def rerank_topn(hits: DataFrame, n: int = DEFAULT.max_references) -> DataFrame:
    """Best n over all stores of each question, renumbered."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "store", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def reachable(hits: DataFrame, k: int, k_max: int, n: int) -> DataFrame:
    """The hits (at k_max a store) that rerank_topn keeps for some k from k to k_max: of each question the best n among those of each such rank."""
    ahead = Window.partitionBy("qid").orderBy(F.desc("score"), "store", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = [(F.col("rank") <= i) & (F.count_if(F.col("rank") <= i).over(ahead) < n) for i in range(min(k, k_max), k_max + 1)]
    return hits.withColumn("__kept", reduce(lambda a, b: a | b, kept)).where("__kept").drop("__kept")


def union_stores(stores: list[DataFrame]) -> DataFrame:
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out


def upsert_reference(log: DataFrame) -> DataFrame:
    """log (conv_id, seq, retrieval_query, hits) -> the latest hits of each retrieval query, kept at its first place."""
    return log.groupBy("conv_id", "retrieval_query").agg(F.min("seq").alias("first_seq"), F.max_by("hits", "seq").alias("hits"))


def adapted_k(k: Column, inc: int = 1, k_max: int = DEFAULT.k_max) -> Column:
    """k + inc if that is within the maximum, else k."""
    return F.when(k + inc <= k_max, k + inc).otherwise(k)


def can_adapt(k: Column, inc: int = 1, k_max: int = DEFAULT.k_max) -> Column:
    return k + inc <= k_max


def header_fields(*heads: str) -> Column:
    return F.concat_ws(" | ", *[F.when(F.col(h).isNotNull(), F.concat(F.lit(f"Header {i}: "), F.col(h))) for i, h in enumerate(heads, 1)])


def serialize_context(hits: DataFrame, by: str = "conv_id") -> DataFrame:
    """hits (by, query_seq, retrieval_query, rank, fields, text) -> by, context: a heading for each query, then its numbered documents."""
    n = F.count("*").over(Window.partitionBy(by, "query_seq"))
    one = F.concat(F.lit("\n\n### Document "), F.col("rank").cast("string"), F.lit("/"), n.cast("string"), F.lit(": "), F.col("fields"), F.lit("\n\n:"), F.col("text"))
    lines = hits.withColumn("__t", one).groupBy(by, "query_seq", "retrieval_query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__t"))), lambda s: s["__t"]), "").alias("__d"))
    head = F.concat(F.lit("## "), F.col("retrieval_query"), F.lit("\n"), F.col("__d"))
    folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_seq", head.alias("t")))), lambda s: s["t"]), "")
    return lines.groupBy(by).agg(escape_braces(folded).alias("context"))
