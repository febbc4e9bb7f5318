"""LM scoring by a causal self-attention model over subword ids, beside an add-one unigram base over words.

Words: A-Z lower-cased, runs `[^\\x20\\x09-\\x0D]+`, then one end, counted as a token. The base counts every word of
every training document (crc32 of the id as text mod 7 is not 2). The model's subwords are those of a public tokenizer,
word by word; the counts over all training words give the ids it knows and start its output biases. Whole texts are
scored, in overlapping windows that predict each subword once.

Training. All training documents are cut into stretches of STRETCH words, and every different stretch is trained on, with the
start and the end of its document where it has them. About FIRST of them, by hash, give the first weights; all others go to
shards that train on from these, all at once, and whose weights are averaged by windows (Zinkevich et al. 2010), FAN at a time.

Memory. After a context of CONTEXT ids whose hash says so (one in MEMORY), the next BLOCK ids (up to the end) are one
draw from a mixture of the model and of what followed this context in the other training documents, all of which are
counted: with N such documents, D different blocks among them and n times this one, the mixture is
(D * model + n) / (N + D) (Witten and Bell 1991). A document's own counts are left out, and a context counts once a
document. So the model tells texts that the corpus has elsewhere from those that it has not.

Counts of the HEAD most frequent words are broadcast (a bounded table); all other words, and the memory, meet their
counts in joins.

Defined cases: null text counts as empty (the end alone); a null id counts as the empty id for the fold; repeated rows
each count and are scored each; without any training document all counts are zero and the model is untrained; an empty
table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .attention import BATCH, RATE, STEPS, STRIDE, Model, Vocabulary
from .common import in_parts, parts_of, saved, table

PIECES = "byte_bpe_multi_50k.tiktoken"
#: Words of a stretch, stretches of the first weights and how often they are gone through at most (if they are few), weights averaged at once.
STRETCH, FIRST, OFTEN, FAN = 32, 20_000, 4, 4
#: Stretches of a shard; smaller inputs have up to so many shards of SMALL stretches at least.
SHARD, SMALL, SHARDS = 131_072, 4096, 6
#: Windows that a shard trains on at once at most: as many as leave it ENOUGH steps. A step's rate grows with their square root.
WIDE, ENOUGH = 4 * BATCH, 100
#: Ids of a context, contexts for each that is remembered, ids of a remembered block.
CONTEXT, MEMORY, BLOCK = 8, 64, 16
#: Words whose counts are broadcast, and bytes of the longest such word.
HEAD, LONG = 150_000, 64
#: Ids scored together.
IDS = 1 << 18

_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in b"\x09\x0a\x0b\x0c\x0d" else c for c in range(256)], np.uint8)


class Words:
    """The words of some texts: `distinct` ones, `codes` of all in order, how many a text has, and where they stand in `low`."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null(b"").cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        self.low = _LOWER[data]
        solid = self.low != 0x20
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        some = np.diff(bounds) > 0
        begins[bounds[:-1][some]] = solid[bounds[:-1][some]]
        ends[bounds[1:][some] - 1] = solid[bounds[1:][some] - 1]
        self.begins, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.begins)))
        found = pa.Array.from_buffers(pa.large_binary(), len(self.begins), [None, pa.py_buffer(offsets), pa.py_buffer(self.low[solid])]).dictionary_encode()
        self.distinct, self.codes = found.dictionary.cast(pa.binary()), found.indices.to_numpy()
        self.count = np.diff(np.searchsorted(self.begins, bounds))


class Subwords:
    """Words (UTF-8) to subword ids."""

    def __init__(self, name: str = PIECES):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = tiktoken.Encoding("words", pat_str=r"\n| [^ \n]+", mergeable_ranks=ranks, special_tokens={})
        self.gap, self.size = ranks[b"\n"], max(ranks.values()) + 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, each led by a space; and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids = np.array(self.pieces.encode_ordinary((b" " + b"\n ".join(words)).decode("utf-8", "replace")), np.int32)
        gap = ids == self.gap
        at = np.flatnonzero(gap)
        return ids[~gap], np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1


_SUBWORDS: list[Subwords] = []


def subwords() -> Subwords:
    """One a worker process."""
    if not _SUBWORDS:
        _SUBWORDS.append(Subwords())
    return _SUBWORDS[0]


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of flat (of these sizes, one after the other) that the codes name, in order."""
    first, size = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    return flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: both act on ASCII alone


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """part (binary), kind, n, every, saved: kind 0 are the words with their number in training texts and in all; the others stretches to train on, 1 and 1 more at a document's start, 2 more at its end."""

    def run(batches):
        for b in batches:
            for a, e in parts_of(b.column(0)):
                w = Words(b.column(0).slice(a, e - a))
                train = ~b.column(1).to_numpy(zero_copy_only=False)[a:e]
                n, every = (np.bincount(c, minlength=len(w.distinct)).astype(np.int64) for c in (w.codes[np.repeat(train, w.count)], w.codes))
                yield pa.RecordBatch.from_arrays([w.distinct, pa.array(np.zeros(len(n), np.int8)), pa.array(n), pa.array(every)], names=["part", "kind", "n", "every"])
                many = np.where(train, -(-w.count // STRETCH), 0)
                nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                first = np.repeat(np.cumsum(w.count) - w.count, many) + nth * STRETCH
                last = np.minimum(first + STRETCH, np.repeat(np.cumsum(w.count), many)) - 1
                kind = 1 + (nth == 0) + 2 * (nth == np.repeat(many, many) - 1)
                cut = [w.low[x:y].tobytes() for x, y in zip(w.begins[first], w.ends[last])]
                one = pa.array(np.ones(len(cut), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array(kind.astype(np.int8)), one, one], names=["part", "kind", "n", "every"])

    parts = in_parts(docs.select(F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"))).mapInArrow(run, "part binary, kind byte, n long, every long")
    return saved(parts.groupBy("part", "kind").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "lm-words")


def frequent(counts: DataFrame) -> DataFrame:
    """The words whose counts are broadcast: all short ones from a count on, the least one that leaves at most HEAD of them."""
    counts = counts.where(F.octet_length("word") <= LONG)
    band = F.floor(F.log2("n") * 8).cast("int")
    found = sorted(((r["band"], r["k"]) for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("k")).collect()), reverse=True)  # a few hundred
    least, total = 1 << 30, 0
    for b, k in found:
        total += k
        if total > HEAD:
            break
        least = b
    return counts.where(band >= least)


def subword_counts(counts: DataFrame) -> dict[int, int]:
    """Count of each subword id over all counted words; at most as many as the vocabulary has."""

    def run(batches):
        total = np.zeros(subwords().size, np.int64)
        for b in batches:
            ids, sizes = subwords().encode(b.column(0).to_pylist())
            total += np.bincount(ids, np.repeat(b.column(1).to_numpy(), sizes), len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def _ids(v: Vocabulary, texts: list[bytes]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.binary()))
    flat, sizes = subwords().encode(w.distinct.to_pylist())
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), w.count), sizes[w.codes], len(texts))).astype(np.int64)
    return np.split(v.of[gathered(flat, sizes, w.codes)], ends[:-1]) if texts else []


def trained_on(model: Model, stretches: DataFrame) -> Model:
    """The model trained on every stretch (part, and kind if it may be at an end of its document) once at least; itself without stretches."""
    stretches = stretches if "kind" in stretches.columns else stretches.withColumn("kind", F.lit(1).cast("byte"))
    n = stretches.count()
    if not n:
        return model
    place = F.pmod(F.xxhash64("part", "kind"), F.lit(n))
    first = stretches.where(place < FIRST).withColumn("shard", F.lit(0).cast("long"))
    model = _averaged(model, first, 1, RATE, OFTEN)
    shards = max(min(SHARDS, -(-(n - FIRST) // SMALL)), -(-(n - FIRST) // SHARD))
    rest = stretches.where(place >= FIRST).withColumn("shard", F.pmod(F.xxhash64("part", F.lit("shard")), F.lit(shards)))
    return _averaged(model, rest, shards, RATE / 4, 1, WIDE) if shards > 0 else model


def _averaged(model: Model, stretches: DataFrame, shards: int, rate: float, often: int, wide: int = BATCH) -> Model:
    """The average of the models that shards of stretches (shard, part, kind) lead to."""
    spark, schema = stretches.sparkSession, "shard long, weight double, weights binary"
    shared = spark.sparkContext.broadcast(model)

    def learn(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        m, pdf = shared.value.with_weights(shared.value.flat()), pdf.sort_values(["part", "kind"])
        start, end = np.zeros(1, np.int32), np.ones(1, np.int32)
        ids = [np.concatenate((start[: (k - 1) & 1], x, end[: (k - 1) >> 1])) for x, k in zip(_ids(m.v, pdf["part"].tolist()), pdf["kind"])]
        total = sum(map(len, ids))
        batch = max(BATCH, min(wide, total // (STRIDE * ENOUGH)))
        m.train(ids * max(1, min(often, STEPS * BATCH * STRIDE // max(1, total))), steps=None, seed=int(key[0]), rate=rate * math.sqrt(batch / BATCH), whole=False, batch=batch, once=True)
        return pd.DataFrame({"shard": [key[0]], "weight": [float(total)], "weights": [m.flat().tobytes()]})

    def average(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        total = max(1.0, pdf["weight"].sum())
        out = sum(np.frombuffer(x, np.float32) * np.float32(w / total) for w, x in zip(pdf["weight"], pdf["weights"]))
        return pd.DataFrame({"shard": [key[0]], "weight": [total], "weights": [out.tobytes()]})

    # A partition for each shard: by size, or by ranges drawn from a sample, Spark would put some into one task, one after the other.
    dealt = stretches.withColumn("shard", F.col("shard").cast("int")).repartitionById(shards, "shard")
    found = saved(dealt.groupBy("shard").applyInPandas(learn, schema), "lm-shards")
    while shards > 1:
        shards = -(-shards // FAN)
        found = saved(found.withColumn("shard", F.pmod("shard", F.lit(shards))).groupBy("shard").applyInPandas(average, schema), "lm-shards")
    best = found.first()  # a hash may leave the first weights without a stretch
    return model.with_weights(np.frombuffer(best["weights"], np.float32)) if best else model


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(max(CONTEXT, BLOCK))], np.uint64)


def remembered(docs: list[np.ndarray], logs: np.ndarray, starts: np.ndarray) -> list[tuple[list[int], list[int], list[float]]]:
    """For each document of subword ids: contexts, the blocks that follow, and the model's log-probabilities of these blocks.

    Blocks don't overlap, and a context counts at its first place. logs: of every id and end; starts: each document's place in it.
    """
    flat = np.zeros(len(logs), np.uint64)  # an end is 0
    for s, d in zip(starts, docs):
        flat[s : s + len(d)] = d
        flat[s : s + len(d)] += np.uint64(1)
    h = np.zeros(len(flat), np.uint64)
    for i in range(CONTEXT):
        h[i + 1 :] += flat[: max(0, len(flat) - i - 1)] * _POWERS[i]
    h = _mixed(h)
    lengths = np.array([len(d) for d in docs], np.int64)
    owner = np.repeat(np.arange(len(docs)), lengths + 1)
    some = np.flatnonzero(h % np.uint64(MEMORY) == 0)
    some = some[some - starts[owner[some]] >= CONTEXT]
    taken, at, last, seen = [], -1, -1, set()
    for p, d, c in zip(some.tolist(), owner[some].tolist(), h[some].tolist()):
        if d != at:
            at, last, seen = d, -1, set()
        if p >= last and c not in seen:
            seen.add(c)
            taken.append(p)
            last = p + BLOCK
    taken = np.array(taken, np.int64)
    who = owner[taken]
    stop = starts[who] + lengths[who] + 1
    place = taken[:, None] + np.arange(BLOCK)
    ids = np.where(place < stop[:, None], flat[np.minimum(place, len(flat) - 1)], np.uint64(0))
    block = _mixed((ids * _POWERS[:BLOCK]).sum(axis=1, dtype=np.uint64)) if len(taken) else np.zeros(0, np.uint64)
    so_far = np.concatenate(([0.0], np.cumsum(logs)))
    sums = so_far[np.minimum(taken + BLOCK, stop)] - so_far[taken]
    cuts = np.searchsorted(who, np.arange(len(docs) + 1))
    columns = h[taken].view(np.int64).tolist(), block.view(np.int64).tolist(), sums.tolist()
    return [tuple(c[a:b] for c in columns) for a, b in zip(cuts, cuts[1:])]


def memory(rows: DataFrame) -> DataFrame:
    """row, gain: what each document's log-probability gains (or loses) by the mixture. rows: row, held_out, context, block, model."""
    places = rows.select("row", F.when(F.col("held_out"), 0).otherwise(1).alias("own"), F.explode(F.arrays_zip("context", "block", "model")).alias("x")).select("row", "own", "x.*")
    pairs = saved(places.where("own = 1").groupBy("context", "block").agg(F.count("*").alias("n")), "lm-memory")
    # A table of its own, so that both sides of the join are plain shuffles, whose large parts Spark splits: a context may be frequent.
    totals = saved(pairs.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("different")), "lm-contexts")
    seen = places.join(totals, "context").where("total > own").join(pairs, ["context", "block"], "left")
    n = F.coalesce("n", F.lit(0)) - F.col("own")
    different = F.col("different") - F.when(n == 0, F.col("own")).otherwise(0)
    both = F.col("total") - F.col("own") + different
    gain = F.when(n > 0, F.log(n / both) - F.col("model") + F.log1p(different / n * F.exp("model"))).otherwise(F.log(different / both))
    return seen.groupBy("row").agg(F.sum(gain).alias("gain"))


def scored(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    all_docs = docs.select("doc_id", "text")
    train = all_docs.where(~held_out(F.col("doc_id")))
    parts = word_counts(all_docs)
    counted = parts.where("kind = 0").select(F.col("part").alias("word"), "n", "every")
    counts = counted.where("n > 0")
    n_docs = train.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] + n_docs, total["v"] + (n_docs > 0)
    floor = math.log10(tokens + distinct + 1)
    head = {bytes(r["word"]): math.log10(r["n"] + 1) for r in frequent(counts).collect()}
    model = Model(Vocabulary(subword_counts(counts), subwords().size, n_docs))
    model = trained_on(model, parts.where("kind > 0").select("part", "kind"))
    shared = spark.sparkContext.broadcast((head, model))
    end = math.log10(n_docs + 1)
    once = math.log10(2)

    def run(batches):
        head, model = shared.value
        v, sub = model.v, subwords()
        for b in batches:
            for a, e in parts_of(b.column(1)):
                w = Words(b.column(1).slice(a, e - a))
                distinct = w.distinct.to_pylist()
                of_word = np.array([head.get(x, math.nan) for x in distinct], np.float64)
                flat, sizes = sub.encode(distinct)
                flat = gathered(flat, sizes, w.codes)
                doc, n = np.repeat(np.arange(e - a), w.count), e - a
                c = of_word[w.codes] if len(distinct) else np.zeros(0)
                rare = np.isnan(c)
                unknown = np.bincount(doc[rare], minlength=n)
                train = ~b.column(2).to_numpy(zero_copy_only=False)[a:e]  # a training text's words occur once at least
                logs = np.bincount(doc, np.where(rare, 0.0, c), n) + np.where(train, unknown * once, 0.0)
                tails = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(unknown))), pa.int32()), w.distinct.take(pa.array(w.codes[rare])))
                ends = np.cumsum(np.bincount(doc, sizes[w.codes], n)).astype(np.int64) if len(distinct) else np.zeros(n, np.int64)
                ids, scores, memory = np.split(flat, ends[:-1]), [], []
                at = 0
                while at < n:
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IDS, side="right")))
                    some = ids[at:to]
                    low = [v.of[x] for x in some]
                    found, starts = model.token_scores(low)
                    for s, x, y in zip(starts, some, low):
                        if (y == 2).any():
                            found[s : s + len(y)] += np.where(y == 2, v.other[x], 0.0)
                    scores.append(np.add.reduceat(found, starts))
                    memory += remembered(some, found, starts)
                    at = to
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, n), b.column(2).slice(a, n), pa.array(w.count + 1, pa.int64()), pa.array(w.count - np.where(train, 0, unknown) + (n_docs > 0), pa.int64()), pa.array(logs + end), pa.array(np.concatenate(scores)), tails,
                     *[pa.array([m[i] for m in memory], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]],
                    names=["doc_id", "held_out", "n_tokens", "known", "logs", "score", "tail", "context", "block", "model"],
                )

    src = in_parts(all_docs.select("doc_id", F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out")))
    schema = f"doc_id {dict(src.dtypes)['doc_id']}, held_out boolean, n_tokens long, known long, logs double, score double, tail array<binary>, context array<long>, block array<long>, model array<double>"
    rows = saved(src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    # What occurs once in all texts needs no look-up: it is this text's own.
    rest = rows.select("row", "held_out", F.explode("tail").alias("word")).join(counted.where("every > 1"), "word")
    more_logs = F.log10(F.col("n") + 1) - F.when(F.col("held_out"), 0.0).otherwise(once)
    rest = rest.groupBy("row").agg(F.count_if(F.col("held_out") & (F.col("n") > 0)).alias("more"), F.sum(more_logs).alias("more_logs"))
    both = rest.withColumn("gain", F.lit(0.0)).unionByName(memory(rows).select("row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("more_logs"), "gain"))
    both = both.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "more_logs", "gain")])
    out = rows.drop("tail", "context", "block", "model").join(both, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        ((F.col("score") + F.coalesce("gain", F.lit(0.0))) / F.lit(math.log(10))).alias("score"),
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
