"""SimHash near-duplicates, found with the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, 4-word shingles with repeats (fewer words: the whole
sequence), XXH64 (seed 42) of each; a bit is 1 if set in over half of them; no word gives fingerprint zero.
Two fingerprints link at RADIUS or fewer differing bits; groups are the connected components.

Search over distinct fingerprints: bits that correlate on a bounded sample are grouped into m partitions, which get
thresholds T_i >= -1 with sum(T_i) = RADIUS - m + 1: two linked fingerprints then differ in at most T_i bits of some
partition i. Dynamic programming picks the T_i (and m) of least estimated cost. Every fingerprint is posted under its
partition key with up to T_i of its set bits cleared: keys within T_i bits share such a signature (their AND). Members
of a signature are verified by popcount, and only a spanning forest of the links leaves a group. A signature with more
than BLOCK members is dealt out as pairs of blocks, so no task holds it whole and no link is lost.

Defined cases: null text has no words; a null id takes part but names no component (a group of null ids has id null);
repeated rows and equal texts share a fingerprint; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import in_parts, release, saved, table
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints on which bit correlations and candidate counts are estimated.
SAMPLE = 4096
#: Members of a signature that are compared in one place.
BLOCK = 4096
#: Tables of up to so many removed documents are broadcast; larger ones join by a shuffle.
BROADCAST_ROWS = 20_000
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both act on ASCII alone
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = [h(flat[a:b], SEED) for a, b in zip(starts[i : min(n, i + _CHUNK)].tolist(), ends[i : i + _CHUNK].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row; and th, the text's hash, if asked for."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *more])
        release()

    more = ["th"] if text_hash else []
    src = in_parts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.xxhash64(text_col).alias(c) for c in more]))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, fp long" + "".join(f", {c} long" for c in more))


def partition_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Groups of near-equal width: each grows by the bit that correlates most with it."""
    c = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 2 else np.zeros((64, 64))
    np.fill_diagonal(c, 0)
    free, out = set(range(64)), []
    for i in range(m):
        width = (64 - i + m - 1) // m
        group = [max(sorted(free), key=lambda b: c[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < width:
            b = max(sorted(free), key=lambda b: c[b, group].sum())
            free.discard(b)
            group.append(b)
        out.append(group)
    return out


def allocate(bits: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, of the least estimated cost for n fingerprints like the sample's."""
    best = None
    take = bits[:1024].astype(np.int16)
    for m in range(2, radius + 2):
        parts = partition_bits(bits, m)
        costs = []
        for p in parts:
            x = take[:, p]
            ones = x.sum(1)
            both = x @ x.T
            apart = np.minimum.outer(ones, ones) * 0 + np.maximum(ones[:, None] - both, ones[None, :] - both)
            pairs = max(1, len(take) * (len(take) - 1))
            cost = {-1: 0.0}
            for t in range(radius + 1):
                posts = n * sum(comb(len(p) // 2 + 1, k) for k in range(t + 1))
                share = ((apart <= t).sum() - len(take)) / pairs + 1.0 / 2 ** len(p)
                cost[t] = posts + 0.1 * share * n * n / 2
            costs.append(cost)
        plans = {0: (0.0, [])}  # DP over partitions; the state is the sum of (T_i + 1)
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in plans.items():
                for t, more in cost.items():
                    if used + t + 1 <= radius + 1 and (used + t + 1 not in step or c + more < step[used + t + 1][0]):
                        step[used + t + 1] = (c + more, [*ts, t])
            plans = step
        if radius + 1 in plans and (best is None or plans[radius + 1][0] < best[0]):
            best = (plans[radius + 1][0], list(zip(parts, plans[radius + 1][1])))
    return best[1]


def signatures(fps: np.ndarray, plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the fingerprint) of every posting."""
    sigs, who, every = [], [], np.arange(len(fps))
    for i, (bits, t) in enumerate(plan):
        if t < 0:
            continue
        key = np.zeros(len(fps), np.uint64)
        for j, b in enumerate(bits):
            key |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
        tag = np.uint64(i) << np.uint64(60)
        for k in range(t + 1):
            for clear in combinations(range(len(bits)), k):
                mask = np.uint64(sum(1 << j for j in clear))
                has = (key & mask) == mask
                sigs.append((key[has] & ~mask) | tag)
                who.append(every[has])
    return (np.concatenate(sigs), np.concatenate(who)) if sigs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def forest(f: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of distinct fingerprints f: breadth first, each found one leaves the rest."""
    out, left = [], f
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = np.bitwise_count(now[:, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                out.append((now[near.argmax(axis=0)[hit]], left[hit]))
                front, left = np.concatenate((front, left[hit])), left[~hit]
    return out


def _verify(batches):
    """Rows sorted by (sig, i, j): links within each group of equal keys."""

    def links(sig, i, j, fp):
        cut = np.flatnonzero((sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(sig)]))
        size = ends - starts
        two = starts[size == 2]
        a, b = fp[two], fp[two + 1]
        ok = np.bitwise_count(a ^ b) <= RADIUS
        found = [(a[ok], b[ok])]
        for s, e in zip(starts[size > 2], ends[size > 2]):
            found += forest(np.unique(fp[s:e]))
        return found

    held = None
    for b in batches:
        part = [b.column(k).to_numpy() for k in range(4)]
        part[3] = part[3].view(np.uint64)
        if held is not None:
            part = [np.concatenate(x) for x in zip(held, part)]
        if not len(part[0]):
            continue
        last = (part[0] == part[0][-1]) & (part[1] == part[1][-1]) & (part[2] == part[2][-1])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        held = [x[cut:] for x in part]
        if cut:
            yield from _as_links(links(*[x[:cut] for x in part]))
    if held is not None and len(held[0]):
        yield from _as_links(links(*held))


def _as_links(found):
    a, b = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all that are within RADIUS, directly or through others."""
    n = distinct.count()
    some = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()  # bounded
    fps = np.array([r["fp"] for r in some], np.int64).view(np.uint64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(fps) else np.zeros((0, 64), np.uint8)
    plan = allocate(bits, n)

    def post(batches):
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(f), 20_000):
                part = f[at : at + 20_000]
                sig, who = signatures(part, plan)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64), pa.int64()), pa.array(part[who].view(np.int64), pa.int64())], names=["sig", "fp"])

    posts = saved(in_parts(distinct).mapInArrow(post, "sig long, fp long"), "simhash-posts")
    sizes = posts.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    shared = posts.join(sizes, "sig")
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = shared.withColumn("own", own).withColumn("other", other).select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    keyed = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return keyed.mapInArrow(_verify, "a long, b long")


def _rooted(firsts: DataFrame) -> DataFrame:
    """firsts (distinct fp, first), saved -> fp, first, root (one for each group), saved."""
    roots = components(links(firsts.select("fp")))
    in_group = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return saved(in_group, "simhash-groups")


def clustered(fps: DataFrame) -> DataFrame:
    """(doc_id, fp), saved -> doc_id, fp, component_id."""
    in_group = _rooted(saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct"))
    # Saved, so that the root of a giant component is split where its members meet it.
    ids = saved(in_group.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ids")
    return fps.join(in_group.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = clustered(saved(fingerprints(table(spark, sf_dir, "documents")), "simhash-fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the one of the smallest id (null last), then of least text hash.

    Rows are told apart by id and text hash, so that texts under one id, or under none, that lie in different groups all
    keep their own row.
    """
    fps = saved(fingerprints(docs, text_hash=True), "simhash-fp")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    firsts = saved(fps.groupBy("fp").agg(F.min(row).alias("first")), "simhash-distinct")
    rows = _rooted(firsts).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.th")
    rows = saved(rows, "simhash-kept")
    stay = _same(fps, rows, "left_semi").groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    again = not stay.where("n > 1").isEmpty()  # the same id and text more than once
    go = saved(_same(fps, rows, "left_anti").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct(), "simhash-go")
    few = go.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    th = F.xxhash64("text")
    out = docs.join(F.broadcast(go) if few else go, F.col("doc_id").eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_anti")
    if again:
        out = out.withColumn("__th", th).dropDuplicates(["doc_id", "__th"])
    return out.select(*docs.columns)


def _same(fps: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """fps that are among rows, or not, by id and text hash."""
    return fps.join(rows, fps["doc_id"].eqNullSafe(rows["doc_id"]) & (fps["th"] == rows["th"]), how)
