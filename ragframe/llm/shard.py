"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame operations only.

Every row gets a global number 0..N-1, its place in the order of (hash, id, digest, size), where hash is the unsigned
xxhash64 of the three others: it depends on the rows alone, not on how they are partitioned. A four-round Feistel network
on pairs (left, right) of a square a x a, a = ceil(sqrt(N)), permutes 0..a*a-1; numbers that leave 0..N-1 walk on along
their cycle. Shard and slot of a row are remainder and quotient of its permuted number, so anyone who knows N and
the seed computes them for any row number without the data, and counts differ by one at most.

Rows that agree in id, digest and size are interchangeable: they are counted first and numbered as one run, so a row that
is a third of all is one row until its run is dealt out.

Defined cases: ids may be of any type that sorts; a null id sorts first; a null text has size 1 and digest 0; repeated
rows get numbers (and so slots) of their own; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import saved, table

SHARDS, SEED, ROUNDS = 8, 20240607, 4
#: Bits of the hash that name a range (their totals, 2**RANGE_BITS rows, are collected), and different rows that one task
#: numbers at a time (finer ranges, as many as the rows need).
RANGE_BITS, BUCKET = 12, 16_384
#: Equal rows that one task deals out at a time.
RUN = 100_000
#: At most 2a+1 numbers lie outside 0..N-1, so a walk of this length ends but with probability N * (2/sqrt(N))^32.
WALK = 32
_P, _Q = 2147483647, 1103515245


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    out, x = [], seed % _P
    for _ in range(rounds):
        x = (x * 48271 + 11) % _P
        out.append(x)
    return out


def mix(x, key: int):
    """The round function, on ints and on columns: products stay below 2**63."""
    y = ((x + key) % _P * _Q) % _P
    return ((y + key) % _P * 69621) % _P


def permuted(x: int, n: int, seed: int = SEED) -> int:
    """Place of row number x among n rows; the columns compute the same."""
    a = max(1, math.isqrt(n - 1) + 1)
    while True:
        left, right = x // a, x % a
        for k in round_keys(seed):
            left, right = right, (left + mix(right, k)) % a
        x = left * a + right
        if x < n:
            return x


def _step(x: Column, a: int, seed: int) -> Column:
    """One pass of the network, as nested lets: each half is computed once."""
    state = F.struct(F.floor(x / F.lit(a)).cast("long").alias("l"), (x % a).alias("r"))
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
    out = F.aggregate(keys, state, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + mix_col(s["r"], k)) % F.lit(a)).alias("r")))
    return out["l"] * F.lit(a) + out["r"]


def mix_col(x: Column, key: Column) -> Column:
    y = ((x + key) % F.lit(_P) * F.lit(_Q)) % F.lit(_P)
    return ((y + key) % F.lit(_P) * F.lit(69621)) % F.lit(_P)


def permuted_col(x: Column, n: int, seed: int = SEED) -> Column:
    a = max(1, math.isqrt(n - 1) + 1)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"), lambda p, i: F.when((p >= 0) & (p < n), p).otherwise(_step(F.when(p < 0, x).otherwise(p), a, seed)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def numbered(rows: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """Rows of the key columns with a gapless global number `row`, and their count.

    Two levels of running counts over ranges of the hash: no task sees more than about BUCKET different rows at a time.
    """
    runs = saved(rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__h", F.xxhash64(*keys)), "shard-runs")
    top = F.shiftrightunsigned("__h", 64 - RANGE_BITS).cast("int")
    totals = sorted((r["t"], r["n"], r["k"]) for r in runs.groupBy(top.alias("t")).agg(F.sum("__n").alias("n"), F.count("*").alias("k")).collect())
    offsets, total = [], 0
    for t, n, _ in totals:
        offsets.append((t, total))
        total += n
    bits = max(RANGE_BITS, (sum(k for _, _, k in totals) // BUCKET).bit_length())
    keyed = runs.withColumn("__t", top).withColumn("__f", F.shiftrightunsigned("__h", 64 - bits))
    inside = Window.partitionBy("__t", "__f").orderBy("__h", *[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    finer = Window.partitionBy("__t").orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long")
    ranges = keyed.groupBy("__t", "__f").agg(F.sum("__n").alias("__n")).select("__t", "__f", so_far(finer).alias("__o"))
    first = rows.sparkSession.createDataFrame(offsets, "__t int, __first long")
    placed = keyed.withColumn("__i", so_far(inside)).join(ranges, ["__t", "__f"]).join(F.broadcast(first), "__t")
    placed = placed.select(*keys, "__n", (F.col("__first") + F.col("__o") + F.col("__i")).alias("row"))
    step = lambda i, n: F.explode(F.sequence(F.lit(0).cast("long"), i, F.lit(n).cast("long")))
    few = placed.where(F.col("__n") <= RUN)
    many = placed.where(F.col("__n") > RUN).withColumn("__s", step(F.col("__n") - 1, RUN)).repartition(F.col("row"), F.col("__s"))
    many = many.select(*keys, F.least(F.lit(RUN), F.col("__n") - F.col("__s")).alias("__n"), (F.col("row") + F.col("__s")).alias("row"))
    out = few.unionByName(many).withColumn("__s", step(F.col("__n") - 1, 1))
    return out.select(*keys, (F.col("row") + F.col("__s")).alias("row")), total


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot of every document."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out, n = numbered(rows, "doc_id", "text_crc32", "size")
    out = out.withColumn("__at", permuted_col(F.col("row"), n, seed) if n else F.lit(0).cast("long"))
    return out.select("doc_id", "size", "text_crc32", "row", F.pmod("__at", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("__at") / shards).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
