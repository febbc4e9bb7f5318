"""Mixing sources to target weights. DataFrame operations only.

Tokens (words) are summed per source; sources by code point (null last) weigh 3, 1, 2, repeating, and share
BUDGET times all tokens; a target stops at CAP times its source's tokens and the excess goes to the others by weight:
target = min(CAP * size, level * weight) with the one level that spends the budget. A document is emitted floor(rate)
times and once more if its hash-seeded draw is below the rate's fraction. Of SEEDS seeds for these draws, each source
takes the one whose total lies nearest to its target (ties: the smallest), so that sources of few documents come near too.

Defined cases: a null or empty text has size 0 and is emitted as others are; a null source is a source of its own, last;
a null id draws as the empty text; repeated rows draw alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import n_words, saved, table

WEIGHTS, BUDGET, CAP, SEEDS = (3, 1, 2), 1.5, 2, 32
#: Per-source tables of up to so many rows are broadcast; larger ones join by a shuffle.
BROADCAST_ROWS = 20_000
#: Sources that one task numbers.
RANGE_ROWS = 20_000


def draw(id_text: Column, seed: Column | int) -> Column:
    """Uniform in [0, 1): two 32-bit words of the id's md5, a and b, give a + seed * (b | 1) mod 2**32."""
    h = F.md5(id_text.cast("binary"))
    a = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    b = F.conv(F.substring(h, 9, 8), 16, 10).cast("long").bitwiseOR(F.lit(1))
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.pmod(a + s * b, F.lit(4294967296)) / F.lit(4294967296.0)


def _id_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes, saved, with rank, the place of the source by code point, null last. Ranges of sources are numbered apart, so that no task holds them all."""
    parts = max(1, -(-sizes.count() // RANGE_ROWS))
    order = F.col("source").asc_nulls_last()
    dealt = saved(sizes.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id()), "mix-ranges")
    counts, offsets, at = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()}, [], 0
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    first = sizes.sparkSession.createDataFrame(offsets, "__p int, __o long")
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return saved(dealt.withColumn("__n", nth).join(F.broadcast(first), "__p").select(*sizes.columns, (F.col("__o") + F.col("__n") - 1).alias("rank")), "mix-ranked")


def _level(weighed: DataFrame) -> float | None:
    """What a weight of one gets: sources whose cap is below their share are taken out at their caps until none is."""
    cap, level = F.lit(CAP) * F.col("source_size"), None
    budget = weighed.agg(F.sum("source_size").alias("n")).first()["n"]
    while budget is not None:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        r = weighed.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not r["free"]:
            return level
        now = (BUDGET * budget - (r["capped"] or 0)) / r["free"]
        if level is not None and now <= level:
            return level
        level = now
    return level


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with target and rate."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = _ranked(saved(sizes, "mix-sources")).withColumn("weight", weight)
    level = _level(weighed)
    out = weighed.withColumn("target", F.least(F.lit(float(CAP)) * F.col("source_size"), F.lit(level if level is not None else 0.0) * F.col("weight")))
    out = out.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
    return out.select("source", "source_size", "target", "rate")


def _with_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Join on the source, null matching null."""
    right = per_source.withColumnRenamed("source", "__source")
    right = F.broadcast(right) if few else right
    return rows.join(right, rows["source"].eqNullSafe(right["__source"])).drop("__source")


def plan(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, source, size) -> per source: size, target, rate, seed; and whether they are few."""
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = saved(targets(sizes), "mix-targets")
    few = goal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = _with_source(rows, goal, few)
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    taken = [F.sum(F.col("size") * (whole + F.when(draw(_id_text("doc_id"), k) < part, 1).otherwise(0))).alias(f"__t{k}") for k in range(SEEDS)]
    sums = joined.groupBy("source", "source_size", "target", "rate").agg(*taken)
    tries = F.array(*[F.struct(F.abs(F.col(f"__t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    chosen = sums.select("source", "source_size", "target", "rate", F.array_min(tries)["seed"].alias("seed"))
    return saved(chosen, "mix-plan"), few


def copies(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """rows with their source's columns and `copies`, how often the mix emits them."""
    extra = F.when(draw(_id_text("doc_id"), F.col("seed")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return _with_source(rows, per_source, few).withColumn("copies", (F.floor("rate") + extra).cast("int"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    sizes = saved(docs.select("doc_id", "source", n_words("text").alias("size")), "mix-sizes")
    per_source, few = plan(sizes)
    narrow = per_source.select("source", "rate", "seed")
    clash = [c for c in ("rate", "seed", "copies") if c in docs.columns]
    kept = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    out = copies(kept, narrow, few).withColumn("__i", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).where("copies > 0")
    return out.drop("copies", "rate", "seed", "__i").withColumnsRenamed({f"__own_{c}": c for c in clash}).select(*docs.columns)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    rows = saved(table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size")), "mix-sizes")
    per_source, few = plan(rows)
    out = copies(rows, per_source, few)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _sql() -> str:
    u = "((a + {k} * b) % 4294967296) / 4294967296.0"
    sums = ", ".join(f"sum(size * (floor(rate) + CASE WHEN {u.format(k=k)} < rate - floor(rate) THEN 1 ELSE 0 END)) AS t{k}" for k in range(SEEDS))
    tries = ", ".join(f"{{'off': abs(t{k} - target), 'seed': {k}}}" for k in range(SEEDS))
    return f"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS a,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 9, 8) AS BIGINT) | 1 AS b
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][rank % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight FROM ranked),
levels AS (
  SELECT *, ({BUDGET}::DOUBLE * sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER r, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0.0)) AS l
  FROM weighed WINDOW r AS (ORDER BY {CAP} * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least({CAP}::DOUBLE * source_size, max(l) OVER () * weight) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least({CAP}::DOUBLE, target / source_size) ELSE 0.0 END AS rate FROM goal),
sums AS (SELECT r.source, any_value(target) AS target, {sums} FROM rows r JOIN rated g ON r.source IS NOT DISTINCT FROM g.source GROUP BY r.source),
seeds AS (SELECT source, list_min([{tries}]).seed AS seed FROM sums)
SELECT r.doc_id, r.size, g.source_size, g.target,
       CAST(r.size * (floor(g.rate) + CASE WHEN ((a + s.seed * b) % 4294967296) / 4294967296.0 < g.rate - floor(g.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows r JOIN rated g ON r.source IS NOT DISTINCT FROM g.source JOIN seeds s ON r.source IS NOT DISTINCT FROM s.source
"""


ORACLE_SQL = _sql()
