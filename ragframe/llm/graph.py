"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al. 2014).

All steps are joins and pre-aggregated minima; every round is written to the shared folder, so nothing is collected
and lost executors cost no more than their tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import saved

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), any direction, repeats allowed -> (node, root) for every node with a link; root is the smallest."""
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are tables of their own, so that both sides of a join are plain shuffles, whose large parts Spark splits:
        # the root of a giant component is one key.
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large")
        low = saved(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        links = saved(small, "links")
        if (now := _state(links)) == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
