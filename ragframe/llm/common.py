"""What the operators of this subpackage share: tables, word rules, and the lineage cut (saved) of the library."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import saved

__all__ = ["WORD", "in_parts", "n_words", "parts_of", "release", "saved", "table"]

#: Bytes of a batch's texts that are worked on at a time.
PART = 4 << 20
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Number of words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_parts(df: DataFrame, least: int = 0) -> DataFrame:
    """df over at least so many partitions (the cluster's cores by default), for Python work on few, large files."""
    n = max(least, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


try:
    _trim = ctypes.CDLL(None).malloc_trim  # of glibc
except (AttributeError, OSError, TypeError):
    _trim = None


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and an executor's share counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def parts_of(texts: pa.Array, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's texts of about so many bytes (a longer text is one of its own), for work whose memory grows with them."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield at, min(end, len(texts))
        at = end
