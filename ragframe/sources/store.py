"""The chunk store: one Parquet dataset, partitioned by store and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "file_hash string, file_name string, file_path string, chunk_ix int, h1 string, h2 string, h3 string, h4 string, text string, embedding array<double>, store string, model string"


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """All chunks (none, if nothing was appended yet). Filters on store and model prune partitions."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select(*[c.split()[0] for c in SCHEMA.split(", ")]).withColumn("model", F.replace("model", F.lit(":"), F.lit("_"))).write.mode("append").partitionBy("store", "model").parquet(path)


def drop_stores(spark: SparkSession, path: str, confirm: bool = False) -> bool:
    """Delete the dataset; nothing happens without confirm."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(confirm and hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True))
