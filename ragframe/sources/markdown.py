"""Markdown folders: one folder a store, files one level down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import file_status


def _listed(spark: SparkSession, pattern: str) -> list[tuple[str, bool, int]]:
    """Path, folder or not, length of what the pattern matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [(x.getPath().toString(), x.isDirectory(), x.getLen()) for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ()]


def store_names(spark: SparkSession, root: str) -> list[str]:
    """The stores of a source folder: its folders. There must be one at least, and nothing else beside them."""
    found = [(path.rsplit("/", 1)[-1], folder) for path, folder, _ in _listed(spark, f"{root.rstrip('/')}/*")]
    if not found:
        raise ValueError(f"no store in {root}")
    if odd := sorted(name for name, folder in found if not folder):
        raise ValueError(f"not a store: {', '.join(odd)} in {root}")
    return sorted(name for name, _ in found)


def scan_stores(spark: SparkSession, root: str) -> DataFrame:
    """store, file_name, file_path, text of the files in <root>/<store>/; deeper folders are not read, an empty file has the empty text."""
    store_names(spark, root)
    pattern = f"{root.rstrip('/')}/*/*"
    listed = [(path, size) for path, folder, size in _listed(spark, pattern) if not folder]
    files = spark.createDataFrame([(path, "") for path, size in listed if not size], "path string, text string")  # Spark's readers pass over empty files
    if any(size for _, size in listed):
        full = spark.read.text(pattern, wholetext=True, recursiveFileLookup=False)
        files = full.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).unionByName(files)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("store"), F.element_at(parts, -1).alias("file_name"), F.col("path").alias("file_path"), "text")


def markdown_only(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown files, and the rest with a reason."""
    marked = file_status(files)
    return marked.where("status = 'kept'").drop("status", "mime"), marked.where("status <> 'kept'")


def write_text(pages: DataFrame, path: str, parts: int = 1) -> None:
    """Pages (kind, file_ord, text) as text, a folder for each kind, whose files in the order of their names hold the pages in order.

    With one part a kind is one file, written by one task page by page.
    """
    dealt = pages.repartitionByRange(parts, "kind", "file_ord") if parts > 1 else pages.coalesce(1)
    dealt.sortWithinPartitions("kind", "file_ord").select("kind", F.col("text").alias("value")).write.mode("overwrite").partitionBy("kind").text(path)
