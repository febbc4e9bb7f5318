"""Files as they come in: each new or changed one is handed on once, members of archives included.

Spark lists and reads (its binary file source), so whatever it can read will do, and contents are read in tasks. What was
handed on is a table of (path, modified, length). A turn lists the folder without reading contents, takes what isn't in that
table, reads these files alone (those older than the oldest new one aren't opened), passes them to a step, and adds them to
the table when the step is done. A turn that fails hands the same files on again, so a step should be one that may be
repeated, as `ChunkStore.ingest` is; then a file has its effect once, also after a restart.

A changed file is one whose time or length differs. A member of an archive (zip, tar, tar.gz) is a file whose path is the
archive's, `!/` and its name; an archive that can't be read is handed on as itself, without members. Spark passes over empty
files: such a one is handed on once it has content; an empty member has the empty text. Bytes that aren't UTF-8 become
replacement characters.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import exists, saved

TAKEN = "path string, modified timestamp, length long"
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz")


def members(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of a file, or of an archive's files."""
    lower = path.lower()
    try:
        if lower.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from [(f"{path}!/{i.filename}", z.read(i)) for i in z.infolist() if not i.is_dir()]
            return
        if lower.endswith(ARCHIVES):
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                yield from [(f"{path}!/{m.name}", t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
            return
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError):
        pass
    yield path, content


@dataclass(frozen=True)
class Incoming:
    """What comes into the folder `root`; `ledger` is the table of what was handed on."""

    spark: SparkSession
    root: str
    ledger: str

    def _files(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)

    def taken(self) -> DataFrame:
        return self.spark.read.schema(TAKEN).parquet(self.ledger) if exists(self.spark, self.ledger) else self.spark.createDataFrame([], TAKEN)

    def new(self) -> DataFrame:
        """path, modified, length of the files that are new or changed, saved; contents aren't read."""
        there = self._files().select("path", F.col("modificationTime").alias("modified"), "length")
        return saved(there.join(self.taken(), ["path", "modified", "length"], "left_anti"), "incoming")

    def texts(self, files: DataFrame) -> DataFrame:
        """store (the first folder below root), file_name, file_path, text of files and members."""
        oldest = files.agg(F.min("modified")).first()[0]
        read = self._files().where(F.lit(False) if oldest is None else F.col("modificationTime") >= F.lit(oldest))  # the source leaves older files closed
        mine = read.withColumnRenamed("modificationTime", "modified").join(files, ["path", "modified", "length"], "left_semi")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, content in zip(b["path"], b["content"]):
                    rows = [(p, c.decode("utf-8", "replace")) for p, c in members(path, bytes(content))]
                    yield pd.DataFrame(rows, columns=["file_path", "text"])

        found = mine.select("path", "content").mapInPandas(run, "file_path string, text string")
        below = F.split(F.regexp_replace("file_path", "^[a-z]+:/*", "/"), "/")
        depth = len([x for x in self.root.split("://")[-1].split("/") if x])
        return found.select(F.element_at(below, F.lit(depth + 2)).alias("store"), F.element_at(below, F.lit(-1)).alias("file_name"), "file_path", "text")

    def take(self, step: Callable[[DataFrame], object]) -> int:
        """Hand the new and changed files on to a step; how many, archives counting as one. The ledger gets them when the step is done."""
        files = self.new()
        n = files.count()
        if n:
            step(self.texts(files))
            files.write.mode("append").parquet(self.ledger)
        return n
