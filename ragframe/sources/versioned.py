"""A chunk store with commits: what a reader sees is a snapshot, and a file is in it once, whoever brings it in and how often.

    <path>/data/commit=<id>/store=.../model=.../   chunks as they were written, seen only through a snapshot
    <path>/files/list=<id>/                        the files of a commit: store, model, name, digests; removed for a tombstone
    <path>/log/<version>.json                      the commits in order: version, commit and list

A run reads the newest snapshot, drops the files whose content is there already, writes chunks and list of the others under
an id of its own, and then puts its entry into the log under the next version. That last step is a rename to a name that must
not exist yet, as Spark's own streaming logs do it: of two runs one gets the version. The other looks at what came between,
takes the files that are in the store by now off its list, and tries the version after that. A run that dies before this step
leaves nothing that is seen; a retried one finds its files there.

The newest entry of a file (store, model, name) decides: its chunks replace those of an earlier content, a tombstone removes
them. Reads as of an older version see the store as it was, until `vacuum` deletes what no kept version needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.text import name_hash
from ..operators import ingest
from .markdown import markdown_only
from .shared import delete, exists, saved
from .store import SCHEMA

KEY = ("store", "model", "file_hash")
FILES = "store string, model string, file_name string, file_hash string, content_hash string, removed boolean"
LOG = "version long, commit string, list string"


@dataclass(frozen=True)
class ChunkStore:
    """The store under a path; nothing is written before the first commit."""

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def log(self, version: int | None = None) -> DataFrame:
        """version, commit, list of the commits up to a version."""
        if not exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        found = self.spark.read.schema(LOG).json(f"{self.path}/log")
        return found if version is None else found.where(F.col("version") <= version)

    def latest(self) -> int:
        """The newest version; 0 before the first commit."""
        return self.log().agg(F.max("version")).first()[0] or 0

    def history(self, version: int | None = None) -> DataFrame:
        """All entries of files up to a version: version, commit, list, and the columns of FILES."""
        log = self.log(version)
        if not exists(self.spark, f"{self.path}/files"):
            return self.spark.createDataFrame([], f"{LOG}, {FILES}")
        return self.spark.read.schema(FILES + ", list string").parquet(f"{self.path}/files").join(log, "list")

    def files(self, version: int | None = None) -> DataFrame:
        """The files of a snapshot: each file's newest entry, unless that is a tombstone."""
        newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("version")))
        return self.history(version).withColumn("nth", newest).where("nth = 1 AND NOT removed").drop("nth", "removed")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks of a snapshot, in the columns of the plain store."""
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        if not exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], SCHEMA)
        kept = self.files(version).select("commit", *KEY)
        return self.spark.read.schema(SCHEMA + ", commit string").parquet(f"{self.path}/data").join(kept, ["commit", *KEY], "left_semi").select(*columns)

    def commits(self) -> DataFrame:
        """The chunks of all commits, as they were written: the columns of the plain store and commit. files() tells which of them a snapshot shows."""
        if not exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], SCHEMA + ", commit string")
        return self.spark.read.schema(SCHEMA + ", commit string").parquet(f"{self.path}/data").join(self.log().select("commit").distinct(), "commit", "left_semi")

    def ingest(self, files: DataFrame, cfg: Config = DEFAULT, prune: bool = False) -> int | None:
        """Commit the files (store, file_name, file_path, text) that are new or have another content than the snapshot has; with prune also tombstones for files of these stores that aren't among them. The version, or None if there was nothing to do."""
        model = cfg.embedding_model.replace(":", "_")
        keyed = markdown_only(files)[0].withColumns({"model": F.lit(model), "file_hash": name_hash(F.col("file_name")), "content_hash": F.sha2("text", 256)})
        first = F.row_number().over(Window.partitionBy(*KEY).orderBy("file_path"))  # of files of one name in a store one
        keyed = keyed.withColumn("nth", first).where("nth = 1").drop("nth")
        base = self.latest()
        now = self.files(base)
        changed = saved(keyed.join(now.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti"), "ingest-files")
        entries = changed.select(*KEY, "file_name", "content_hash", F.lit(False).alias("removed"))
        if prune:
            gone = now.where(F.col("model") == model).join(files.select("store").distinct(), "store", "left_semi").join(keyed.select(*KEY), list(KEY), "left_anti")
            entries = entries.unionByName(gone.select(*KEY, "file_name", "content_hash", F.lit(True).alias("removed")))
        entries = saved(entries, "ingest-entries")
        if entries.isEmpty():
            return None
        commit = uuid.uuid4().hex
        if not changed.isEmpty():
            none = self.spark.createDataFrame([], "store string, file_hash string")
            chunks = ingest.ingest(changed.select("store", "file_name", "file_path", "text"), none, cfg).withColumn("model", F.lit(model))
            chunks.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.partitionBy("store", "model").parquet(f"{self.path}/data/commit={commit}")
        return self._commit(commit, entries, base)

    def remove(self, names: DataFrame) -> int | None:
        """Commit tombstones for files (store, file_name), under whatever model they are."""
        base = self.latest()
        gone = self.files(base).join(names.select("store", "file_name").distinct(), ["store", "file_name"], "left_semi")
        entries = saved(gone.select(*KEY, "file_name", "content_hash", F.lit(True).alias("removed")), "ingest-entries")
        return None if entries.isEmpty() else self._commit(uuid.uuid4().hex, entries, base)

    def _commit(self, commit: str, entries: DataFrame, base: int) -> int | None:
        columns = [c.split()[0] for c in FILES.split(", ")]
        while True:
            listed = uuid.uuid4().hex
            entries.select(*columns).write.parquet(f"{self.path}/files/list={listed}")
            if self._logged(base + 1, commit, listed):
                return base + 1
            # Others came first: what they brought in as well, or removed as well, is no news any more.
            base = self.latest()
            there = self.files().select(*KEY, "content_hash", F.lit(True).alias("there"))
            entries = entries.join(there, [*KEY, "content_hash"], "left").where(F.col("there").isNull() != F.col("removed")).drop("there")
            entries = saved(entries, "ingest-entries")
            if entries.isEmpty():
                return None

    def _logged(self, version: int, commit: str, listed: str) -> bool:
        """Whether this run got the version."""
        jvm = self.spark._jvm
        fs, at = self._fs(f"{self.path}/log/{version:012d}.json")
        _, tmp = self._fs(f"{self.path}/log/.{listed}.tmp")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({"version": version, "commit": commit, "list": listed}).encode()))
        out.close()
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(at), rename)
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def vacuum(self, keep_from: int) -> int:
        """Delete the commits' data that no version from `keep_from` on shows, and data of runs that never got into the log; how many. No run may be at work."""
        needed = {r["commit"] for v in range(min(keep_from, self.latest()), self.latest() + 1) for r in self.files(v).select("commit").distinct().collect()}
        fs, at = self._fs(f"{self.path}/data")
        found = [s.getPath().toString() for s in (fs.listStatus(at) if fs.exists(at) else ())]
        unused = [p for p in found if p.rsplit("commit=", 1)[-1] not in needed]
        return sum(delete(self.spark, p) for p in unused)

    def drop(self, confirm: bool = False) -> bool:
        """Delete the store; nothing happens without confirm."""
        return bool(confirm and delete(self.spark, self.path))
