"""The store with commits and the clustered vector store, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cells
from ..sources.shared import saved, shared_dir
from ..sources.versioned import KEY, ChunkStore
from . import inputs as I
from .ingest_queries import VECTOR_TOPK


def _files(spark, d):
    docs = I.table(spark, d, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("store"), name.alias("file_name"), F.concat(F.lit("in/"), name).alias("file_path"), F.coalesce("text", F.lit("")).alias("text"))


def _committed(spark, d) -> ChunkStore:
    """All documents as files; then some edited and some brought in again as they are; then some removed."""
    files, store = _files(spark, d), ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.ingest(files.drop("doc_id"))
    edited = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    store.ingest(files.where("doc_id % 10 IN (3, 4)").withColumn("text", edited).drop("doc_id"))
    store.remove(files.where("doc_id % 50 IN (7, 13)").select("store", "file_name"))
    return store


COMMITTED = """f AS (SELECT doc_id, coalesce(source, 'none') AS store, 'doc_' || doc_id || '.md' AS file_name, coalesce(text, '') AS text FROM documents),
entries AS (SELECT 1 AS version, store, file_name, text, false AS removed FROM f
  UNION ALL SELECT 2, store, file_name, text || chr(10) || 'edited', false FROM f WHERE doc_id % 10 = 3
  UNION ALL SELECT 3, store, file_name, text || CASE WHEN doc_id % 10 = 3 THEN chr(10) || 'edited' ELSE '' END, true FROM f WHERE doc_id % 50 IN (7, 13)),
newest AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY store, file_name ORDER BY version DESC) = 1)"""


def store_files(spark, d):
    """The files of the newest snapshot, and the version that brought each in."""
    return _committed(spark, d).files().select("store", "file_name", "content_hash", "version")


STORE_FILES = f"WITH {COMMITTED} SELECT store, file_name, sha256(text) AS content_hash, version::BIGINT AS version FROM newest WHERE NOT removed"


def store_versions(spark, d):
    """What each commit brought in and removed."""
    return _committed(spark, d).history().groupBy("version").agg(F.count_if(~F.col("removed")).alias("n_files"), F.count_if("removed").alias("n_removed"))


STORE_VERSIONS = f"WITH {COMMITTED} SELECT version::BIGINT AS version, count(*) FILTER (WHERE NOT removed) AS n_files, count(*) FILTER (WHERE removed) AS n_removed FROM entries GROUP BY version"


def store_snapshots(spark, d):
    """Chunks of each file as of every version: how many, how many characters, and the digest of the last."""
    store, key = _committed(spark, d), ["commit", *KEY]
    # A file's chunks in a commit are the same in all snapshots that show them.
    pieces = store.commits().groupBy(*key, "file_name").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.sha2(F.max_by("text", "chunk_ix"), 256).alias("last_chunk"))
    pieces = saved(pieces, "snapshot-pieces")
    out = [store.files(v).select(*key).join(pieces, key).select("store", "file_name", "n_chunks", "n_chars", "last_chunk", F.lit(v).alias("version")) for v in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


STORE_SNAPSHOTS = f"""WITH {COMMITTED},
shown AS (SELECT v::INT AS v, e.* FROM range(1, 4) r(v) JOIN entries e ON e.version <= v QUALIFY row_number() OVER (PARTITION BY v, store, file_name ORDER BY e.version DESC) = 1),
pieces AS (SELECT v, store, file_name, i, substr(text, i * 540 + 1, 600) AS chunk FROM (SELECT *, unnest(range(0, floor(greatest(0, length(text) - 61) / 540.0)::BIGINT + 1)) AS i FROM shown WHERE NOT removed AND length(text) > 0))
SELECT store, file_name, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars, sha256(max_by(chunk, i)) AS last_chunk, v AS version FROM pieces GROUP BY store, file_name, v"""


def vector_cells(spark, d):
    """vector_topk by way of the clustered store, exact."""
    asked, chunks = I.vectors(spark, d)
    index = cells.build(chunks, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}")
    return cells.search(index, asked)[0]


QUERIES = {"store_files": (store_files, STORE_FILES), "store_versions": (store_versions, STORE_VERSIONS), "store_snapshots": (store_snapshots, STORE_SNAPSHOTS), "vector_cells": (vector_cells, VECTOR_TOPK)}
