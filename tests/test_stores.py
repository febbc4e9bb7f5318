"""The store with commits, and the clustered vector store."""

from __future__ import annotations

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragframe.config import DEFAULT
from ragframe.operators import cells, retrieve
from ragframe.sources.versioned import ChunkStore

FILES = "store string, file_name string, file_path string, text string"


def files(spark, rows):
    return spark.createDataFrame([(s, n, f"{s}/{n}", t) for s, n, t in rows], FILES)


def texts(store, version=None):
    rows = store.chunks(version).select("store", "file_name", "chunk_ix", "text").collect()
    return sorted((r["store"], r["file_name"], r["text"]) for r in rows)


def test_commits(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s")
    assert store.latest() == 0 and store.chunks().count() == store.files().count() == 0
    first = [("a", "x.md", "# X\none"), ("a", "y.md", "two"), ("b", "x.md", "three"), ("b", "z.txt", "not markdown")]
    assert store.ingest(files(spark, first)) == 1
    assert store.ingest(files(spark, first)) is None and store.latest() == 1  # a retried run
    assert store.ingest(files(spark, [("a", "x.md", "# X\nedited"), ("c", "n.md", "new")])) == 2
    assert texts(store) == [("a", "x.md", "# X\nedited"), ("a", "y.md", "two"), ("b", "x.md", "three"), ("c", "n.md", "new")]
    assert texts(store, 1) == [("a", "x.md", "# X\none"), ("a", "y.md", "two"), ("b", "x.md", "three")]
    assert store.ingest(files(spark, [("a", "x.md", "# X\none")]), prune=True) == 3  # back to the old text; y.md is gone
    assert texts(store) == [("a", "x.md", "# X\none"), ("b", "x.md", "three"), ("c", "n.md", "new")]
    assert store.remove(spark.createDataFrame([("c", "n.md"), ("c", "no.md")], "store string, file_name string")) == 4
    assert store.remove(spark.createDataFrame([("c", "n.md")], "store string, file_name string")) is None
    assert {(r["store"], r["file_name"], r["version"]) for r in store.files().collect()} == {("a", "x.md", 3), ("b", "x.md", 1)}
    assert store.ingest(files(spark, [("c", "n.md", "new")])) == 5  # what was removed may come again
    assert len(texts(store, 2)) == 4
    before = texts(store)
    assert store.vacuum(5) == 1 and texts(store) == before  # commit 2 shows nothing any more
    assert store.drop() is False and store.drop(confirm=True) and store.latest() == 0


def test_runs_at_once(spark, tmp_path):
    """Runs that start from the same snapshot: each file is in the store once, and no run's own files are lost."""
    store, shared = ChunkStore(spark, f"{tmp_path}/s"), [("a", f"f{i}.md", f"text {i}") for i in range(5)]
    store.ingest(files(spark, [("a", "f0.md", "old")]))
    start, plain, versions = threading.Barrier(3), ChunkStore._commit, {}

    def together(self, commit, entries, base):
        start.wait(120)  # all have written their chunks before any gets into the log
        return plain(self, commit, entries, base)

    ChunkStore._commit = together
    try:
        runs = [threading.Thread(target=lambda i=i: versions.update({i: store.ingest(files(spark, shared + ([("b", "own.md", "mine")] if i else [])))})) for i in range(3)]
        for t in runs:
            t.start()
        for t in runs:
            t.join(240)
    finally:
        ChunkStore._commit = plain
    assert texts(store) == sorted([*shared, ("b", "own.md", "mine")])
    got = [v for v in versions.values() if v]
    assert sorted(got) == list(range(2, 2 + len(got))) and store.latest() == max(got) and len(versions) == 3
    assert store.files().groupBy("store", "file_name").count().where("count > 1").isEmpty()


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    store, plain = ChunkStore(spark, f"{tmp_path}/s"), ChunkStore._logged
    store.ingest(files(spark, [("a", "x.md", "one")]))

    def dies(self, *_):
        raise KeyboardInterrupt

    ChunkStore._logged = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            store.ingest(files(spark, [("a", "y.md", "two")]))
    finally:
        ChunkStore._logged = plain
    assert texts(store) == [("a", "x.md", "one")] and store.latest() == 1
    assert store.vacuum(1) == 1 and store.ingest(files(spark, [("a", "y.md", "two")])) == 2 and len(texts(store)) == 2


def clustered(rng, n, dim, groups):
    return (rng.normal(0, 1, (groups, dim))[rng.integers(0, groups, n)] + rng.normal(0, 0.25, (n, dim))).round(3)


def hits(df):
    return sorted((r["qid"], r["store"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k, threshold", [(3, 0.5), (10, -1.0)])
def test_cells_exact(spark, tmp_path, k, threshold):
    rng = np.random.default_rng(4)
    v = clustered(rng, 4000, 12, 25)
    v[7] = 0
    rows = [(f"s{i % 3}", i, x.tolist()) for i, x in enumerate(v)] + [("s0", 5000, None), ("s1", 5001, []), *[("s2", 6000 + i, v[1].tolist()) for i in range(50)]]
    chunks = spark.createDataFrame(rows, "store string, chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered(rng, 60, 12, 25))] + [(100, v[1].tolist()), (101, None), (102, [0.0] * 12)], "qid long, embedding array<double>")
    index = cells.build(chunks, f"{tmp_path}/i", 60)
    found, visits = cells.search(index, asked, k, threshold, probes=4)
    assert hits(found) == hits(retrieve.vector_topk(asked.where("qid <> 102"), chunks, k, threshold))  # zero vectors never hit
    n = index.cells().count()
    read = visits.groupBy("qid").count().agg(F.avg("count")).first()[0]
    assert read < (0.5 if threshold > 0 else 1) * n and visits.groupBy("qid", "cell").count().where("count > 1").isEmpty()


def test_cells_approximate(spark, sf_dir, tmp_path, monkeypatch):
    """Recall on the given embeddings with a few probes; blocks and question batches that are small."""
    monkeypatch.setattr(cells, "BLOCK", 20)
    monkeypatch.setattr(cells, "ASKED", 7)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("store"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = e.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    index = cells.build(e, f"{tmp_path}/i")
    whole = {x[:2] + x[3:4] for x in hits(retrieve.rerank_topn(retrieve.vector_topk(asked, e, 5, 0.2), 5))}
    some, visits = cells.search(index, asked, 5, 0.2, probes=12, exact=False)
    got = {x[:2] + x[3:4] for x in hits(retrieve.rerank_topn(some, 5))}
    assert len(got & whole) >= 0.9 * len(whole) and visits.count() == 12 * asked.count()
    exact, _ = cells.search(index, asked, 5, 0.2, probes=3)
    assert hits(exact) == hits(retrieve.vector_topk(asked, e, 5, 0.2))


def test_cells_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "store string, chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    index = cells.build(none, f"{tmp_path}/i")
    found, visits = cells.search(index, asked, DEFAULT.k, 0.1)
    assert found.count() == visits.count() == 0
    one = cells.build(spark.createDataFrame([("s", 1, [2.0, 0.0])], none.schema), f"{tmp_path}/j")
    assert hits(cells.search(one, asked, 3, 0.1)[0]) == [(1, "s", 1, 1, 1.0)]
    assert cells.search(one, asked.limit(0), 3, 0.1)[0].count() == 0


def test_visits_are_handed_on_in_bounded_pieces(spark, monkeypatch):
    """Each question visits all cells, some of several blocks; no piece that a task hands on has more than PROBED visits."""
    pieces = []

    class Asked:
        dtypes, sparkSession = [("qid", "bigint"), ("embedding", "array<double>")], spark

        def mapInPandas(self, run, schema):
            pieces.extend(run(iter([pd.DataFrame({"qid": range(40), "embedding": [np.array([1.0, 0.0])] * 40})])))

    about = (np.array([3, 5, 8], np.int32), np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]), np.zeros(3), np.array([1, 2, 4], np.int32))
    monkeypatch.setattr(cells, "PROBED", 16, raising=False)
    cells._probed(Asked(), about, 3, False)
    assert max(map(len, pieces)) <= 16
    out = pd.concat(pieces)
    assert sorted(zip(out["qid"], out["cell"], out["block"])) == [(q, c, b) for q in range(40) for c, n in ((3, 1), (5, 2), (8, 4)) for b in range(n)]


def test_chunks_of_all_commits(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "commits"))
    assert store.commits().count() == 0
    for text in ("old", "new"):
        store.ingest(spark.createDataFrame([("s", "a.md", "in/a.md", text)], "store string, file_name string, file_path string, text string"))
    rows = store.commits().collect()
    assert sorted(r["text"] for r in rows) == ["new", "old"] and len({r["commit"] for r in rows}) == 2
    shown = store.files(2).select("commit").first()[0]
    assert [r["text"] for r in rows if r["commit"] == shown] == ["new"]
