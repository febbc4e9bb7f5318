"""Conversations as a keyed stream against converse turn by turn; restarts."""

from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_conversation import CHUNKS

from ragframe.config import Config
from ragframe.operators import agent, ingest, nodes
from ragframe.streaming import turns

cloudpickle.register_pickle_by_value(sys.modules["test_conversation"])
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (qid, conv_id, query) by arrival: several questions of one conversation come at once, and conversations mix.
ARRIVALS = [
    [(1, 5, "hello"), (2, 5, "the domain of red apples"), (3, 6, "what is the domain of red apples fruit"), (4, 5, "")],
    [(5, 6, "write code for the domain"), (6, 7, None), (7, 6, "bye {x}")],
]
SCHEMA = "qid long, conv_id long, query string"


def turn_by_turn(spark, chunks, cfg, nodes_=None):
    """All turns of all conversations one after another: log, replies, summaries as plain values."""
    messages = summaries = None
    replies = {}
    asked = sorted((q for part in ARRIVALS for q in part), key=lambda q: (q[1], q[0]))
    waves: list[list] = []
    for q in asked:  # the n-th turns of all conversations may share a program: they don't see each other
        nth = sum(x[1] == q[1] for wave in waves for x in wave)
        if nth == len(waves):
            waves.append([])
        waves[nth].append(q)
    log, kept = [], {}
    for wave in waves:
        m = spark.createDataFrame(log, "conv_id long, turn long, role string, text string")
        s = spark.createDataFrame([(c, *x) for c, x in kept.items()], "conv_id long, context_summary string, summarised_till long")
        out = agent.converse(spark.createDataFrame(wave, SCHEMA), chunks, cfg, nodes_, m, s)
        log += [tuple(r) for r in out.added.select("conv_id", "turn", "role", "text").collect()]
        for r in out.states.collect():
            replies[r["qid"]], kept[r["conv_id"]] = r["reply"], (r["context_summary"], r["summarised_till"])
    return sorted(log), replies, kept


def seen(spark, path):
    log = sorted(tuple(r) for r in turns.log(spark, path).select("conv_id", "turn", "role", "text").collect())
    kept = {r["conv_id"]: (r["context_summary"], r["summarised_till"]) for r in turns.summaries(spark, path).collect()}
    rows = turns.replies(spark, path).collect()
    return log, {r["qid"]: r["reply"] for r in rows}, kept, len(rows)


@pytest.mark.parametrize("model", [False, True])
def test_stream_is_converse_turn_by_turn(spark, tmp_path, model):
    """Started anew after each arrival, and once after a batch that failed when its answers were half written."""
    cfg = Config(max_rounds=1, window=4)
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))

    def recalls(prompts):  # its answers tell what it was given
        return prompts.map(lambda p: f"{len(p)} {p.count('user: ')} {'Summary' in p}")

    own = nodes.Models(spark, cfg, recalls, ["general", "summarise"], f"{tmp_path}/answers") if model else None
    path, source = f"{tmp_path}/out", f"{tmp_path}/in"
    for i, part in enumerate(ARRIVALS):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        if i == 1 and not model:
            plain = turns.answered

            def fails(*a):
                done, updates = plain(*a)
                updates.write.parquet(f"{path}/updates/batch=999")
                raise RuntimeError("lost")

            turns.answered = fails
            try:
                q = turns.converse_stream(stream, chunks, path, f"{tmp_path}/ck", cfg, own)
                with pytest.raises(Exception, match="lost"):
                    q.processAllAvailable()
            finally:
                turns.answered = plain
            spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/updates/batch=999"), True)
        q = turns.converse_stream(stream, chunks, path, f"{tmp_path}/ck", cfg, own)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert q.exception() is None
    log, replies, kept, rows = seen(spark, path)
    want_log, want_replies, want_kept = turn_by_turn(spark, chunks, cfg, own)
    assert replies == want_replies and rows == 7
    assert log == want_log and kept == want_kept and any(till for _, till in kept.values())
    nodes_seen = {r["node"] for r in turns.updates(spark, path).select("node").distinct().collect()}
    assert {"init", "classify", "summarise"} <= nodes_seen and turns.updates(spark, path).where(F.col("node") == "init").count() == 7
