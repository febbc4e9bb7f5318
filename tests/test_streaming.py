"""The stream's final state equals the batch fold; sessions are the same on both."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragframe.streaming import state


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    src = f"{tmp_path}/in"
    for i in range(3):  # arrives in three batches of whole turns
        m.where(f"turn % 3 = {i} AND turn < 3").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = state.conversation_states(stream, 2).writeStream.outputMode("update").format("memory").queryName("conv_states").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = {r["conv_id"]: r for r in spark.sql("SELECT conv_id, max_by(struct(*), n_messages) AS s FROM conv_states GROUP BY conv_id").collect()}
    batch = {r["conv_id"]: r for r in m.where("turn < 3").groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("text", "turn").alias("reply")).collect()}
    assert {k: (v["s"]["n_messages"], v["s"]["reply"]) for k, v in last.items()} == {k: (v["n"], v["reply"]) for k, v in batch.items()}


def test_sessions_stream(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/even[t]s.parquet")
    q = state.sessions(stream).writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    closed = {(r["user_id"], r["session_start"]): r["n_events"] for r in spark.sql("SELECT * FROM sess").collect()}
    whole = {(r["user_id"], r["session_start"]): r["n_events"] for r in state.sessions(e).collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())
