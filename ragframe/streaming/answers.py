"""Questions as a stream: each micro-batch runs the question loop, and its replies are appended as soon as they are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators import agent

SCHEMA = "qid long, round int, node string, reply string, batch long"


def answer_stream(questions: DataFrame, chunks: DataFrame, path: str, checkpoint: str, cfg: Config = DEFAULT, **trigger) -> StreamingQuery:
    """Start to answer a stream of questions (qid, query). A batch that is run again after a failure replaces its own replies."""

    def step(batch: DataFrame, n: int) -> None:
        out = agent.converse(batch, chunks, cfg)
        updates = out.trace.join(out.states.select("qid", "rounds", "reply"), "qid")
        told = F.when(F.col("round") == F.col("rounds"), F.col("reply")).otherwise("")
        updates.select(F.col("qid").cast("long").alias("qid"), "round", "node", told.alias("reply")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def updates(spark: SparkSession, path: str) -> DataFrame:
    """What each node did, by question and round: qid, round, node, reply (empty but at the end), batch."""
    return spark.read.schema(SCHEMA).parquet(path)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """Only the updates that have something to say."""
    return updates(spark, path).where("reply <> ''").select("qid", "reply")
