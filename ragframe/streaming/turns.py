"""Conversations as a keyed stream: each thread's state lives in the state store, and its turns follow one another.

    questions ─┐
               ├─ by conversation: Thread ── asks ── question loop, all threads of a batch at once ── turns ─┐
    turns ─────┘                                                                                              │
      └───────────────────────────────────────── read back as a stream ────────────────────────────────────────┘

`Thread` keeps what a conversation's next turn needs: how far the log goes and its summary (a value), the messages that are
not summarised yet or recent (a list), and the questions that wait because one of the same conversation is being answered (a
map). It asks one question a thread at a time, with that memory. The answers are computed for all asking threads of a batch in
one DataFrame program and appended to the table `turns`, which the same query reads as its second stream: so a turn sees
all turns before it, a batch that fails is answered anew from the same state and replaces its own rows, and a restart goes on
where the checkpoint ends. The log, the replies and the summaries are views of that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import DEFAULT, Config
from ..operators import agent
from ..operators.nodes import Rules
from ..sources.shared import exists, saved

MESSAGES = "array<struct<role: string, text: string>>"
#: One row a turn. first is the number of its first message.
TURN = f"conv_id long, qid long, query string, query_type string, node string, reply string, first long, added {MESSAGES}, context_summary string, summarised_till long"
UPDATE = "qid long, conv_id long, seq int, node string, update string"
#: What a thread asks: `first` is the number of the first message in `recent`.
ASK = f"conv_id long, qid long, query string, first long, recent {MESSAGES}, context_summary string, summarised_till long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Thread(StatefulProcessor):
    """State of one conversation. In: questions (qid, query) and finished turns (qid, added, context_summary, summarised_till). Out: questions to be answered now, with their memory."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "n_messages long, summarised_till long, context_summary string, asking long")
        self.recent = handle.getListState("recent", "role string, text string")
        self.waiting = handle.getMapState("waiting", "qid long", "query string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, till, summary, asking = self.head.get() if self.head.exists() else (0, 0, "", None)
        recent = [(r[0], r[1]) for r in self.recent.get()] if self.recent.exists() else []
        for r in (r for b in rows for r in b.to_dict("records")):
            if r["added"] is None:
                if r["qid"] != asking:
                    self.waiting.updateValue((int(r["qid"]),), (r["query"],))
            elif r["qid"] == asking:
                added = [(m["role"], m["text"]) for m in r["added"]]
                n, till, summary, asking = n + len(added), int(r["summarised_till"]), r["context_summary"], None
                recent = (recent + added)[-max(n - till, self.window, 1) :]
        if asking is None and self.waiting.exists():
            asking, query = min((int(k[0]), v[0]) for k, v in self.waiting.iterator())
            self.waiting.removeKey((asking,))
            yield pd.DataFrame({"conv_id": [key[0]], "qid": [asking], "query": [query], "first": [n - len(recent)], "recent": [[{"role": a, "text": t} for a, t in recent]], "context_summary": [summary], "summarised_till": [till]})
        self.head.update((n, till, summary, asking))
        if recent:
            self.recent.put(recent)

    def close(self) -> None:
        pass


def answered(asks: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT, nodes: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """asks (one a thread, each with its memory) -> finished turns, and what each node set. Message numbers are those of the whole log."""
    messages = asks.select("conv_id", F.posexplode("recent").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")
    summaries = asks.select("conv_id", "context_summary", (F.col("summarised_till") - F.col("first")).alias("summarised_till"))
    out = agent.converse(asks.select("qid", "conv_id", "query"), chunks, cfg, nodes, messages, summaries)
    one = F.struct("turn", "role", "text")
    added = out.added.groupBy("conv_id").agg(F.min("turn").alias("at"), F.transform(F.array_sort(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("added"))
    turns = out.states.join(added, "conv_id").join(asks.select("conv_id", "first"), "conv_id")
    turns = turns.withColumns({"summarised_till": F.col("summarised_till") + F.col("first"), "first": F.col("at") + F.col("first")})
    return turns.select(*[c.split()[0] for c in TURN.replace(MESSAGES, "x").split(", ")]), out.updates


def converse_stream(questions: DataFrame, chunks: DataFrame, path: str, checkpoint: str, cfg: Config = DEFAULT, nodes: Rules | None = None, **trigger) -> StreamingQuery:
    """Start to answer a stream of questions (qid, conv_id, query); turns and updates are kept under path.

    A question whose id is asked or waiting already is the same question. State of several kinds needs the RocksDB state
    store, which is set for the session if it has another.
    """
    spark = questions.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    at = path.rstrip("/")
    if not exists(spark, f"{at}/turns"):
        spark.createDataFrame([], TURN).write.parquet(f"{at}/turns/batch=-1")
    asked = questions.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("qid").cast("long").alias("qid"), "query", F.lit(None).cast(MESSAGES).alias("added"), F.lit("").alias("context_summary"), F.lit(0).cast("long").alias("summarised_till"))
    told = spark.readStream.schema(TURN).option("recursiveFileLookup", "true").parquet(f"{at}/turns").select(*asked.columns)
    asks = asked.unionByName(told).groupBy("conv_id").transformWithStateInPandas(Thread(cfg.window), ASK, "Append", "None")

    def step(batch: DataFrame, n: int) -> None:
        mine = saved(batch, "asks")  # the state is read once a batch
        if not mine.isEmpty():
            turns, updates = answered(mine, chunks, cfg, nodes)
            updates.write.mode("overwrite").parquet(f"{at}/updates/batch={n}")
            turns.write.mode("overwrite").parquet(f"{at}/turns/batch={n}")

    return asks.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def turns(spark: SparkSession, path: str) -> DataFrame:
    """All finished turns."""
    return spark.read.schema(TURN + ", batch long").parquet(f"{path.rstrip('/')}/turns")


def log(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text of all messages."""
    each = turns(spark, path).select("conv_id", "first", F.posexplode("added").alias("i", "m"))
    return each.select("conv_id", (F.col("first") + F.col("i")).alias("turn"), "m.role", "m.text")


def replies(spark: SparkSession, path: str) -> DataFrame:
    return turns(spark, path).select("qid", "conv_id", "reply")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, context_summary, summarised_till as of each conversation's last turn."""
    last = turns(spark, path).groupBy("conv_id").agg(F.max_by(F.struct("context_summary", "summarised_till"), "first").alias("s"))
    return last.select("conv_id", "s.*")


def updates(spark: SparkSession, path: str) -> DataFrame:
    """What each node set, in order, of all turns."""
    return spark.read.schema(UPDATE + ", batch long").parquet(f"{path.rstrip('/')}/updates")
