"""Conversation state as a stream: one row of state a conversation, updated by each new message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT

OUTPUT = "conv_id long, n_messages long, n_new long, summarised_till long, reply string"
STATE = "n_messages long, n_new long, summarised_till long, last_turn long, reply string"
SHOWN = ("user", "assistant")


def _update(n: int):
    def update(key, batches, state: GroupState):
        count, new, till, last, reply = state.get if state.exists else (0, 0, 0, -1, "")
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        shown = new + rows["role"].isin(SHOWN).to_numpy().cumsum()  # human and AI messages since the last summary
        if shown[-1] >= n:  # a summary is due at every n-th: the pointer moves to the message count there
            till = count + 1 + int((shown >= shown[-1] // n * n).argmax())
        new, count = int(shown[-1] % n), count + len(rows)
        if int(rows["turn"].iloc[-1]) > last:
            last, reply = int(rows["turn"].iloc[-1]), rows["text"].iloc[-1] or ""
        state.update((count, new, till, last, reply))
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [count], "n_new": [new], "summarised_till": [till], "reply": [reply]})

    return update


def conversation_states(messages: DataFrame, window: int = DEFAULT.window) -> DataFrame:
    """A stream of messages (conv_id, turn, role, text) -> updates of each conversation's state; use output mode update."""
    keyed = messages.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return keyed.applyInPandasWithState(_update(window), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def replies(states: DataFrame) -> DataFrame:
    """Only the updates that have something to say."""
    return states.where("reply <> ''").select("conv_id", "reply")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Derived analytics, on batches and streams: sessions of a user's events, closed after a gap; later rows than the watermark are dropped."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with zone
        .withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
        .select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events", "total")
    )
