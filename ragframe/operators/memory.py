"""Conversation state: message log, recent window, memory block, summaries, checkpoints. messages: conv_id, turn, role, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..config import DEFAULT
from ..functions.text import escape_braces

HUMAN, AI = "user", "assistant"
SHOWN = (HUMAN, AI)


def recent_window(messages: DataFrame, n: int = DEFAULT.window) -> DataFrame:
    """The last n messages of each conversation, of any role."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def role_filter(messages: DataFrame) -> DataFrame:
    """Human and AI messages. Apply it after the window: fewer than n may be left."""
    return messages.where(F.col("role").isin(*SHOWN))


def role_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == HUMAN).alias("n_human"), F.count_if(F.col("role") == AI).alias("n_ai"))


def render_conversation(messages: DataFrame) -> DataFrame:
    """conv_id, conversation: lines `role: text` in order, AI's led by `: `, braces doubled."""
    line = F.concat(F.when(F.col("role") == AI, ": ").otherwise(""), F.col("role"), F.lit(": "), F.col("text"), F.lit("\n"))
    folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "")
    return messages.groupBy("conv_id").agg(escape_braces(folded).alias("conversation"))


def _part(title: str, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(f"\n-----\n\n{title}\n\n"), text, F.lit("\n\n-----\n")))


DIRECTIVE = "\nWeigh the latest message together with the conversation so far.\n"


def memory_block(summary: Column, conversation: Column, code: Column) -> Column:
    """Summary, recent messages and code, as far as there are any, and a directive if there is any; else the empty text."""
    parts = F.concat_ws("", _part("Summary of the conversation so far:", summary), _part("Recent messages:", conversation), _part("Code so far:", code))
    return F.when(F.length(parts) > 0, F.concat(parts, F.lit(DIRECTIVE))).otherwise("")


def unsummarised(messages: DataFrame, state: DataFrame) -> DataFrame:
    """messages from each conversation's pointer on. state: conv_id, summarised_till."""
    till = F.coalesce("summarised_till", F.lit(0))
    return messages.join(state.select("conv_id", "summarised_till"), "conv_id", "left").where(F.col("turn") >= till).drop("summarised_till")


def summary_due(messages: DataFrame, state: DataFrame, n: int = DEFAULT.window) -> DataFrame:
    """conv_id, n_new, due for every conversation."""
    till = F.coalesce("summarised_till", F.lit(0))
    counted = messages.join(state.select("conv_id", "summarised_till"), "conv_id", "left").groupBy("conv_id")
    return counted.agg(F.count_if((F.col("turn") >= till) & F.col("role").isin(*SHOWN)).alias("n_new")).withColumn("due", F.col("n_new") >= n)


def first_words(summary: Column, conversation: Column, words: int) -> Column:
    """The summary so far, and the first words of what is new."""
    short = F.array_join(F.slice(F.split(conversation, r"\s+"), 1, words), " ")
    return F.concat_ws(" ", F.nullif(summary, F.lit("")), short)


def fold_summary(messages: DataFrame, state: DataFrame, n: int = DEFAULT.window, words: int = 40, summarise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """New state (conv_id, context_summary, summarised_till): where a summary is due, it is made anew and the pointer moves to the message count.

    summarise: rows (conv_id, context_summary, conversation: the new messages) -> with summary; by default the old summary and
    the new messages' first words.
    """
    due = summary_due(messages, state, n)
    total = messages.groupBy("conv_id").agg(F.count("*").alias("__all"))
    text = render_conversation(role_filter(unsummarised(messages, state)))
    x = due.join(total, "conv_id").join(text, "conv_id", "left").join(state, "conv_id", "left")
    if summarise is None:
        x = x.withColumn("summary", first_words(F.col("context_summary"), F.col("conversation"), words))
    else:
        x = x.join(summarise(x.where("due").select("conv_id", "context_summary", "conversation")).select("conv_id", "summary"), "conv_id", "left")
    return x.select("conv_id", F.when(F.col("due"), F.col("summary")).otherwise(F.coalesce("context_summary", F.lit(""))).alias("context_summary"), F.when(F.col("due"), F.col("__all")).otherwise(F.coalesce("summarised_till", F.lit(0))).cast("long").alias("summarised_till"))


def numbered(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The new messages (conv_id, ord, role, text) with the turns that follow each conversation's last."""
    last = messages.join(new.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.max("turn").alias("__last"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("ord"))
    return new.withColumn("__n", nth).join(last, "conv_id", "left").select("conv_id", (F.coalesce("__last", F.lit(-1)) + F.col("__n")).cast("long").alias("turn"), "role", "text")


def append_message(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new messages (conv_id, ord, role, text) after each conversation's last turn."""
    return messages.select("conv_id", "turn", "role", "text").unionByName(numbered(messages, new))


def reset_turn_state(state: DataFrame) -> DataFrame:
    """What belongs to one question goes back to its defaults."""
    return state.withColumns({"query_type": F.lit("undefined"), "next_step": F.lit("undefined"), "message_for_user": F.lit(""), "reference_material": F.lit("")})


def checkpoint(log: DataFrame, key: str = "thread_id", seq: str = "seq") -> DataFrame:
    """The latest state of each thread."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("s")).select(key, "s.*")
