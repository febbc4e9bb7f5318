"""State from events: what each node set (updates: qid, conv_id, seq, node, update as JSON), folded to states as of any point.

A field's value is the last one set, null included. Updates are rows keyed by question and order, so a fold is one grouped
aggregate, and histories are windows; neither depends on how far apart the updates were written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .nodes import EVALUATION

#: Fields that nodes set, with their types.
FIELDS = {
    "query": "string", "query_type": "string", "k": "int", "modify": "boolean", "retrieval_query": "string", "draft": "string", "e": EVALUATION, "rounds": "int", "reply": "string",
    "context_summary": "string", "summarised_till": "long",
}


def _set(updates: DataFrame) -> DataFrame:
    """updates with v (all fields, typed) and has (the fields that the update names)."""
    kind = "struct<" + ", ".join(f"{k}: {t}" for k, t in FIELDS.items()) + ">"
    return updates.withColumns({"v": F.from_json("update", kind), "has": F.json_object_keys("update")})


def _value(name: str) -> Column:
    """A field's value, wrapped so that a null that was set differs from a field that was not."""
    return F.when(F.array_contains("has", name), F.struct(F.col(f"v.{name}").alias("x")))


def folded(updates: DataFrame, upto: int | None = None) -> DataFrame:
    """qid, conv_id and each field as of the update `upto` (the last one, if None); what was never set is null."""
    some = updates if upto is None else updates.where(F.col("seq") <= upto)
    last = [F.max_by(_value(n), F.when(F.array_contains("has", n), F.col("seq")))["x"].alias(n) for n in FIELDS]
    return _set(some).groupBy("qid", "conv_id").agg(*last)


def as_of_each(updates: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """qid, conv_id, seq, node of every update, with the fields as they were after it."""
    upto = Window.partitionBy("qid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _set(updates).select("qid", "conv_id", "seq", "node", *[F.last(_value(n), ignorenulls=True).over(upto)["x"].alias(n) for n in fields])


def replayed(updates: DataFrame) -> DataFrame:
    """The final states, flat: two of the grades stand for the evaluation."""
    return folded(updates).select("qid", "conv_id", "query", "query_type", "k", "modify", "retrieval_query", "draft", "rounds", F.col("e.confidence").alias("confidence"), F.col("e.coverage").alias("coverage"), "reply", "context_summary", "summarised_till")
