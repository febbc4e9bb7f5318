"""A chat model's answers as a table: typed, each distinct prompt asked once, and what doesn't fit its shape asked for again.

Answers are kept by (model, node, digest of the prompt). A batch of rows first looks its distinct prompts up there; only new
ones go to the model, whose answers are written before anything reads them, so that a plan that runs again, a lost executor
after that, a later round or another turn asks nothing twice. An answer that can't be read as its shape is sent back with
what was wrong; after `tries` calls its readable parts stay and the others take their defaults, so no row fails.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import exists, saved, shared_dir
from .text import strip, strip_thoughts

KEPT = "prompt_hash string, attempt int, raw string, fine boolean, model string, node string"


@dataclass(frozen=True)
class Shape:
    """What an answer must be: text that isn't empty (no fields), or a JSON record.

    Of a record the required fields must be there, labels must be allowed, and shares lie from 0 to 1. A record of one label
    may come as the bare label.
    """

    fields: Mapping[str, tuple[str, object]] = field(default_factory=dict)  # name: (type, default)
    required: tuple[str, ...] = ()
    allowed: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    shares: tuple[str, ...] = ()

    def _default(self, name: str) -> Column:
        kind, value = self.fields[name]
        return (F.create_map() if value == {} else F.lit(value)).cast(kind)

    def read(self, raw: Column) -> tuple[Column, Column]:
        """(answer, fine) of a raw answer: thoughts stripped, fences and remarks around a record ignored."""
        said = strip_thoughts(raw)
        if not self.fields:
            return F.coalesce(said, F.lit("")), F.coalesce(F.length(said) > 0, F.lit(False))
        got = F.from_json(F.regexp_extract(said, r"(?s)\{.*\}", 0), ", ".join(f"{k} {kind}" for k, (kind, _) in self.fields.items()))
        answer, fine = [], F.lit(True)
        for name in self.fields:
            x = got[name]
            if len(self.fields) == 1:
                x = F.coalesce(x, strip(said))
            if name in self.allowed:
                x = F.when(x.isin(*self.allowed[name]), x)
            if name in self.shares:
                x = F.when(x.between(0.0, 1.0), x)
            answer.append(F.coalesce(x, self._default(name)).alias(name))
            if name in self.required:
                fine = fine & x.isNotNull()
        return F.struct(*answer), F.coalesce(fine, F.lit(False))

    def wanted(self) -> str:
        """The shape in words, for prompts."""
        if not self.fields:
            return "Answer with plain text."
        parts = [f'"{k}": ' + (" or ".join(f'"{a}"' for a in self.allowed[k]) if k in self.allowed else "a number from 0 to 1" if k in self.shares else kind) for k, (kind, _) in self.fields.items()]
        return "Answer with one JSON object and nothing else: {" + ", ".join(parts) + "}"


TEXT = Shape()


class Responses:
    """A chat model behind its table of answers. path: where they are kept, by default in the application's shared folder."""

    def __init__(self, spark: SparkSession, chat: Callable[[pd.Series], pd.Series], model: str, path: str | None = None, tries: int = 3):
        self.spark, self.model, self.tries = spark, model, tries
        self.path = path or f"{shared_dir(spark)}/responses"

        @F.pandas_udf("string")
        def call(prompts: pd.Series) -> pd.Series:
            return chat(prompts)

        self._call = call.asNondeterministic()  # never computed twice by a rewritten plan

    def kept(self, node: str | None = None) -> DataFrame:
        """prompt_hash, attempt, raw, fine, model, node of all calls of this model."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], KEPT)
        own = self.spark.read.schema(KEPT).parquet(self.path).where(F.col("model") == self._name())
        return own if node is None else own.where(F.col("node") == node)

    def _name(self) -> str:
        return self.model.replace(":", "_").replace("/", "_")

    def ask(self, rows: DataFrame, node: str, prompt: Column, shape: Shape = TEXT, to: str = "answer") -> DataFrame:
        """rows with the model's answer to each row's prompt as a column (a struct, or text)."""
        hashed = rows.withColumn("__prompt", F.concat_ws("\n\n", prompt, F.lit(shape.wanted())))
        keyed = saved(hashed.withColumn("__key", F.sha2("__prompt", 256)), f"prompts-{node}")
        asked = keyed.select(F.col("__key").alias("prompt_hash"), F.col("__prompt").alias("prompt")).dropDuplicates(["prompt_hash"])
        last = F.struct((~F.col("fine")).alias("odd"), "attempt", "raw")  # a fine answer first; of two runs' answers one
        known = saved(self.kept(node).join(asked.select("prompt_hash"), "prompt_hash", "left_semi").groupBy("prompt_hash").agg(F.min(last).alias("x")).select("prompt_hash", F.col("x.raw").alias("raw")), f"known-{node}")
        open_ = asked.join(known, "prompt_hash", "left_anti").withColumn("said", F.col("prompt"))
        calls, done = [], [known]
        for attempt in range(1, self.tries + 1):
            if open_.isEmpty():
                break
            answered = saved(open_.select("prompt_hash", "prompt", self._call("said").alias("raw")), f"answers-{node}")
            _, fine = shape.read(F.col("raw"))
            judged = answered.withColumn("fine", fine)
            calls.append(judged.select("prompt_hash", F.lit(attempt).alias("attempt"), "raw", "fine"))
            done.append((judged if attempt == self.tries else judged.where("fine")).select("prompt_hash", "raw"))
            again = F.concat_ws("\n\n", "prompt", F.lit("Your last answer could not be read:"), F.coalesce("raw", F.lit("")), F.lit(shape.wanted()))
            open_ = judged.where(~F.col("fine")).select("prompt_hash", "prompt", again.alias("said"))
        if calls:
            log = reduce(DataFrame.unionByName, calls).select("*", F.lit(self._name()).alias("model"), F.lit(node).alias("node"))
            log.write.mode("append").partitionBy("model", "node").parquet(self.path)
        raw = reduce(DataFrame.unionByName, done).withColumnRenamed("prompt_hash", "__key").withColumnRenamed("raw", "__raw")
        answer, _ = shape.read(F.col("__raw"))
        return keyed.join(raw, "__key", "left").withColumn(to, answer).drop("__key", "__prompt", "__raw")
