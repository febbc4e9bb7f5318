"""Tools: functions registered by naming convention, described as a table, dispatched by name."""

from __future__ import annotations

import inspect
import types
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import doc_summary

SUFFIX = "_tool"


def register_tools(modules: list[types.ModuleType]) -> dict[str, Callable[..., str]]:
    """All functions of the modules whose names end in _tool, by name."""
    return {n: f for m in modules for n, f in inspect.getmembers(m, inspect.isfunction) if n.endswith(SUFFIX)}


def echo_tool(text: str) -> str:
    """Return what was given.

    :param text: any text
    """
    return f"I got {text}"


def model_template_tool(name: str = "NewModel") -> str:
    """Give the source of an empty model document to fill in.

    :param name: name of the model; spaces are removed
    """
    name = name.replace(" ", "")
    return f'document = Document(id="{name}")\nnetwork = document.add(Network(id="{name}_network"))\n'


def described(spark: SparkSession, tools: dict[str, Callable[..., str]]) -> DataFrame:
    """ord, name, description, args (map of argument to type) of each tool."""
    rows = [(i, n, inspect.getdoc(f) or "", {a: getattr(p.annotation, "__name__", str(p.annotation)) for a, p in inspect.signature(f).parameters.items()}) for i, (n, f) in enumerate(sorted(tools.items()), 1)]
    return spark.createDataFrame(rows, "ord int, name string, description string, args map<string,string>")


def tool_text(ord_: Column, name: Column, description: Column, args: Column) -> Column:
    """`## n. name`, the description without parameters, then a line for each input."""
    lines = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"], F.lit("\n")))
    inputs = F.when(F.size(args) > 0, F.concat(F.lit(" Inputs:\n"), F.array_join(lines, ""))).otherwise("")
    return F.concat(F.lit("## "), ord_.cast("string"), F.lit(". "), name, F.lit("\n"), doc_summary(description), inputs)


def call_tools(calls: DataFrame, tools: dict[str, Callable[..., str]]) -> DataFrame:
    """calls (id, tool, args) -> id, output; an unknown tool or a failing call gives a message."""

    def one(name, args):
        if name not in tools:
            return f"unknown tool: {name}"
        try:
            return str(tools[name](**dict(args or {})))
        except TypeError as e:
            return f"bad arguments: {e}"

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "output": [one(t, a) for t, a in zip(b["tool"], b["args"])]})

    return calls.select("id", "tool", "args").mapInPandas(run, "id long, output string")
