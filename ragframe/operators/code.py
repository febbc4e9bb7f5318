"""The code branch: decide on a tool, call it, write code from its output, until the code is ready. Off unless the configuration has code_route."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions import tools as T
from ..functions.text import TOOL_ACTIONS, contains_ci, enum_check, strip_thoughts
from ..sources.shared import saved as written
from . import route
from .retrieve import union_stores

CALL = "struct<action: string, tool: string, args: map<string, string>, reason: string, output: string>"
#: (query, code so far, tool output so far) columns -> the call; (query, code, output) -> code.
Decide = Callable[[Column, Column, Column], Column]
Write = Callable[[Column, Column, Column], Column]


def _call(action: Column, tool: Column, args: Column, reason: Column) -> Column:
    return F.struct(action.alias("action"), tool.alias("tool"), args.alias("args"), reason.alias("reason"), F.lit("").alias("output")).cast(CALL)


def decide_tool(query: Column, code: Column, output: Column) -> Column:
    """Rule provider: code there -> final_answer; tool output there -> update_code; else a call, of the template tool if the query has the word model, of the echo tool otherwise."""
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    action = F.when(has(code), "final_answer").when(has(output), "update_code").otherwise("tool_call")
    calls, template = action == "tool_call", contains_ci(query, "model")
    args = F.when(calls & template, F.create_map(F.lit("name"), F.initcap(route.rewrite_query(query, 3)))).when(calls, F.create_map(F.lit("text"), F.coalesce(query, F.lit("")))).otherwise(F.create_map().cast("map<string,string>"))
    reason = F.when(has(code), "the code is ready").when(has(output), "the tool's output is new").otherwise("nothing is known yet")
    return _call(action, F.when(calls & template, "model_template_tool").when(calls, "echo_tool").otherwise(""), args, reason)


def chat_decider(chat: Callable[[pd.Series], pd.Series], tools: str = "") -> Decide:
    """A chat model that answers with a JSON record; what is missing or not allowed takes its default, and final_answer ends the branch."""

    @F.pandas_udf("string")
    def ask_model(prompts: pd.Series) -> pd.Series:
        return chat(prompts)

    def decide(query: Column, code: Column, output: Column) -> Column:
        prompt = F.concat_ws("\n\n", F.lit(f"Tools:\n{tools}"), F.concat(F.lit("Code:\n"), code), F.concat(F.lit("Tool output:\n"), output), F.concat(F.lit("User query: "), query))
        got = F.from_json(strip_thoughts(ask_model(prompt)), "action string, tool string, args map<string,string>, reason string")
        none = F.create_map().cast("map<string,string>")
        return _call(enum_check(got["action"], TOOL_ACTIONS, "final_answer"), F.coalesce(got["tool"], F.lit("")), F.coalesce(got["args"], none), F.coalesce(got["reason"], F.lit("")))

    return decide


def generate_code(query: Column, code: Column, output: Column) -> Column:
    """Rule provider: the tool's output, else the code as it is."""
    return F.coalesce(F.nullif(output, F.lit("")), code, F.lit(""))


def chat_coder(chat: Callable[[pd.Series], pd.Series]) -> Write:
    @F.pandas_udf("string")
    def ask_model(prompts: pd.Series) -> pd.Series:
        return chat(prompts)

    return lambda query, code, output: strip_thoughts(ask_model(F.concat_ws("\n\n", F.concat(F.lit("Existing code:\n"), code), F.concat(F.lit("Tool output:\n"), output), F.concat(F.lit("User query: "), query))))


def write_code(questions: DataFrame, cfg: Config = DEFAULT, decide: Decide = decide_tool, write: Write = generate_code, tools: dict[str, Callable[..., str]] | None = None, nodes=None) -> tuple[DataFrame, DataFrame]:
    """questions (qid, query) -> states (qid, query, call, code, rounds) and the trace (qid, round, node). After max_rounds the code goes out as it is.

    nodes: a set of nodes (operators.nodes) that decides and writes instead.
    """
    tools = T.register_tools([T]) if tools is None else tools
    decided = nodes.decide if nodes else lambda rows: rows.withColumn("call", decide(F.col("query"), F.col("code"), F.col("output")))
    rewritten = nodes.write if nodes else lambda rows: rows.withColumn("code", write(F.col("query"), F.col("code"), F.col("output")))
    open_ = questions.select("qid", "query", F.lit("").alias("code"), F.lit("").alias("output"))
    done, trace = [], []
    for i in range(1, cfg.max_rounds + 1):
        asked = written(decided(open_), "code")
        node = route.route(F.col("call.action"), "decide")
        asked = asked.withColumn("node", F.when(F.lit(i == cfg.max_rounds), "return_code").otherwise(node))
        trace.append(asked.select("qid", F.lit(i).alias("round"), "node"))
        done.append(asked.where("node = 'return_code'").select("qid", "query", "call", "code", F.lit(i).alias("rounds")))
        rest = asked.where("node <> 'return_code'")
        called = T.call_tools(rest.where("node = 'call_tool'").select(F.col("qid").alias("id"), "call.tool", "call.args"), tools).select(F.col("id").alias("qid"), F.col("output").alias("fresh"))
        rest = rest.join(called, "qid", "left").withColumn("output", F.coalesce("fresh", "output"))
        open_ = written(rewritten(rest.select("qid", "query", "code", "output")).select("qid", "query", "code", "output"), "code")
        if open_.isEmpty():
            break
    return union_stores(done), union_stores(trace)
