"""The nodes of the question loop that decide or write: offline rules, or a chat model behind one interface.

Each node takes rows and gives them back with one column more. `Models` asks a chat model with a fixed shape for every node it
was given, and leaves the others to the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Config
from ..functions import providers, tools as T
from ..functions.responses import Responses, Shape
from ..functions.text import NEXT_STEPS, QUERY_TYPES, TOOL_ACTIONS, contains_ci
from . import code, memory, route

NODES = ("classify", "rewrite", "draft", "grade", "general", "decide", "write", "summarise")
GRADES = ("confidence", "coverage", "relevance", "groundedness", "coherence", "conciseness")
EVALUATION = f"struct<{', '.join(f'{x}: double' for x in GRADES)}, next_step: string, summary: string>"
#: Words of a conversation that the rules keep as its summary.
SUMMARY_WORDS = 40


class Rules:
    """Deterministic and offline. Rows have the columns that a node's docstring names, and may have others."""

    def __init__(self, cfg: Config = DEFAULT):
        self.cfg = cfg

    def classify(self, rows: DataFrame) -> DataFrame:
        """query, recalled -> query_type."""
        return rows.withColumn("query_type", route.classify_query(F.col("query"), self.cfg.domain))

    def rewrite(self, rows: DataFrame) -> DataFrame:
        """query, recalled, modify (a better one is wanted), rounds, feedback -> retrieval_query: content words, fewer each time it is sent back."""
        words = F.split(route.rewrite_query(F.col("query")), " ")
        fewer = F.size(words) - F.when(F.col("modify"), F.col("rounds")).otherwise(0)
        return rows.withColumn("retrieval_query", F.array_join(F.slice(words, 1, F.greatest(F.lit(1), fewer)), " "))

    def draft(self, rows: DataFrame) -> DataFrame:
        """query, retrieval_query, context, best (the reference that holds most of the retrieval query), recalled -> draft."""
        return rows.withColumn("draft", F.coalesce("best", F.lit("")))

    def grade(self, rows: DataFrame) -> DataFrame:
        """query, retrieval_query, context, texts (of all references), best, draft -> e (grades from 0 to 1, next step, summary)."""
        e = route.grade_retrieved(F.col("retrieval_query"), F.coalesce("texts", F.lit("")), F.coalesce("best", F.lit("")), F.col("draft"))
        rows = rows.withColumn("e", e)
        # The overlap grader has no step of its own to propose: all grades passing means continue.
        passing = F.least(*[F.col(f"e.{x}") for x in GRADES]) >= self.cfg.pass_bar
        step = F.when(passing, "continue").otherwise("undefined")
        return rows.withColumn("e", F.struct(*[F.col(f"e.{x}").alias(x) for x in GRADES], step.alias("next_step"), F.col("e.summary").alias("summary")))

    def general(self, rows: DataFrame) -> DataFrame:
        """query, recalled -> reply."""
        return rows.withColumn("reply", route.answer_general(F.col("query")))

    def decide(self, rows: DataFrame) -> DataFrame:
        """query, code, output -> call."""
        return rows.withColumn("call", code.decide_tool(F.col("query"), F.col("code"), F.col("output")))

    def write(self, rows: DataFrame) -> DataFrame:
        """query, code, output -> code, anew."""
        return rows.withColumn("code", code.generate_code(F.col("query"), F.col("code"), F.col("output")))

    def summarise(self, rows: DataFrame) -> DataFrame:
        """context_summary (so far), conversation (what is new) -> summary."""
        return rows.withColumn("summary", memory.first_words(F.col("context_summary"), F.col("conversation"), SUMMARY_WORDS))


def _titled(title: str, text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > 0, F.concat(F.lit(f"{title}:\n"), text))


def _said() -> Column:
    return F.concat(F.lit("User query: "), F.coalesce("query", F.lit("")))


CLASSIFY = "Task: classify\n\nTell what the user wants. The label domain_code_generation is for requests to write code for the domain, domain_question for all else about the domain"
REWRITE = "Task: rewrite\n\nGive a search query for one concept of the user's question: three to eight content words, no sentence."
MODIFY = "The last query did not bring enough. Search for one concept that is missing."
DRAFT = "Task: draft\n\nAnswer the question from the references alone, without mentioning them. If they lack something, say so."
GRADE = (
    "Task: grade\n\nGrade an answer strictly by the references. confidence and coverage say how clearly and how fully the references answer the question; relevance, groundedness, coherence and conciseness "
    "are about the answer. next_step: continue if all is well, modify_query if coverage is low, retrieve_more_info if coverage is high and confidence low, rewrite_answer if only the answer is poor, "
    "else undefined. summary: why, and what is missing."
)
GENERAL = "Task: general\n\nTalk with the user, who asks about something outside the domain. Be brief and friendly; say so if you don't know."
DECIDE = "Task: decide\n\nYou write code with tools. tool_call calls one, update_code writes the code anew from what is known, final_answer hands it out."
WRITE = "Task: write\n\nWrite the code that the user asks for, from the code so far and the tool's output. Answer with the code alone."
SUMMARISE = "Task: summarise\n\nSum up the conversation in a few sentences, on top of the summary so far."

QUERY = Shape({"query_type": ("string", "undefined")}, ("query_type",), {"query_type": QUERY_TYPES})
EVALUATED = Shape({**{g: ("double", 0.0) for g in GRADES}, "next_step": ("string", "undefined"), "summary": ("string", "")}, (*GRADES, "next_step"), {"next_step": NEXT_STEPS}, GRADES)
CALLED = Shape({"action": ("string", "final_answer"), "tool": ("string", ""), "args": ("map<string,string>", {}), "reason": ("string", "")}, ("action",), {"action": TOOL_ACTIONS})


class Models(Rules):
    """A chat model for the nodes named (all, if none are); the rules for the others."""

    def __init__(self, spark: SparkSession, cfg: Config, chat: Callable[[pd.Series], pd.Series] | None = None, nodes: Collection[str] = (), path: str | None = None, tools: dict[str, Callable[..., str]] | None = None):
        super().__init__(cfg)
        nodes = tuple(nodes) or NODES
        if odd := set(nodes).difference(NODES):
            raise ValueError(f"no such node: {', '.join(sorted(odd))}")
        told = {t: chat or providers.setup_llm(cfg.chat_model, temperature=t) for t in (cfg.temperature, cfg.grader_temperature)}
        self.responses = Responses(spark, told[cfg.temperature], cfg.chat_model, path, cfg.answer_tries)
        self.grader = Responses(spark, told[cfg.grader_temperature], cfg.chat_model, path, cfg.answer_tries)
        self.tools = T.register_tools([T]) if tools is None else tools
        for name in set(NODES).difference(nodes):  # the rules stay
            setattr(self, name, getattr(super(), name))

    def classify(self, rows: DataFrame) -> DataFrame:
        other = F.when(~F.coalesce(contains_ci(F.col("query"), self.cfg.domain), F.lit(False)), ", general_question for what has nothing to do with it").otherwise("")
        task = F.concat(F.lit(CLASSIFY), other, F.lit(f". The domain: {self.cfg.domain}."))
        return self.responses.ask(rows, "classify", F.concat_ws("\n\n", task, F.col("recalled"), _said()), QUERY, "said").withColumn("query_type", F.col("said.query_type")).drop("said")

    def rewrite(self, rows: DataFrame) -> DataFrame:
        better = F.when(F.col("modify"), F.concat_ws("\n\n", F.lit(MODIFY), _titled("Feedback", "feedback"), _titled("Last query", "last_query")))
        return self.responses.ask(rows, "rewrite", F.concat_ws("\n\n", F.lit(REWRITE), better, F.col("recalled"), _said()), to="retrieval_query")

    def draft(self, rows: DataFrame) -> DataFrame:
        prompt = F.concat_ws("\n\n", F.lit(DRAFT), _titled("References", "context"), F.col("recalled"), _said())
        return self.responses.ask(rows, "draft", prompt, to="draft")

    def grade(self, rows: DataFrame) -> DataFrame:
        prompt = F.concat_ws("\n\n", F.lit(GRADE), _titled("References", "context"), _titled("Answer", "draft"), _said())
        return self.grader.ask(rows, "grade", prompt, EVALUATED, "e").withColumn("e", F.col("e").cast(EVALUATION))

    def general(self, rows: DataFrame) -> DataFrame:
        return self.responses.ask(rows, "general", F.concat_ws("\n\n", F.lit(GENERAL), F.col("recalled"), _said()), to="reply")

    def decide(self, rows: DataFrame) -> DataFrame:
        known = T.described(rows.sparkSession, self.tools).select(T.tool_text(F.col("ord"), F.col("name"), F.col("description"), F.col("args")).alias("t")).collect()
        prompt = F.concat_ws("\n\n", F.lit(DECIDE), F.lit("Tools:\n" + "\n".join(r["t"] for r in known)), _titled("Code", "code"), _titled("Tool output", "output"), _said())
        got = self.responses.ask(rows, "decide", prompt, CALLED, "call")
        return got.withColumn("call", F.struct("call.*", F.lit("").alias("output")).cast(code.CALL))

    def write(self, rows: DataFrame) -> DataFrame:
        prompt = F.concat_ws("\n\n", F.lit(WRITE), _titled("Code", "code"), _titled("Tool output", "output"), _said())
        return self.responses.ask(rows, "write", prompt, to="fresh").withColumn("code", F.col("fresh")).drop("fresh")

    def summarise(self, rows: DataFrame) -> DataFrame:
        prompt = F.concat_ws("\n\n", F.lit(SUMMARISE), _titled("Summary so far", "context_summary"), _titled("New messages", "conversation"))
        return self.responses.ask(rows, "summarise", prompt, to="summary")


def configured(spark: SparkSession, cfg: Config) -> Rules:
    """The rules, or the configured chat model at the configured nodes."""
    if cfg.chat_model == DEFAULT.chat_model:
        return Rules(cfg)
    return Models(spark, cfg, nodes=[n for n in cfg.model_nodes.replace(" ", "").split(",") if n])
