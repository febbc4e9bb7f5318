"""Classification, grading and routing as decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Config
from ..functions.text import contains_ci, tokens

# The control graph; an empty label is an unconditional edge.
EDGES = (
    ("START", "", "init"), ("init", "", "classify"),
    ("classify", "general_question", "answer_general"), ("classify", "domain_question", "rewrite"), ("classify", "domain_code_generation", "not_available"), ("classify", "undefined", "answer_general"),
    ("rewrite", "", "generate"), ("generate", "", "grade"),
    ("grade", "continue", "reply"), ("grade", "retrieve_more_info", "generate"), ("grade", "rewrite_answer", "generate"), ("grade", "modify_query", "rewrite"), ("grade", "undefined", "ask_clarification"),
    ("decide", "tool_call", "call_tool"), ("decide", "update_code", "write_code"), ("decide", "final_answer", "return_code"),
    ("call_tool", "", "write_code"), ("write_code", "", "decide"), ("return_code", "", "summarise"),
    ("reply", "", "summarise"), ("ask_clarification", "", "summarise"), ("answer_general", "", "summarise"), ("not_available", "", "summarise"), ("summarise", "", "END"),
)
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "will", "with", "you")
CODE_VERBS = r"\b(write|generate|create|implement|code)\b"
CLARIFY = "Sorry, I could not find a good answer to that. Could you put the question in other words?"
UNAVAILABLE = "Writing code is not available yet."


def loop_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "src string, label string, dst string")


def classify_query(q: Column, domain: str = DEFAULT.domain) -> Column:
    """Rule provider: domain word and a verb of making -> code; domain word -> domain; empty -> undefined; else general."""
    about = contains_ci(q, domain)
    return (
        F.when(F.coalesce(F.length(F.trim(q)), F.lit(0)) == 0, "undefined")
        .when(about & F.rlike(F.lower(q), F.lit(CODE_VERBS)), "domain_code_generation")
        .when(about, "domain_question")
        .otherwise("general_question")
    )


def route(label: Column, node: str) -> Column:
    """Next node by label; a label without an edge takes the one of `undefined`, or the node's only edge."""
    known = [(a, b) for s, a, b in EDGES if s == node]
    rest = dict(known).get("undefined", known[-1][1])
    out = F.when(F.lit(False), F.lit(""))
    for a, b in known:
        out = out.when(label == a, b)
    return out.otherwise(rest)


def rewrite_query(q: Column, most: int = 8) -> Column:
    """The first content words."""
    return F.array_join(F.slice(F.filter(tokens(q), lambda t: ~t.isin(*STOP_WORDS)), 1, most), " ")


_named = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  binds a value to a name: it is computed once a row
_share = lambda n, d: F.round(F.when(d > 0, n / d).otherwise(0.0), 6)
_both = lambda x, y: F.size(F.array_intersect(x, y))


def _style(a: Column, n: Column) -> list[Column]:
    """Grades of an answer's words alone: a distinct ones of n."""
    return [_share(a, n).alias("coherence"), F.round(F.when(a > 0, F.least(F.lit(1.0), F.lit(60.0) / a)).otherwise(0.0), 6).alias("conciseness")]


def grade_answer(question: Column, context: Column, answer: Column) -> Column:
    """Six grades by token overlap, 0 to 1, at 6 decimals; next_step is left open."""
    size = F.size

    def grades(s: Column, n: Column) -> Column:
        q, c, a = size(s["q"]), size(s["c"]), size(s["a"])
        return F.struct(
            _share(n["ca"], c + a - n["ca"]).alias("confidence"), _share(n["cq"], q).alias("coverage"), _share(n["aq"], q).alias("relevance"), _share(n["ca"], a).alias("groundedness"),
            *_style(a, s["n"]), F.lit("undefined").alias("next_step"), F.lit("").alias("summary"),
        )

    words = F.struct(*[tokens(x).alias(k) for k, x in (("q", question), ("c", context), ("a", answer))])
    sets = lambda w: F.struct(*[F.array_distinct(w[k]).alias(k) for k in "qca"], size(w["a"]).alias("n"))
    common = lambda s: F.struct(*[_both(s[x], s[y]).alias(x + y) for x, y in ("ca", "cq", "aq")])
    return _named(words, lambda w: _named(sets(w), lambda s: _named(common(s), lambda n: grades(s, n))))


def grade_retrieved(asked: Column, references: Column, best: Column, answer: Column) -> Column:
    """Six grades by containment: how much of the search query's words all references hold (coverage), their best one (confidence) and the answer (relevance), how much of the answer's the references hold (groundedness). summary: the words that no reference has."""

    def grades(s: Column) -> Column:
        q, a = F.size(s["q"]), F.size(s["a"])
        return F.struct(
            _share(_both(s["b"], s["q"]), q).alias("confidence"), _share(_both(s["c"], s["q"]), q).alias("coverage"), _share(_both(s["a"], s["q"]), q).alias("relevance"), _share(_both(s["a"], s["c"]), a).alias("groundedness"),
            *_style(a, s["n"]), F.lit("undefined").alias("next_step"), F.array_join(F.array_except(s["q"], s["c"]), " ").alias("summary"),
        )

    words = F.struct(*[tokens(x).alias(k) for k, x in (("q", asked), ("c", references), ("b", best), ("a", answer))])
    sets = lambda w: F.struct(*[F.array_distinct(w[k]).alias(k) for k in "qcba"], F.size(w["a"]).alias("n"))
    return _named(words, lambda w: _named(sets(w), grades))


def held(asked: Column, text: Column) -> Column:
    """How many distinct words of the search query a text has."""
    return _both(tokens(text), F.array_distinct(tokens(asked)))


def route_grades(e: Column, k: Column, cfg: Config = DEFAULT) -> Column:
    """Struct (action, k, modify): the first rule that holds, with its side effects."""
    bar = cfg.pass_bar
    others = [e[x] for x in ("relevance", "groundedness", "coherence", "conciseness")]
    all_pass, all_low = (e["coverage"] >= bar) & (e["confidence"] >= bar), F.lit(True)
    for x in others:
        all_pass, all_low = all_pass & (x >= bar), all_low & (x < bar)
    more = (e["next_step"] == "retrieve_more_info") | ((e["coverage"] >= bar) & (e["confidence"] < bar))
    action = (
        F.when((e["next_step"] == "continue") & all_pass, "continue")
        .when((e["next_step"] == "modify_query") | (e["coverage"] < cfg.coverage_floor), "modify_query")
        .when(more & (k + 1 <= cfg.k_max), "retrieve_more_info")
        .when(more, "modify_query")
        .when((e["next_step"] == "rewrite_answer") | ((e["coverage"] >= bar) & (e["confidence"] >= bar) & all_low), "rewrite_answer")
        .otherwise("undefined")
    )
    return F.struct(action.alias("action"), F.when(action == "continue", cfg.k).when(action == "retrieve_more_info", k + 1).otherwise(k).cast("int").alias("k"), (action == "modify_query").alias("modify"))


def mermaid(edges: tuple[tuple[str, str, str], ...] = EDGES) -> str:
    """The control graph as text that draws it."""
    return "graph TD\n" + "".join(f"  {a} -->|{label}| {b}\n" if label else f"  {a} --> {b}\n" for a, label, b in edges)


def answer_general(query: Column) -> Column:
    """Rule provider: an echo."""
    return F.concat(F.lit("You said: "), F.coalesce(query, F.lit("")))


def ask_clarification() -> Column:
    return F.lit(CLARIFY)


def not_available() -> Column:
    return F.lit(UNAVAILABLE)


def final_answer(messages: DataFrame) -> DataFrame:
    """conv_id, reply: each conversation's last message."""
    return messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("reply"))
