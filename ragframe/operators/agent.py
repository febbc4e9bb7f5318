"""The question loop: all unfinished questions go round by round through retrieve, generate, grade and route.

A round is one DataFrame program over all unfinished questions; rounds are bounded, and each is written to the shared
folder, so that lineage stays short and a lost executor costs its tasks only. What decides or writes is a set of nodes
(operators.nodes): offline rules, or a chat model.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..config import DEFAULT, Config
from ..functions.text import default_if_null
from ..sources.shared import saved as written
from . import code, memory, retrieve, route
from .ingest import embedder
from .nodes import EVALUATION, GRADES, Rules, configured

__all__ = ["EVALUATION", "GRADES", "Conversation", "agent_loop", "answer_from_context", "ask", "converse", "rank_number"]


class Conversation(NamedTuple):
    states: DataFrame  # one row a question: all that belongs to its turn
    trace: DataFrame  # qid, round, node
    messages: DataFrame  # conv_id, turn, role, text: the log with what this turn added
    references: DataFrame  # qid, query_seq, retrieval_query, rank, store, chunk_id, score, fields, text
    added: DataFrame  # conv_id, turn, role, text: what this turn added
    updates: DataFrame  # qid, conv_id, seq, node, update (JSON): what each node set, in order


def _documents(chunks: DataFrame) -> DataFrame:
    """store, chunk_id, fields (the headings, as far as there are any), text."""
    heads = [h for h in ("h1", "h2", "h3", "h4") if h in chunks.columns]
    return chunks.select("store", "chunk_id", (retrieve.header_fields(*heads) if heads else F.lit("")).alias("fields"), "text")


def _upserted(refs: DataFrame | None, asked: DataFrame, best: DataFrame, i: int) -> DataFrame:
    """References of the questions in work: those of this round's retrieval queries anew, at their first place; a query without hits has one row without rank."""
    mine = asked.select("qid", "retrieval_query")
    new = mine.join(best, "qid", "left")
    columns = ["qid", "query_seq", "retrieval_query", "rank", "store", "chunk_id", "score", "fields", "text"]
    if refs is None:
        return new.withColumn("query_seq", F.lit(i)).select(*columns)
    first = refs.groupBy("qid", "retrieval_query").agg(F.min("query_seq").alias("query_seq"))
    new = new.join(first, ["qid", "retrieval_query"], "left").withColumn("query_seq", F.coalesce("query_seq", F.lit(i)))
    old = refs.join(mine.select("qid"), "qid", "left_semi").join(mine, ["qid", "retrieval_query"], "left_anti")
    return old.select(*columns).unionByName(new.select(*columns))


def converse(questions: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT, nodes: Rules | None = None, messages: DataFrame | None = None, summaries: DataFrame | None = None) -> Conversation:
    """questions (qid, query, and conv_id if it is not qid), chunks (store, chunk_id, text, embedding, perhaps h1..h4) and the
    conversations so far (messages: conv_id, turn, role, text; summaries: conv_id, context_summary, summarised_till).

    Every question ends in a terminal node after at most max_rounds, and its conversation is then summarised if that is due.
    Hits are retrieved at k_max, once for each retrieval query; those that some k can bring among the references get their texts,
    and rounds that only widen k filter them by rank.
    The log gets the question, each retrieval query, each draft and the fixed replies but the call for another wording.
    nodes: what decides and writes; by default as configured.
    """
    nodes, embed = nodes or configured(questions.sparkSession, cfg), embedder(cfg)
    conv = F.col("conv_id" if "conv_id" in questions.columns else "qid")
    given = questions.select("qid", conv.cast("long").alias("conv_id"), "query")
    given = given.withColumn("recalled", F.lit("")) if messages is None else given.join(_recalled(given, messages, summaries, cfg), "qid", "left").withColumn("recalled", F.coalesce("recalled", F.lit("")))
    node = F.when(F.lit(cfg.code_route) & (F.col("query_type") == "domain_code_generation"), "return_code").otherwise(route.route(F.col("query_type"), "classify"))
    fresh = {"k": F.lit(cfg.k), "modify": F.lit(False), "rounds": F.lit(0), "retrieval_query": F.lit(""), "draft": F.lit(""), "e": F.lit(None).cast(EVALUATION), "reply": F.when(F.col("node") == "not_available", route.not_available()).otherwise("")}
    start = nodes.classify(given).withColumn("node", node).withColumns(fresh)
    general = nodes.general(start.where("node = 'answer_general'").drop("reply")).select(*start.columns)
    states = written(start.where("node <> 'answer_general'").unionByName(general), "agent")
    if cfg.code_route:
        coded = code.write_code(states.where("node = 'return_code'").select("qid", "query"), cfg, nodes=nodes)[0]
        states = written(states.drop("reply").join(states.select("qid", "reply").join(coded, "qid", "left").select("qid", F.coalesce("code", "reply").alias("reply")), "qid"), "agent")
    said = lambda df, at, role, text: df.select("qid", "conv_id", F.lit(at).alias("ord"), F.lit(role).alias("role"), text.alias("text"))
    log = [said(states, 0, memory.HUMAN, F.col("query")), said(states.where(F.col("node").isin("not_available", "answer_general")), 1, memory.AI, F.col("reply"))]
    trace = [states.select("qid", F.lit(0).alias("round"), "node")]
    updates = [_update(states, 0, "init", "k", "modify"), _update(states, 1, "classify", "query", "query_type"), _update(states.where("node <> 'rewrite'"), 2, F.col("node"), "reply")]
    done, open_ = [states.where("node <> 'rewrite'")], states.where("node = 'rewrite'")
    hits = refs = None
    references = []
    for i in range(1, cfg.max_rounds + 1):
        now = open_.withColumn("last_query", F.col("retrieval_query")).withColumn("feedback", F.coalesce("e.summary", F.lit("")))
        rewritten = nodes.rewrite(now.where("node = 'rewrite'").drop("retrieval_query"))
        asked = rewritten.unionByName(now.where("node <> 'rewrite'"))
        log.append(said(asked.where("node = 'rewrite'"), 10 * i, memory.AI, F.col("retrieval_query")))
        updates.append(_update(asked.where("node = 'rewrite'"), 10 * i, "rewrite", "retrieval_query"))
        changed = asked if hits is None else asked.where(F.col("retrieval_query") != F.col("last_query"))
        if hits is None or not changed.isEmpty():
            found = retrieve.distinct_topk(changed.select("qid", embed(F.col("retrieval_query")).alias("embedding")), chunks, cfg.k_max, cfg.threshold, (cfg.k, cfg.max_references))
            found = retrieve.with_texts(written(retrieve.reachable(found, cfg.k, cfg.k_max, cfg.max_references), "agent-found"), _documents(chunks))
            same = None if hits is None else hits.join(asked.where(F.col("retrieval_query") == F.col("last_query")).select("qid"), "qid", "left_semi")
            hits = written(found if same is None else found.unionByName(same), "agent-hits")
        own = hits.join(asked.select("qid", "k"), "qid").where(F.col("rank") <= F.col("k")).drop("k")
        refs = written(_upserted(refs, asked, retrieve.rerank_topn(own, cfg.max_references), i), "agent-references")
        context = retrieve.serialize_context(refs, "qid")
        fits = F.struct(route.held(F.col("retrieval_query"), F.col("text")).alias("n"), (-F.col("rank")).alias("r"))
        best = refs.where("rank IS NOT NULL").groupBy("qid", "retrieval_query").agg(F.max_by("text", fits).alias("best"))
        texts = refs.groupBy("qid").agg(F.array_join(F.collect_list("text"), "\n").alias("texts"))
        given = asked.drop("draft", "e").join(context, "qid", "left").join(texts, "qid", "left").join(best, ["qid", "retrieval_query"], "left")
        graded = nodes.grade(nodes.draft(given))
        routed = graded.withColumn("r", route.route_grades(F.col("e"), F.col("k"), cfg))
        action = F.col("r.action")
        to = F.when(action == "continue", "reply").when(action == "undefined", "ask_clarification").when(F.lit(i == cfg.max_rounds), "ask_clarification").when(action == "modify_query", "rewrite").otherwise("generate")
        told = F.when(to == "reply", default_if_null(F.col("draft"), route.CLARIFY)).when(to == "ask_clarification", route.ask_clarification()).otherwise("")
        out = written(routed.select("qid", "conv_id", "query", "recalled", "query_type", to.alias("node"), F.col("r.k").alias("k"), (F.col("modify") | F.col("r.modify")).alias("modify"), F.lit(i).alias("rounds"), "retrieval_query", "draft", F.col("e").cast(EVALUATION).alias("e"), told.alias("reply")), "agent")
        log.append(said(out, 10 * i + 1, memory.AI, F.col("draft")))
        trace.append(out.select("qid", F.lit(i).alias("round"), "node"))
        ended = F.col("node").isin("reply", "ask_clarification")
        updates += [_update(out, 10 * i + 1, "generate", "draft"), _update(out, 10 * i + 2, "grade", "e", "k", "modify", "rounds"), _update(out.where(ended), 10 * i + 3, F.col("node"), "reply")]
        done.append(out.where(ended))
        references.append(refs.join(out.where(ended).select("qid"), "qid", "left_semi"))
        open_ = out.where(~ended)
        if open_.isEmpty():
            break
    return _finished(*map(retrieve.union_stores, (done, trace, log, references, updates)), messages, summaries, cfg, nodes)


def _update(states: DataFrame, seq: int, node: Column | str, *fields: str) -> DataFrame:
    """What a node set: qid, conv_id, seq, node, update."""
    return states.select("qid", "conv_id", F.lit(seq).alias("seq"), (F.lit(node) if isinstance(node, str) else node).alias("node"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("update"))


def _recalled(questions: DataFrame, messages: DataFrame, summaries: DataFrame | None, cfg: Config) -> DataFrame:
    """qid, recalled: summary and recent messages of each question's conversation, for a model's prompt."""
    recent = memory.render_conversation(memory.role_filter(memory.recent_window(messages, cfg.window)))
    out = questions.select("qid", "conv_id").join(recent, "conv_id", "left")
    out = out.withColumn("context_summary", F.lit("")) if summaries is None else out.join(summaries.select("conv_id", "context_summary"), "conv_id", "left")
    return out.select("qid", memory.memory_block(F.col("context_summary"), F.col("conversation"), F.lit("")).alias("recalled"))


def _finished(states: DataFrame, trace: DataFrame, log: DataFrame, refs: DataFrame, updates: DataFrame, messages: DataFrame | None, summaries: DataFrame | None, cfg: Config, nodes: Rules) -> Conversation:
    """The log with the turn's messages, the summaries where they are due, and all of it in the states."""
    spark = states.sparkSession
    nth = Window.partitionBy("conv_id").orderBy("qid", "ord")
    new = log.withColumn("ord", F.row_number().over(nth)).select("conv_id", "ord", "role", "text")
    before = spark.createDataFrame([], "conv_id long, turn long, role string, text string") if messages is None else messages
    more = written(memory.numbered(before, new), "agent-messages")  # the log itself is not written again
    whole = before.select(*more.columns).unionByName(more)
    kept = spark.createDataFrame([], "conv_id long, context_summary string, summarised_till long") if summaries is None else summaries
    mine = whole.join(states.select("conv_id").distinct(), "conv_id", "left_semi")
    folded = written(memory.fold_summary(mine, kept, cfg.window, summarise=nodes.summarise), "agent-summaries")
    one = F.struct("rank", "store", "chunk_id", "score", "fields", "text")
    material = refs.groupBy("qid", "query_seq", "retrieval_query").agg(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), one))).alias("hits"))
    material = material.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("query_seq", "retrieval_query", "hits"))).alias("reference_material"))
    states = states.join(folded, "conv_id", "left").join(material, "qid", "left").withColumn("code", F.when(F.col("node") == "return_code", F.col("reply")).otherwise(""))
    states = states.select("qid", "conv_id", "query", "query_type", "node", "k", "rounds", "retrieval_query", F.col("e").alias("evaluation"), "code", "reply", "reference_material", "context_summary", "summarised_till")
    updates = updates.unionByName(_update(states, 10 * cfg.max_rounds + 10, "summarise", "context_summary", "summarised_till"))
    return Conversation(states, trace, whole, refs, more, updates)


def agent_loop(questions: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT, nodes: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions without a conversation -> states (qid, query_type, node, k, rounds, reply) and the trace (qid, round, node)."""
    out = converse(questions, chunks, cfg, nodes)
    return out.states.select("qid", "query_type", "node", "k", "rounds", "reply"), out.trace


def ask(questions: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """qid, reply for each question; never empty."""
    if "query" not in questions.columns:
        raise ValueError("questions need a column `query`")
    states, _ = agent_loop(questions, chunks, cfg)
    return states.select("qid", default_if_null(F.col("reply"), route.CLARIFY).alias("reply"))


def answer_from_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extractive answers: the best hit's text of each question."""
    first = hits.where("rank = 1").select("qid", "store", "chunk_id")
    return first.join(chunks.select("store", "chunk_id", "text"), ["store", "chunk_id"]).select("qid", F.col("text").alias("answer"))


def rank_number(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
