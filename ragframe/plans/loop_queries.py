"""The question loop as queries, beside SQL that plays the same rounds in a recursive query.

The offline rules only ever search for a prefix of a question's content words, with k from its start to its maximum, so the SQL
first grades every (question, prefix, k) and then walks from round to round.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import agent, events, ingest, route
from ..sources.shared import saved
from . import inputs as I
from .ingest_queries import CHUNKS, TOKENS
from .state_queries import CLASSIFIED, _STOP


def _chunks(spark, d):
    return saved(ingest.embed(I.chunks(spark, d), packed=True), "chunks")


def _turn(spark, d) -> agent.Conversation:
    """The first turns as questions after all that was said, with a state for every other conversation."""
    asked = I.questions(spark, d).select("qid", F.col("qid").alias("conv_id"), "query")
    return agent.converse(asked, _chunks(spark, d), messages=I.messages(spark, d), summaries=I.summaries(spark, d))


def agent_loop(spark, d):
    return agent.agent_loop(I.questions(spark, d), _chunks(spark, d))[0]


def agent_trace(spark, d):
    return agent.agent_loop(I.questions(spark, d), _chunks(spark, d))[1]


def ask(spark, d):
    return agent.ask(I.questions(spark, d), _chunks(spark, d))


def turn_state(spark, d):
    """The whole state that a turn leaves; the references are counted (turn_references has them)."""
    n = F.aggregate("reference_material", F.lit(0), lambda a, m: a + F.size(m["hits"]))
    grades = [F.col(f"evaluation.{g}").alias(g) for g in agent.GRADES]
    states = _turn(spark, d).states
    return states.select("qid", "conv_id", "query", "query_type", "node", "k", "rounds", "retrieval_query", *grades, "evaluation.next_step", F.col("evaluation.summary").alias("missing"), "code", "reply", F.coalesce(n, F.lit(0)).alias("n_references"), "context_summary", "summarised_till")


def turn_messages(spark, d):
    return _turn(spark, d).messages


def turn_references(spark, d):
    return _turn(spark, d).references


def state_replay(spark, d):
    """The states that folding all updates of a turn gives."""
    return events.replayed(_turn(spark, d).updates)


def state_history(spark, d):
    """Each question's search query and draft as of every update that set one of them."""
    updates = _turn(spark, d).updates
    return events.as_of_each(updates, ("retrieval_query", "draft")).where(F.col("node").isin("rewrite", "generate"))


_K, _KS = DEFAULT.k, f"range({DEFAULT.k}, {DEFAULT.k_max + 1})"
_BUCKET = "(('0x' || substr(md5(t), 1, 8))::BIGINT % " + f"{DEFAULT.dim})::INT"
_SHARE = "CASE WHEN {1} > 0 THEN round(({0})::DOUBLE / {1}, 6) ELSE 0.0 END".format

LOOP = f"""RECURSIVE {CLASSIFIED}, {CHUNKS},
asking AS MATERIALIZED (SELECT qid, query, list_filter({TOKENS.format('query')}, lambda t: t NOT IN ({_STOP}))[1:8] AS content FROM classified WHERE query_type = 'domain_question'),
prefixes AS MATERIALIZED (SELECT qid, m, content[1:m] AS words, list_filter(content[1:m], lambda x, i: list_position(content[1:m], x) = i) AS asked FROM asking, range(1, 9) r(m) WHERE m <= len(content)),
held AS (SELECT source AS store, doc_id * 1000000 + chunk_ix AS chunk_id, chunk AS text, {TOKENS.format('chunk')} AS t FROM chunked),
c AS MATERIALIZED (SELECT store, chunk_id, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT store, chunk_id, unnest(t) AS t FROM held) GROUP BY ALL),
p AS (SELECT qid, m, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT qid, m, unnest(words) AS t FROM prefixes) GROUP BY ALL),
cn AS (SELECT store, chunk_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL), pn AS (SELECT qid, m, sqrt(sum(n * n)) AS norm FROM p GROUP BY ALL),
dots AS (SELECT qid, m, store, chunk_id, sum(p.n * c.n) AS dot FROM p JOIN c USING (bucket) GROUP BY ALL),
scored AS (SELECT qid, m, store, chunk_id, round(dot / (pn.norm * cn.norm), 6) AS score FROM dots JOIN pn USING (qid, m) JOIN cn USING (store, chunk_id)),
hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, m, store ORDER BY score DESC, chunk_id) AS nth FROM scored WHERE score >= {DEFAULT.threshold} QUALIFY nth <= {DEFAULT.k_max}),
refs AS MATERIALIZED (SELECT qid, m, k, store, chunk_id, score, row_number() OVER (PARTITION BY qid, m, k ORDER BY score DESC, store, chunk_id)::INT AS rank FROM hits JOIN {_KS} r(k) ON nth <= k QUALIFY rank <= {DEFAULT.max_references}),
fits AS (SELECT r.qid, r.m, r.k, r.rank, h.text, len(list_distinct(h.t)) AS d, len(h.t) AS n, len(list_intersect(list_distinct(h.t), p.asked)) AS got, list_intersect(list_distinct(h.t), a.content) AS has
  FROM refs r JOIN held h USING (store, chunk_id) JOIN prefixes p USING (qid, m) JOIN asking a USING (qid)),
graded AS MATERIALIZED (
  SELECT qid, m, k::INT AS k, asked, coalesce(best.text, '') AS draft, coalesce(has, []) AS has, {_SHARE('coalesce(best.got, 0)', 'len(asked)')} AS confidence, CASE WHEN best.d > 0 THEN 1.0 ELSE 0.0 END AS groundedness,
    {_SHARE('coalesce(best.d, 0)', 'coalesce(best.n, 0)')} AS coherence, CASE WHEN best.d > 0 THEN round(least(1.0, 60.0::DOUBLE / best.d), 6) ELSE 0.0 END AS conciseness
  FROM prefixes CROSS JOIN {_KS} r(k) LEFT JOIN (SELECT qid, m, k, arg_max(struct_pack(text := text, d := d, n := n, got := got), got * 100 - rank) AS best, list_distinct(flatten(list(has))) AS has FROM fits GROUP BY ALL) USING (qid, m, k)),
rounds AS (
  SELECT qid, 0 AS i, len(content)::INT AS n, len(content)::INT AS m, {_K} AS used_k, {_K} AS k, false AS modify, []::VARCHAR[] AS past, []::VARCHAR[] AS now, 'rewrite' AS node, 'rewrite' AS from_node, '' AS draft, 0.0::DOUBLE AS confidence, 0.0::DOUBLE AS coverage, 0.0::DOUBLE AS groundedness, 0.0::DOUBLE AS coherence, 0.0::DOUBLE AS conciseness, '' AS missing, '' AS action FROM asking
  UNION ALL
  SELECT qid, i, n, m, used_k, CASE action WHEN 'continue' THEN {_K} WHEN 'retrieve_more_info' THEN used_k + 1 ELSE used_k END, modify OR action = 'modify_query', past, has,
    CASE WHEN action = 'continue' THEN 'reply' WHEN action = 'undefined' OR i = {DEFAULT.max_rounds} THEN 'ask_clarification' WHEN action = 'modify_query' THEN 'rewrite' ELSE 'generate' END, from_node, draft, confidence, coverage, groundedness, coherence, conciseness, missing, action
  FROM (SELECT *, CASE WHEN least(confidence, coverage, groundedness, coherence, conciseness) >= {DEFAULT.pass_bar} THEN 'continue' WHEN coverage < {DEFAULT.coverage_floor} THEN 'modify_query'
      WHEN coverage >= {DEFAULT.pass_bar} AND confidence < {DEFAULT.pass_bar} THEN CASE WHEN used_k + 1 <= {DEFAULT.k_max} THEN 'retrieve_more_info' ELSE 'modify_query' END
      WHEN coverage >= {DEFAULT.pass_bar} AND greatest(confidence, groundedness, coherence, conciseness) < {DEFAULT.pass_bar} THEN 'rewrite_answer' ELSE 'undefined' END AS action
    FROM (SELECT *, round(len(list_filter(asked, lambda x: list_contains(seen, x)))::DOUBLE / len(asked), 6) AS coverage, array_to_string(list_filter(asked, lambda x: NOT list_contains(seen, x)), ' ') AS missing
      FROM (SELECT s.qid, s.i, s.n, s.m, s.used_k, s.modify, s.past, s.from_node, g.asked, g.has, g.draft, g.confidence, g.groundedness, g.coherence, g.conciseness, list_concat(s.past, g.has) AS seen
        FROM (SELECT qid, i + 1 AS i, n, k AS used_k, modify, node AS from_node, CASE WHEN node = 'rewrite' THEN greatest(1, n - CASE WHEN modify THEN i ELSE 0 END) ELSE m END AS m,
            CASE WHEN node = 'rewrite' AND i > 0 AND greatest(1, n - CASE WHEN modify THEN i ELSE 0 END) <> m THEN list_concat(past, now) ELSE past END AS past
          FROM rounds WHERE node IN ('rewrite', 'generate') AND i < {DEFAULT.max_rounds}) s JOIN graded g ON g.qid = s.qid AND g.m = s.m AND g.k = s.used_k)))),
searched AS (SELECT r.*, array_to_string(p.words, ' ') AS retrieval_query FROM rounds r JOIN prefixes p USING (qid, m) WHERE i > 0),
ends AS (
  SELECT qid, query, query_type, node, k, i AS rounds, retrieval_query, confidence, coverage, groundedness, coherence, conciseness, missing, action, CASE WHEN node = 'reply' THEN draft ELSE '{route.CLARIFY}' END AS reply
  FROM searched JOIN classified USING (qid) WHERE node IN ('reply', 'ask_clarification')
  UNION ALL
  SELECT qid, query, query_type, CASE query_type WHEN 'domain_code_generation' THEN 'not_available' ELSE 'answer_general' END, {_K}, 0, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    CASE query_type WHEN 'domain_code_generation' THEN '{route.UNAVAILABLE}' ELSE 'You said: ' || query END FROM classified WHERE query_type <> 'domain_question')"""

#: Messages that the turns add, and the conversations with them.
SAID = f"""said AS (
  SELECT qid AS conv_id, 0 AS ord, 'user' AS role, query AS text FROM questions
  UNION ALL SELECT qid, 1, 'assistant', reply FROM ends WHERE rounds = 0
  UNION ALL SELECT qid, 10 * i, 'assistant', retrieval_query FROM searched WHERE from_node = 'rewrite'
  UNION ALL SELECT qid, 10 * i + 1, 'assistant', draft FROM searched),
whole AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT s.conv_id, last + row_number() OVER (PARTITION BY s.conv_id ORDER BY ord) AS turn, role, text FROM said s JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) USING (conv_id))"""

_WORDS = "regexp_split_to_array(conversation, '[ \\t\\n\\x0B\\f\\r]+')"
SUMMED = f"""{I.SUMMARIES},
due AS (SELECT conv_id, count(*) FILTER (WHERE turn >= coalesce(summarised_till, 0) AND role IN ('user', 'assistant')) >= {DEFAULT.window} AS due, count(*) AS n FROM whole LEFT JOIN state USING (conv_id) GROUP BY conv_id),
fresh AS (SELECT conv_id, replace(replace(string_agg(CASE WHEN role = 'assistant' THEN ': ' ELSE '' END || role || ': ' || text || chr(10), '' ORDER BY turn), '{{', '{{{{'), '}}', '}}}}') AS conversation
  FROM whole LEFT JOIN state USING (conv_id) WHERE turn >= coalesce(summarised_till, 0) AND role IN ('user', 'assistant') GROUP BY conv_id),
folded AS (SELECT conv_id, CASE WHEN due THEN concat_ws(' ', nullif(context_summary, ''), array_to_string({_WORDS}[1:40], ' ')) ELSE coalesce(context_summary, '') END AS context_summary,
  CASE WHEN due THEN n ELSE coalesce(summarised_till, 0) END::BIGINT AS summarised_till FROM due LEFT JOIN state USING (conv_id) LEFT JOIN fresh USING (conv_id))"""

LOOP_SQL = f"WITH {LOOP} SELECT qid, query_type, node, k, rounds, reply FROM ends"
TRACE_SQL = f"WITH {LOOP} SELECT qid, i AS round, node FROM rounds UNION ALL SELECT qid, 0, node FROM ends WHERE rounds = 0"
ASK_SQL = f"WITH {LOOP} SELECT qid, reply FROM ends"
MESSAGES_SQL = f"WITH {LOOP}, {SAID} SELECT * FROM whole"
LAST_REFS = """used AS (SELECT qid, m, retrieval_query, min(i) AS query_seq, max_by(used_k, i) AS k FROM searched GROUP BY qid, m, retrieval_query)"""
REFERENCES_SQL = f"""WITH {LOOP}, {LAST_REFS}
SELECT u.qid, query_seq, retrieval_query, rank, r.store, r.chunk_id, score, CASE WHEN rank IS NOT NULL THEN '' END AS fields, h.text FROM used u LEFT JOIN refs r ON r.qid = u.qid AND r.m = u.m AND r.k = u.k LEFT JOIN held h ON h.store = r.store AND h.chunk_id = r.chunk_id"""
STATE_SQL = f"""WITH {LOOP}, {SAID}, {SUMMED}, {LAST_REFS},
counted AS (SELECT u.qid, count(r.rank) AS n FROM used u LEFT JOIN refs r ON r.qid = u.qid AND r.m = u.m AND r.k = u.k GROUP BY u.qid)
SELECT e.qid, e.qid AS conv_id, query, query_type, node, k, rounds, retrieval_query, confidence, coverage, confidence AS relevance, groundedness, coherence, conciseness, CASE WHEN action = 'continue' THEN 'continue' WHEN action IS NOT NULL THEN 'undefined' END AS next_step,
  missing, '' AS code, reply, coalesce(n, 0)::INT AS n_references, context_summary, summarised_till FROM ends e LEFT JOIN counted c ON c.qid = e.qid LEFT JOIN folded f ON f.conv_id = e.qid"""
REPLAY_SQL = f"""WITH {LOOP}, {SAID}, {SUMMED}
SELECT e.qid, e.qid AS conv_id, e.query, query_type, e.k, coalesce(modify, false) AS modify, retrieval_query_ AS retrieval_query, s.draft, CASE WHEN s.qid IS NOT NULL THEN rounds END AS rounds, e.confidence, e.coverage, reply, context_summary, summarised_till
FROM ends e LEFT JOIN (SELECT *, retrieval_query AS retrieval_query_ FROM searched WHERE node IN ('reply', 'ask_clarification')) s ON s.qid = e.qid LEFT JOIN folded f ON f.conv_id = e.qid"""
HISTORY_SQL = f"""WITH {LOOP}
SELECT qid, qid AS conv_id, 10 * i AS seq, 'rewrite' AS node, retrieval_query, lag(draft) OVER w AS draft FROM searched WINDOW w AS (PARTITION BY qid ORDER BY i) QUALIFY from_node = 'rewrite'
UNION ALL SELECT qid, qid, 10 * i + 1, 'generate', retrieval_query, draft FROM searched"""

QUERIES = {
    "turn_state": (turn_state, STATE_SQL), "turn_messages": (turn_messages, MESSAGES_SQL), "turn_references": (turn_references, REFERENCES_SQL), "agent_loop": (agent_loop, LOOP_SQL), "agent_trace": (agent_trace, TRACE_SQL),
    "ask": (ask, ASK_SQL), "state_replay": (state_replay, REPLAY_SQL), "state_history": (state_history, HISTORY_SQL),
}
