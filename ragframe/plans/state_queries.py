"""Conversation state, classification, grading, routing and the loop: each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import tools as T
from ..operators import code, memory, route
from ..streaming import state as stream
from . import inputs as I
from .ingest_queries import TOKENS

N = 4  # window of these queries: conversations have 2 to 8 turns


def recent_window(spark, d):
    return memory.recent_window(I.messages(spark, d), N)


RECENT = f"recent AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {N})"
RECENT_WINDOW = f"WITH {RECENT} SELECT * FROM recent"


def role_filter(spark, d):
    return memory.role_filter(recent_window(spark, d))


SHOWN = f"{RECENT}, shown AS (SELECT * FROM recent WHERE role IN ('user', 'assistant'))"
ROLE_FILTER = f"WITH {SHOWN} SELECT * FROM shown"


def role_counts(spark, d):
    return memory.role_counts(I.messages(spark, d))


ROLE_COUNTS = "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_human, count(*) FILTER (WHERE role = 'assistant') AS n_ai FROM conversations GROUP BY conv_id"


def render_conversation(spark, d):
    return memory.render_conversation(role_filter(spark, d))


RENDERED = SHOWN + ", rendered AS (SELECT conv_id, replace(replace(string_agg(CASE WHEN role = 'assistant' THEN ': ' ELSE '' END || role || ': ' || text || chr(10), '' ORDER BY turn), '{', '{{'), '}', '}}') AS conversation FROM shown GROUP BY conv_id)"
RENDER = f"WITH {RENDERED} SELECT * FROM rendered"


def memory_block(spark, d):
    x = render_conversation(spark, d).join(I.summaries(spark, d), "conv_id", "full")
    code = F.when(F.col("conv_id") % 5 == 0, "x = 1").otherwise("")
    return x.select("conv_id", memory.memory_block(F.col("context_summary"), F.col("conversation"), code).alias("block"))


def _sql_part(title: str, c: str) -> str:
    return f"CASE WHEN length({c}) > 0 THEN chr(10) || '-----' || chr(10) || chr(10) || '{title}' || chr(10) || chr(10) || {c} || chr(10) || chr(10) || '-----' || chr(10) END"


BLOCK = f"""WITH {RENDERED}, {I.SUMMARIES},
parts AS (SELECT conv_id, concat({_sql_part('Summary of the conversation so far:', 'context_summary')}, {_sql_part('Recent messages:', 'conversation')}, {_sql_part('Code so far:', "CASE WHEN conv_id % 5 = 0 THEN 'x = 1' ELSE '' END")}) AS p FROM rendered FULL JOIN state USING (conv_id))
SELECT conv_id, CASE WHEN length(p) > 0 THEN p || chr(10) || '{memory.DIRECTIVE.strip()}' || chr(10) ELSE '' END AS block FROM parts"""


def summary_due(spark, d):
    return memory.summary_due(I.messages(spark, d), I.summaries(spark, d), N)


DUE = f"{I.SUMMARIES}, due AS (SELECT conv_id, count(*) FILTER (WHERE turn >= coalesce(summarised_till, 0) AND role IN ('user', 'assistant')) AS n_new, n_new >= {N} AS due, count(*) AS n FROM conversations LEFT JOIN state USING (conv_id) GROUP BY conv_id)"
SUMMARY_DUE = f"WITH {DUE} SELECT conv_id, n_new, due FROM due"


def fold_summary(spark, d):
    return memory.fold_summary(I.messages(spark, d), I.summaries(spark, d), N)


_WORDS = "regexp_split_to_array(conversation, '[ \\t\\n\\x0B\\f\\r]+')"
FOLD = f"""WITH {DUE},
fresh AS (SELECT conv_id, replace(replace(string_agg(CASE WHEN role = 'assistant' THEN ': ' ELSE '' END || role || ': ' || text || chr(10), '' ORDER BY turn), '{{', '{{{{'), '}}', '}}}}') AS conversation
  FROM conversations LEFT JOIN state USING (conv_id) WHERE turn >= coalesce(summarised_till, 0) AND role IN ('user', 'assistant') GROUP BY conv_id)
SELECT conv_id, CASE WHEN due THEN concat_ws(' ', nullif(context_summary, ''), array_to_string({_WORDS}[1:40], ' ')) ELSE coalesce(context_summary, '') END AS context_summary,
  CASE WHEN due THEN n ELSE coalesce(summarised_till, 0) END::BIGINT AS summarised_till FROM due LEFT JOIN state USING (conv_id) LEFT JOIN fresh USING (conv_id)"""


def append_message(spark, d):
    m = I.messages(spark, d)
    q = m.where("role = 'user'").select("conv_id", F.col("turn").alias("ord"), F.lit("assistant").alias("role"), F.concat(F.lit("re: "), "text").alias("text"))
    return memory.append_message(m, q)


APPEND = "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, (SELECT max(turn) FROM conversations c WHERE c.conv_id = n.conv_id) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, 'assistant' AS role, 're: ' || text AS text FROM conversations n WHERE role = 'user'"


def reset_turn_state(spark, d):
    return memory.reset_turn_state(I.summaries(spark, d))


RESET = f"WITH {I.SUMMARIES} SELECT conv_id, context_summary, summarised_till::BIGINT AS summarised_till, 'undefined' AS query_type, 'undefined' AS next_step, '' AS message_for_user, '' AS reference_material FROM state"


def checkpoint(spark, d):
    e = I.table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), "event_type", "value")
    return memory.checkpoint(e)


CHECKPOINT = "SELECT user_id AS thread_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id"


# classification and routing


def classify_query(spark, d):
    return I.questions(spark, d).select("qid", route.classify_query(F.col("query")).alias("query_type"))


CLASSIFIED = I.QUESTIONS_SQL + f""", classified AS (SELECT qid, query, CASE WHEN length(trim(query)) = 0 THEN 'undefined' WHEN contains(lower(query), '{DEFAULT.domain}') AND regexp_matches(lower(query), '\\b(write|generate|create|implement|code)\\b') THEN 'domain_code_generation'
  WHEN contains(lower(query), '{DEFAULT.domain}') THEN 'domain_question' ELSE 'general_question' END AS query_type FROM questions)"""
CLASSIFY = f"WITH {CLASSIFIED} SELECT qid, query_type FROM classified"


def route_query(spark, d):
    return classify_query(spark, d).select("qid", route.route(F.col("query_type"), "classify").alias("node"))


ROUTE_QUERY = f"WITH {CLASSIFIED} SELECT qid, CASE query_type WHEN 'domain_question' THEN 'rewrite' WHEN 'domain_code_generation' THEN 'not_available' ELSE 'answer_general' END AS node FROM classified"


def route_tool(spark, d):
    actions = F.array(*map(F.lit, ["tool_call", "update_code", "final_answer", "odd"]))
    return I.table(spark, d, "events").select("event_id", route.route(F.element_at(actions, (F.col("event_id") % 4 + 1).cast("int")), "decide").alias("node"))


ROUTE_TOOL = "SELECT event_id, ['call_tool', 'write_code', 'return_code', 'return_code'][event_id % 4 + 1] AS node FROM events"


def rewrite_query(spark, d):
    return I.questions(spark, d).select("qid", route.rewrite_query(F.col("query")).alias("retrieval_query"))


_STOP = ", ".join(f"'{w}'" for w in route.STOP_WORDS)
REWRITE = f"WITH {I.QUESTIONS_SQL} SELECT qid, array_to_string(list_filter({TOKENS.format('query')}, lambda t: t NOT IN ({_STOP}))[1:8], ' ') AS retrieval_query FROM questions"


def grade_answer(spark, d):
    """Answers: benchmark texts; contexts: all documents; questions: the benchmark text after the answer."""
    b = I.table(spark, d, "benchmark").where("item_id IS NOT NULL").select("item_id", "text")
    n = max(1, b.agg(F.max("item_id")).first()[0] + 1)
    item = F.col("doc_id") % n
    docs = I.table(spark, d, "documents").select("doc_id", item.alias("item_id"), ((item + 1) % n).alias("next_id"), F.col("text").alias("context"))
    rows = docs.join(b.withColumnRenamed("text", "answer"), "item_id").join(b.select(F.col("item_id").alias("next_id"), F.col("text").alias("question")), "next_id")
    e = route.grade_answer(F.col("question"), F.col("context"), F.col("answer"))
    return rows.withColumn("e", e).select("doc_id", *[F.col(f"e.{x}").alias(x) for x in ("confidence", "coverage", "relevance", "groundedness", "coherence", "conciseness")])


GRADE = f"""WITH m AS (SELECT max(item_id) + 1 AS items FROM benchmark),
t AS (SELECT doc_id, list_distinct({TOKENS.format('q.text')}) AS q, list_distinct({TOKENS.format('d.text')}) AS c, list_distinct({TOKENS.format('b.text')}) AS a, len({TOKENS.format('b.text')}) AS n
  FROM documents d CROSS JOIN m JOIN benchmark b ON b.item_id = d.doc_id % items JOIN benchmark q ON q.item_id = (d.doc_id % items + 1) % items),
x AS (SELECT *, len(list_intersect(c, a)) AS ca, len(list_intersect(c, q)) AS cq, len(list_intersect(a, q)) AS aq FROM t)
SELECT doc_id, CASE WHEN len(c) + len(a) - ca > 0 THEN round(ca::DOUBLE / (len(c) + len(a) - ca), 6) ELSE 0.0 END AS confidence, CASE WHEN len(q) > 0 THEN round(cq::DOUBLE / len(q), 6) ELSE 0.0 END AS coverage,
  CASE WHEN len(q) > 0 THEN round(aq::DOUBLE / len(q), 6) ELSE 0.0 END AS relevance, CASE WHEN len(a) > 0 THEN round(ca::DOUBLE / len(a), 6) ELSE 0.0 END AS groundedness,
  CASE WHEN n > 0 THEN round(len(a)::DOUBLE / n, 6) ELSE 0.0 END AS coherence, CASE WHEN len(a) > 0 THEN round(least(1.0, 60.0::DOUBLE / len(a)), 6) ELSE 0.0 END AS conciseness FROM x"""


def route_grades(spark, d):
    return I.grades(spark, d).withColumn("r", route.route_grades(F.col("e"), F.col("k"))).select("l_orderkey", "l_linenumber", "r.action", "r.k", "r.modify")


ROUTED = f"""{I.GRADES}, routed AS (SELECT *, CASE
  WHEN next_step = 'continue' AND least(confidence, coverage, relevance, groundedness, coherence, conciseness) >= 0.5 THEN 'continue'
  WHEN next_step = 'modify_query' OR coverage < 0.3 THEN 'modify_query'
  WHEN next_step = 'retrieve_more_info' OR (coverage >= 0.5 AND confidence < 0.5) THEN CASE WHEN k + 1 <= 10 THEN 'retrieve_more_info' ELSE 'modify_query' END
  WHEN next_step = 'rewrite_answer' OR (coverage >= 0.5 AND confidence >= 0.5 AND greatest(relevance, groundedness, coherence, conciseness) < 0.5) THEN 'rewrite_answer'
  ELSE 'undefined' END AS action FROM grades)"""
ROUTE_GRADES = f"WITH {ROUTED} SELECT l_orderkey, l_linenumber, action, CASE action WHEN 'continue' THEN 5 WHEN 'retrieve_more_info' THEN k + 1 ELSE k END::INT AS k, action = 'modify_query' AS modify FROM routed"


def grade_statistics(spark, d):
    """Derived, not of the reference: mean grades by action and k, with subtotals."""
    g = I.grades(spark, d).withColumn("r", route.route_grades(F.col("e"), F.col("k")))
    return g.rollup(F.col("r.action").alias("action"), F.col("k").alias("k0")).agg(F.count("*").alias("n"), F.round(F.avg("e.coverage"), 6).alias("coverage"), F.round(F.avg("e.confidence"), 6).alias("confidence"))


STATISTICS = f"WITH {ROUTED} SELECT action, k AS k0, count(*) AS n, round(avg(coverage), 6) AS coverage, round(avg(confidence), 6) AS confidence FROM routed GROUP BY ROLLUP (action, k0)"


def final_answer(spark, d):
    return route.final_answer(I.messages(spark, d))


FINAL = "SELECT conv_id, max_by(text, turn) AS reply FROM conversations GROUP BY conv_id"


def ask_clarification(spark, d):
    return I.questions(spark, d).select("qid", route.ask_clarification().alias("reply"))


ASK = f"WITH {I.QUESTIONS_SQL} SELECT qid, '{route.CLARIFY}' AS reply FROM questions"


def not_available(spark, d):
    return classify_query(spark, d).where("query_type = 'domain_code_generation'").select("qid", route.not_available().alias("reply"))


UNAVAILABLE = f"WITH {CLASSIFIED} SELECT qid, '{route.UNAVAILABLE}' AS reply FROM classified WHERE query_type = 'domain_code_generation'"


def return_code(spark, d):
    return I.outputs(spark, d).select("doc_id", F.col("content").alias("message_for_user"))


RETURN_CODE = f"WITH {I.OUTPUTS} SELECT doc_id, content AS message_for_user FROM outputs"


def answer_general(spark, d):
    general = classify_query(spark, d).where("query_type IN ('general_question', 'undefined')").select("qid")
    return I.questions(spark, d).join(general, "qid", "left_semi").select("qid", route.answer_general(F.col("query")).alias("reply"))


GENERAL = f"WITH {CLASSIFIED} SELECT qid, 'You said: ' || query AS reply FROM classified WHERE query_type IN ('general_question', 'undefined')"


def loop_edges(spark, d):
    return route.loop_edges(spark)


_EDGES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in route.EDGES)
EDGES = f"SELECT * FROM (VALUES {_EDGES}) t(src, label, dst)"


def loop_reachable(spark, d):
    """Nodes that START reaches; the code branch is built but not wired in. Reachability over a fixed edge list."""
    route.loop_edges(spark).createOrReplaceTempView("ragframe_edges")
    return spark.sql("WITH RECURSIVE r(node, depth) AS (SELECT 'START', 0 UNION ALL SELECT e.dst, depth + 1 FROM r JOIN ragframe_edges e ON e.src = r.node WHERE depth < 10) SELECT DISTINCT node FROM r")


REACHABLE = f"WITH RECURSIVE e(src, label, dst) AS (VALUES {_EDGES}), r(node) AS (SELECT 'START' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r"


def _tool_calls(spark, d):
    i = F.col("page_id")
    tool = F.when(i % 3 == 0, "echo_tool").when(i % 3 == 1, "model_template_tool").otherwise("missing_tool")
    args = F.when(i % 3 == 0, F.create_map(F.lit("text"), F.col("url"))).when(i % 3 == 1, F.create_map(F.lit("name"), F.concat(F.lit("My Model "), i.cast("string")))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return I.table(spark, d, "pages").select(i.alias("id"), tool.alias("tool"), args.alias("args"))


def call_tool(spark, d):
    return T.call_tools(_tool_calls(spark, d), T.register_tools([T]))


CALL = """SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'I got ' || url WHEN 1 THEN 'document = Document(id="MyModel' || page_id || '")' || chr(10) || 'network = document.add(Network(id="MyModel' || page_id || '_network"))' || chr(10) ELSE 'unknown tool: missing_tool' END AS output FROM pages"""


def decide_tool(spark, d):
    """Each question at the three stages of the code branch: nothing known, tool output there, code there."""
    stages = I.questions(spark, d).withColumn("stage", F.explode(F.array(*map(F.lit, range(3)))))
    call = code.decide_tool(F.col("query"), F.when(F.col("stage") == 2, "x = 1").otherwise(""), F.when(F.col("stage") == 1, "made").otherwise(""))
    return stages.withColumn("call", call).select("qid", "stage", "call.action", "call.tool", F.coalesce(F.col("call.args")["text"], F.col("call.args")["name"]).alias("arg"), "call.reason")


_NAME = f"array_to_string(list_transform(list_filter({TOKENS.format('query')}, lambda t: t NOT IN ({_STOP}))[1:3], lambda t: upper(t[1]) || t[2:]), ' ')"
DECIDE = f"""WITH {I.QUESTIONS_SQL}, s AS (SELECT qid, query, unnest([0, 1, 2])::INT AS stage FROM questions)
SELECT qid, stage, ['tool_call', 'update_code', 'final_answer'][stage + 1] AS action, CASE WHEN stage > 0 THEN '' WHEN contains(lower(query), 'model') THEN 'model_template_tool' ELSE 'echo_tool' END AS tool,
  CASE WHEN stage = 0 THEN CASE WHEN contains(lower(query), 'model') THEN {_NAME} ELSE query END END AS arg, ['nothing is known yet', 'the tool''s output is new', 'the code is ready'][stage + 1] AS reason FROM s"""


def _code_questions(spark, d):
    """Code questions, every other one about a model."""
    q = I.questions(spark, d).withColumn("query_type", route.classify_query(F.col("query"))).where("query_type = 'domain_code_generation'")
    return q.select("qid", F.when(F.col("qid") % 8 == 1, F.concat(F.lit("Write a model "), "query")).otherwise(F.col("query")).alias("query"))


_CODE_QUESTIONS = CLASSIFIED + ", coding AS (SELECT qid, CASE WHEN qid % 8 = 1 THEN 'Write a model ' || query ELSE query END AS query FROM classified WHERE query_type = 'domain_code_generation')"
_WRITTEN = f"""CASE WHEN contains(lower(query), 'model') THEN 'document = Document(id="' || replace({_NAME}, ' ', '') || '")' || chr(10) || 'network = document.add(Network(id="' || replace({_NAME}, ' ', '') || '_network"))' || chr(10) ELSE 'I got ' || query END"""


def generate_code(spark, d):
    """The code branch to its end."""
    return code.write_code(_code_questions(spark, d))[0].select("qid", "code", "rounds", F.col("call.action").alias("action"))


GENERATE_CODE = f"WITH {_CODE_QUESTIONS} SELECT qid, {_WRITTEN} AS code, 2 AS rounds, 'final_answer' AS action FROM coding"


def code_trace(spark, d):
    return code.write_code(_code_questions(spark, d))[1]


CODE_TRACE = f"WITH {_CODE_QUESTIONS} SELECT qid, unnest([1, 2]) AS round, unnest(['call_tool', 'return_code']) AS node FROM coding"


def sessions(spark, d):
    """Derived, not of the reference: sessions of a user's events."""
    return stream.sessions(I.table(spark, d, "events")).select("user_id", "session_start", "session_end", "n_events", F.round("total", 6).alias("total"))


SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events, round(sum(value), 6) AS total FROM s GROUP BY user_id, nth"""

QUERIES = {
    "recent_window": (recent_window, RECENT_WINDOW), "role_filter": (role_filter, ROLE_FILTER), "role_counts": (role_counts, ROLE_COUNTS), "render_conversation": (render_conversation, RENDER), "memory_block": (memory_block, BLOCK), "summary_due": (summary_due, SUMMARY_DUE),
    "fold_summary": (fold_summary, FOLD), "append_message": (append_message, APPEND), "reset_turn_state": (reset_turn_state, RESET), "checkpoint": (checkpoint, CHECKPOINT), "classify_query": (classify_query, CLASSIFY), "route_query": (route_query, ROUTE_QUERY),
    "route_tool": (route_tool, ROUTE_TOOL), "rewrite_query": (rewrite_query, REWRITE), "grade_answer": (grade_answer, GRADE), "route_grades": (route_grades, ROUTE_GRADES), "grade_statistics": (grade_statistics, STATISTICS), "final_answer": (final_answer, FINAL),
    "ask_clarification": (ask_clarification, ASK), "not_available": (not_available, UNAVAILABLE), "return_code": (return_code, RETURN_CODE), "answer_general": (answer_general, GENERAL), "loop_edges": (loop_edges, EDGES), "loop_reachable": (loop_reachable, REACHABLE), "call_tool": (call_tool, CALL),
    "decide_tool": (decide_tool, DECIDE), "generate_code": (generate_code, GENERATE_CODE), "code_trace": (code_trace, CODE_TRACE), "sessions": (sessions, SESSIONS),
}
