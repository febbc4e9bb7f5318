"""The question loop against a plain loop over each question; the code branch, streamed answers and entry points."""

from __future__ import annotations

import json
import logging
import re
import sys
import threading
import urllib.request
import zlib
from io import StringIO

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ragframe import __main__ as cli, logs, serve
from ragframe.config import DEFAULT, Config
from ragframe.engine import Engine
from ragframe.functions import providers, tools
from ragframe.operators import agent, code, events, ingest, memory, nodes, route
from ragframe.streaming import answers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
CHUNKS = [
    ("a", 1, "the domain of red apples is fruit and red apples grow on trees"), ("a", 2, "domain {of} green pears: fruit"), ("a", 3, "nothing here at all"),
    ("b", 4, "red apples and green pears in the domain of fruit"), ("b", 5, "zebra quantum domain"), ("b", 6, ""), ("b", 7, "what is the domain of red apples fruit"),
    *[("c", 10 + i, f"domain word{i} word{i + 1} apples") for i in range(20)],
]
QUERIES = [
    (1, "what is the domain of red apples fruit"), (2, "hello there"), (3, "write code for the domain"), (4, ""), (5, "domain zebra quantum"), (6, "Is the Domain word3 word4 apples good for pears, trees and fruit?"),
    (7, "domain"), (8, "the domain of things that nobody wrote about anywhere, ever: xylophone"), (9, None), (10, "domain word1 word2 apples domain word1"),
]
HISTORY = [(c, t, ("user", "assistant", "system")[t % 3], f"said {c} {t} {{x}}") for c in (1, 2, 6, 77) for t in range(c + 5)]
SUMMARIES = [(1, "old summary", 4), (77, "other", 2)]


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def vector(text):
    return providers.setup_embedding("hash:64")(pd.Series([text])).iloc[0]


def plain_turn(qid, query, cfg, chunks):
    """One question, one step after the other: (node, k, rounds, reply, messages, references, trace)."""
    q, said = (query or "").lower(), [("user", query)]
    kind = "undefined" if not q.strip() else ("domain_code_generation" if re.search(route.CODE_VERBS, q) else "domain_question") if "domain" in q else "general_question"
    if kind == "domain_code_generation":
        return kind, "not_available", cfg.k, 0, route.UNAVAILABLE, [*said, ("assistant", route.UNAVAILABLE)], {}, ["not_available"]
    if kind != "domain_question":
        reply = f"You said: {query or ''}"
        return kind, "answer_general", cfg.k, 0, reply, [*said, ("assistant", reply)], {}, ["answer_general"]
    content = [w for w in words(query) if w not in route.STOP_WORDS][:8]
    node, k, modify, refs, trace, asked = "rewrite", cfg.k, False, {}, ["rewrite"], None
    for i in range(1, cfg.max_rounds + 1):
        if node == "rewrite":
            asked = " ".join(content[: max(1, len(content) - (i - 1 if modify else 0))])
            said.append(("assistant", asked))
        v, hits = vector(asked), []
        for store in sorted({s for s, _, _ in chunks}):
            own = [(s, i_, t, vector(t)) for s, i_, t in chunks if s == store]
            own = sorted((-round(float(np.dot(v, w)), 6), s, i_, t) for s, i_, t, w in own if v is not None and w is not None)
            hits += [h for h in own if -h[0] >= cfg.threshold][:k]
        best = sorted(hits)[: cfg.max_references]
        refs[asked] = [(r, s, c, -score, t) for r, (score, s, c, t) in enumerate(best, 1)]
        sq = set(words(asked))
        fits = max(best, key=lambda h: (len(set(words(h[3])) & sq), -best.index(h)))[3] if best else ""
        draft = fits
        said.append(("assistant", draft))
        sc, sa = {w for hs in refs.values() for *_, t in hs for w in words(t)}, set(words(draft))
        share = lambda n, d: round(n / d, 6) if d else 0.0
        grades = [share(len(set(words(fits)) & sq), len(sq)), share(len(sc & sq), len(sq)), share(len(sa & sq), len(sq)), share(len(sc & sa), len(sa)), share(len(sa), len(words(draft))), round(min(1.0, 60 / len(sa)), 6) if sa else 0.0]
        confidence, coverage, rest = grades[0], grades[1], grades[2:]
        if min(grades) >= cfg.pass_bar:
            return kind, "reply", cfg.k, i, draft or route.CLARIFY, said, refs, [*trace, "reply"]
        if coverage < cfg.coverage_floor:
            action = "modify_query"
        elif coverage >= cfg.pass_bar and confidence < cfg.pass_bar:
            action = "retrieve_more_info" if k + 1 <= cfg.k_max else "modify_query"
        elif coverage >= cfg.pass_bar and confidence >= cfg.pass_bar and max(rest) < cfg.pass_bar:
            action = "rewrite_answer"
        else:
            action = "undefined"
        k, modify = k + (action == "retrieve_more_info"), modify or action == "modify_query"
        if action == "undefined" or i == cfg.max_rounds:
            return kind, "ask_clarification", k, i, route.CLARIFY, said, refs, [*trace, "ask_clarification"]
        node = "rewrite" if action == "modify_query" else "generate"
        trace.append(node)
    raise AssertionError


@pytest.mark.parametrize("cfg", [DEFAULT, Config(max_rounds=3, k=1, k_max=2, max_references=3, window=4, pass_bar=0.2)])
def test_loop_is_the_plain_loop(spark, cfg):
    asked = spark.createDataFrame([(q, 6 if q == 6 else q, t) for q, t in QUERIES], "qid long, conv_id long, query string")
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))
    log = spark.createDataFrame(HISTORY, "conv_id long, turn long, role string, text string")
    old = spark.createDataFrame(SUMMARIES, "conv_id long, context_summary string, summarised_till long")
    out = agent.converse(asked, chunks, cfg, messages=log, summaries=old)
    states, messages = {r["qid"]: r for r in out.states.collect()}, {}
    for r in out.messages.orderBy("conv_id", "turn").collect():
        messages.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    trace, references = {}, {}
    for r in out.trace.orderBy("qid", "round").collect():
        trace.setdefault(r["qid"], []).append(r["node"])
    for r in out.references.orderBy("qid", "query_seq", "rank").collect():
        references.setdefault(r["qid"], {}).setdefault(r["retrieval_query"], []).extend([(r["rank"], r["store"], r["chunk_id"], r["score"], r["text"])] if r["rank"] else [])
    assert sorted(states) == [q for q, _ in QUERIES]
    ends = set()
    for qid, query in QUERIES:
        kind, node, k, rounds, reply, said, refs, path = plain_turn(qid, query, cfg, CHUNKS)
        s = states[qid]
        assert (s["query_type"], s["node"], s["k"], s["rounds"], s["reply"]) == (kind, node, k, rounds, reply), qid
        before = [(r, t) for c, _, r, t in HISTORY if c == qid]
        assert messages[qid] == before + said and trace[qid] == path and references.get(qid, {}) == refs
        assert {m["retrieval_query"]: len(m["hits"]) for m in s["reference_material"] or []} == {q: len(h) for q, h in refs.items()}
        till = dict((c, t) for c, _, t in SUMMARIES).get(qid, 0)
        new = [(r, t) for i, (r, t) in enumerate(messages[qid]) if i >= till and r in memory.SHOWN]
        kept = dict((c, x) for c, x, _ in SUMMARIES).get(qid, "")
        if len(new) >= cfg.window:
            text = "".join(f"{': ' if r == 'assistant' else ''}{r}: {t}\n" for r, t in new if t is not None).replace("{", "{{").replace("}", "}}")
            fresh = " ".join(re.split(r"\s+", text)[:40])
            assert (s["context_summary"], s["summarised_till"]) == (" ".join(x for x in (kept, fresh) if x), len(messages[qid]))
        else:
            assert (s["context_summary"], s["summarised_till"]) == (kept, till)
        ends.add((node, rounds))
    assert messages[77] == [(r, t) for c, _, r, t in HISTORY if c == 77] and len(ends) >= 3
    assert {n for n, _ in ends} == {"reply", "ask_clarification", "answer_general", "not_available"}


def test_prompts_hold_references_and_memory(spark):
    prompts = []
    providers.register_chat("seen", lambda _: lambda p: p.str.replace("\n", "|"))
    asked = spark.createDataFrame([(1, "the domain of red apples")], "qid long, query string")
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))
    log = spark.createDataFrame(HISTORY, "conv_id long, turn long, role string, text string")
    old = spark.createDataFrame(SUMMARIES, "conv_id long, context_summary string, summarised_till long")
    out = agent.converse(asked, chunks, Config(chat_model="seen:x", max_rounds=1, model_nodes="draft"), messages=log, summaries=old)
    prompts = [r["text"] for r in out.messages.where("conv_id = 1").orderBy("turn").collect()]
    assert "### Document 1/" in prompts[-1] and "old summary" in prompts[-1] and "said 1 4 {{x}}" in prompts[-1]


class Scripted:
    """A chat model that follows the rules from its prompts alone; told to, it thinks aloud and answers a third of the prompts in a form that can't be read, the first time."""

    def __init__(self, broken=True, calls=None):
        self.broken, self.calls = broken, calls

    def __call__(self, prompts):
        return prompts.map(self.one)

    def one(self, p):
        again = "could not be read" in p
        if self.calls is not None:
            self.calls.add(1)
        if self.broken and not again and zlib.crc32(p.encode()) % 3 == 0:
            return "<think>}{</think>" if "Task: rewrite" in p or "Task: draft" in p or "Task: general" in p or "Task: summarise" in p else '<think>so</think>{"query_type": "domain", "confidence": 7'
        p = p.split("\n\nYour last answer")[0]
        wanted = r"\n\nAnswer with (?:plain|one JSON).*\Z"
        p = re.sub(wanted, "", p, flags=re.S)
        query = p.split("User query: ")[1] if "User query: " in p else ""
        refs = p.split("References:\n")[1] if "References:\n" in p else ""
        task = re.match(r"Task: (\w+)", p)[1]
        said = getattr(self, task)(p, query, refs)
        return f"<think>{{a: b}} {task}</think>\n ```json\n{json.dumps(said)}\n``` " if isinstance(said, dict) else f"<think>hm</think> {said}"

    def classify(self, p, query, refs):
        q = query.lower()
        return {"query_type": "undefined" if not q.strip() else ("domain_code_generation" if re.search(route.CODE_VERBS, q) else "domain_question") if "domain" in q else "general_question"}

    def rewrite(self, p, query, refs):
        content = [w for w in words(query) if w not in route.STOP_WORDS][:8]
        last = re.search(r"Last query:\n(.*)", p)
        return " ".join(content if not last else content[: max(1, len(last[1].split(" ")) - 1)])

    def draft(self, p, query, refs):
        return "an answer of words from the references: " + " ".join(sorted(set(words(refs)))[:5])

    def grade(self, p, query, refs):
        good = len(set(words(query)) & set(words(refs.split("\n\nAnswer:\n")[0]))) >= 4
        return dict.fromkeys(agent.GRADES, 0.9 if good else 0.4) | {"coverage": 0.8, "next_step": "continue" if good else "retrieve_more_info" if "zebra" in query else "modify_query", "summary": "missing: much"}

    def general(self, p, query, refs):
        return f"You said: {query}"

    def summarise(self, p, query, refs):
        return "summary of " + str(p.count("user: "))


def test_models_decide_and_write(spark, tmp_path):
    """A model that breaks a third of its answers ends where one that doesn't does; each distinct prompt is asked once, and once more if it was broken; a second run asks nothing."""
    asked = spark.createDataFrame([(q, 6 if q == 6 else q, t) for q, t in QUERIES] + [(11, 11, "hello there"), (12, 12, "hello there")], "qid long, conv_id long, query string")
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))
    log = spark.createDataFrame(HISTORY, "conv_id long, turn long, role string, text string")
    old = spark.createDataFrame(SUMMARIES, "conv_id long, context_summary string, summarised_till long")
    cfg = Config(chat_model="scripted:x", k=8, k_max=9, max_rounds=3)
    ends, counts = [], []
    for broken in (False, True, True):
        calls = spark.sparkContext.accumulator(0)
        model = nodes.Models(spark, cfg, Scripted(broken, calls), path=f"{tmp_path}/{broken}")
        out = agent.converse(asked, chunks, cfg, model, log, old)
        ends.append(({r["qid"]: r for r in out.states.collect()}, sorted(map(tuple, out.added.collect()), key=str), sorted(map(tuple, out.trace.collect()))))
        counts.append(calls.value)
    assert ends[0] == ends[1] == ends[2] and counts[2] == 0
    states = ends[0][0]
    assert {s["node"] for s in states.values()} == {"reply", "ask_clarification", "answer_general", "not_available"}
    assert states[1]["reply"].startswith("an answer of words") and states[2]["reply"] == "You said: hello there" and states[6]["context_summary"].startswith("summary of")
    assert not any("think" in t or "json" in t for *_, t in ends[0][1] if t)
    kept = model.responses.kept()
    assert kept.where("attempt = 1").count() == kept.select("node", "prompt_hash").distinct().count() == counts[0]
    broken_ones = kept.where("attempt = 1 AND NOT fine").count()
    assert counts[1] == counts[0] + broken_ones and counts[0] / 6 < broken_ones < counts[0] / 1.5
    assert {r["node"] for r in kept.select("node").distinct().collect()} == {"classify", "rewrite", "draft", "grade", "general", "summarise"}
    greeted = kept.where("node = 'classify' AND attempt = 1").count()
    assert greeted == 10  # of 12: two say hello and two say nothing, without a history
    assert max(r["attempt"] for r in kept.collect()) == 2


def test_answers_that_never_fit_take_defaults(spark, tmp_path):
    asked = spark.createDataFrame([(1, "the domain"), (2, "hi")], "qid long, query string")
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))
    cfg = Config(chat_model="x:y", answer_tries=2)
    calls = spark.sparkContext.accumulator(0)

    def nonsense(prompts):
        calls.add(len(prompts))
        return prompts.map(lambda p: None if "hi" in p else "{nonsense")

    states = agent.converse(asked, chunks, cfg, nodes.Models(spark, cfg, nonsense, ["classify"], f"{tmp_path}/r")).states
    assert {(r["qid"], r["query_type"], r["node"], r["reply"]) for r in states.collect()} == {(1, "undefined", "answer_general", "You said: the domain"), (2, "undefined", "answer_general", "You said: hi")}
    assert calls.value == 4
    with pytest.raises(ValueError):
        nodes.Models(spark, cfg, nonsense, ["clasify"])


def test_shapes(spark):
    said = ['{"query_type": "domain_question"}', "<think>x</think> general_question \n", '```json\n{"query_type": "odd"}\n```', "", None, 'Sure: {"query_type": "undefined"} - done']
    answer, fine = nodes.QUERY.read(F.col("raw"))
    got = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, raw string").select("i", answer.alias("a"), fine.alias("fine")).orderBy("i").collect()
    assert [(r["a"]["query_type"], r["fine"]) for r in got] == [("domain_question", True), ("general_question", True), ("undefined", False), ("undefined", False), ("undefined", False), ("undefined", True)]
    answer, fine = nodes.EVALUATED.read(F.lit(json.dumps(dict.fromkeys(agent.GRADES, 1) | {"coverage": 1.5, "next_step": "continue"})))
    r = spark.range(1).select(answer.alias("a"), fine.alias("fine")).first()
    assert (r["fine"], r["a"]["coverage"], r["a"]["confidence"], r["a"]["next_step"], r["a"]["summary"]) == (False, 0.0, 1.0, "continue", "")


def test_models_take_the_code_branch(spark, tmp_path):
    def chat(prompts):
        def one(p):
            if "Task: decide" in p:
                return json.dumps({"action": "final_answer"} if "Code:\n" in p else {"action": "update_code"} if "Tool output:\n" in p else {"action": "tool_call", "tool": "echo_tool", "args": {"text": "abc"}, "reason": "first"})
            return "<think>no</think> y = 2" if "Tool output:\nI got abc" in p else "y = 1"

        return prompts.map(one)

    cfg = Config(chat_model="x:y", code_route=True)
    asked = spark.createDataFrame([(3, "write code for the domain"), (4, "hello")], "qid long, query string")
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))
    out = agent.converse(asked, chunks, cfg, nodes.Models(spark, cfg, chat, ["decide", "write"], f"{tmp_path}/r"))
    assert {(r["qid"], r["node"], r["code"]) for r in out.states.collect()} == {(3, "return_code", "y = 2"), (4, "answer_general", "")}


def test_other_embedding_models(spark):
    providers.register_embedder("length", lambda _: lambda texts: texts.map(lambda t: [1.0, float(len(t or ""))]))
    cfg = Config(embedding_model="length:any")
    files = spark.createDataFrame([("s", "a.md", "s/a.md", "# T\nabc")], "store string, file_name string, file_path string, text string")
    known = spark.createDataFrame([], "store string, file_hash string")
    got = ingest.ingest(files, known, cfg).first()
    assert got["embedding"] == [1.0, 7.0] and got["model"] == "length:any"


def test_code_branch(spark):
    asked = spark.createDataFrame([(1, "write a model of the red domain"), (2, "write code"), (3, None)], "qid long, query string")
    states, trace = code.write_code(asked)
    got = {r["qid"]: r for r in states.collect()}
    assert 'Document(id="WriteRedModel")' not in got[1]["code"] and got[1]["code"] == tools.model_template_tool("Write Model Red") and got[2]["code"] == "I got write code" and got[3]["code"] == "I got "
    assert all(r["rounds"] == 2 and r["call"]["action"] == "final_answer" for r in got.values())
    assert [r["node"] for r in trace.where("qid = 1").orderBy("round").collect()] == ["call_tool", "return_code"]
    chat = lambda p: p.map(lambda x: "<think>no</think>" + json.dumps({"action": "update_code" if "Code:\n\n" in x else "odd", "reason": "r"}))
    coder = code.chat_coder(lambda p: p.map(lambda x: "<think>so</think> y = 2 "))
    states, trace = code.write_code(asked.where("qid = 1"), decide=code.chat_decider(chat), write=coder)
    row = states.first()
    assert (row["code"], row["call"]["action"], row["call"]["reason"], row["call"]["args"]) == ("y = 2", "final_answer", "r", {}) and trace.count() == 2
    forever = code.write_code(asked, Config(max_rounds=3), decide=lambda q, c, o: code.decide_tool(q, F.lit(""), F.lit("")))[0]
    assert {r["rounds"] for r in forever.collect()} == {3}
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))
    on = agent.converse(spark.createDataFrame([(3, "write code for the domain"), (2, "hello")], "qid long, query string"), chunks, Config(code_route=True)).states
    assert {(r["qid"], r["node"], r["code"]) for r in on.collect()} == {(3, "return_code", "I got write code for the domain"), (2, "answer_general", "")}


def test_answers_as_a_stream(spark, tmp_path):
    chunks = ingest.embed(spark.createDataFrame(CHUNKS, "store string, chunk_id long, text string"))
    src, schema = f"{tmp_path}/in", "qid long, query string"
    for part in (QUERIES[:2], QUERIES[2:5]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):  # started again it has nothing left to do
        q = answers.answer_stream(stream, chunks, f"{tmp_path}/out", f"{tmp_path}/ck", Config(max_rounds=2))
        q.awaitTermination(240)
        assert q.exception() is None
    want = {r["qid"]: r["reply"] for r in agent.ask(spark.createDataFrame(QUERIES[:5], schema), chunks, Config(max_rounds=2)).collect()}
    assert {r["qid"]: r["reply"] for r in answers.replies(spark, f"{tmp_path}/out").collect()} == want
    seen = answers.updates(spark, f"{tmp_path}/out")
    assert seen.select("batch").distinct().count() == 2 and seen.where("reply = ''").count() > 0


def test_engine_command_line_and_service(spark, tmp_path):
    (tmp_path / "src" / "s").mkdir(parents=True)
    (tmp_path / "src" / "s" / "a.md").write_text("# Apples\nthe domain of red apples is fruit")
    said: list[str] = []
    base = ["--store", f"{tmp_path}/store", "--sources", f"{tmp_path}/src"]
    cli.main([*base, "--single-query", "hello"], write=said.append)
    cli.main([*base, "--single-query", "QUIT"], write=said.append)
    turns = iter(["hello", "write code for the domain", "quit"])
    cli.main([*base, "--regen-vector-stores"], read=lambda _: next(turns), write=said.append)
    assert said == ["You said: hello", "You said: hello", route.UNAVAILABLE]
    with pytest.raises(LookupError):
        Engine(spark, f"{tmp_path}/store", Config(chat_model="rule:missing"))
    engine = Engine(spark, f"{tmp_path}/store")
    for _ in range(2):
        assert engine.ask("hi", 5) == "You said: hi"
    assert [r["text"] for r in engine.messages.where("conv_id = 5").orderBy("turn").collect()] == ["hi", "You said: hi"] * 2
    http = serve.server(engine, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{http.server_address[1]}"
        call = lambda path, data=None: json.load(urllib.request.urlopen(urllib.request.Request(url + path, data=data)))
        assert call("/query?query=good%20day", b"") == {"result": "You said: good day"}
        assert [t["name"] for t in call("/tools")["tools"]] == ["echo_tool", "model_template_tool"]
        assert call("/tools/echo_tool", b'{"text": "x"}') == {"result": "I got x"}
        with pytest.raises(urllib.error.HTTPError):
            call("/nothing", b"")
    finally:
        http.shutdown()


def test_configuration_logs_and_probes():
    got = Config.of({"RAGFRAME_K": "7", "RAGFRAME_CODE_ROUTE": "true", "RAGFRAME_CHAT_MODEL": "x:y"}, lambda key, default: "0.4" if key == "spark.ragframe.threshold" else default)
    assert (got.k, got.code_route, got.chat_model, got.threshold, got.dim) == (7, True, "x:y", 0.4, 64)
    out, err = StringIO(), StringIO()
    log = logs.split_logger("ragframe.test", logging.DEBUG, out, err)
    log.info("one")
    log.warning("two")
    log.debug("three")
    assert "one" in out.getvalue() and "two" not in out.getvalue() and all(x in err.getvalue() for x in ("two", "three", "test_configuration"))
    hung = threading.Event()
    assert providers.check_model_works(lambda _: hung.wait(20), timeout=0.05, retries=2, wait=lambda _: None) == (False, "no answer within 0.05 s")
    hung.set()
    assert route.mermaid().count("-->") == len(route.EDGES) and "grade -->|continue| reply" in route.mermaid()


def test_vector_topk_keeps_k_of_many_ties(spark):
    from ragframe.operators import retrieve

    rng = np.random.default_rng(2)
    v = rng.integers(0, 3, (3000, 4)).astype(float)
    chunks = spark.createDataFrame([(int(i % 7), i, x.tolist()) for i, x in enumerate(v)], "store int, chunk_id long, embedding array<double>")
    asked = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(300)]
    got = {}
    for r in retrieve.vector_topk(spark.createDataFrame(asked, "qid long, embedding array<double>"), chunks, 3, 0.5).orderBy("rank").collect():
        got.setdefault((r["qid"], r["store"]), []).append((r["chunk_id"], r["score"]))
    norm = np.linalg.norm(v, axis=1)
    for q, x in asked[::29]:
        x = np.array(x)
        for s in range(7):
            ids = [i for i in range(s, 3000, 7) if norm[i] and np.linalg.norm(x)]
            score = {i: round(float(x @ v[i] / (norm[i] * np.linalg.norm(x))), 6) for i in ids}
            want = sorted((-score[i], i) for i in ids if score[i] >= 0.5)[:3]
            assert got.get((q, s), []) == [(i, -c) for c, i in want]


def test_state_as_of_any_update(spark):
    """Updates folded to any point: the last value set of each field, null included; what was not set yet is null."""
    rows = [(1, 5, 0, "init", '{"k": 5, "modify": false}'), (1, 5, 10, "rewrite", '{"retrieval_query": "a b"}'), (1, 5, 11, "generate", '{"draft": "x"}'), (1, 5, 12, "grade", '{"k": 6, "modify": true, "e": {"confidence": 0.5, "next_step": "continue"}}'), (1, 5, 20, "rewrite", '{"retrieval_query": null}'), (2, 5, 0, "init", '{"k": 5}')]
    updates = spark.createDataFrame(rows, "qid long, conv_id long, seq int, node string, update string").repartition(3)
    at = lambda upto: {r["qid"]: r for r in events.folded(updates, upto).collect()}
    assert (at(10)[1]["k"], at(10)[1]["retrieval_query"], at(10)[1]["draft"], at(10)[1]["modify"]) == (5, "a b", None, False)
    last = at(None)
    assert (last[1]["k"], last[1]["retrieval_query"], last[1]["draft"], last[1]["modify"], last[1]["e"]["confidence"], last[1]["e"]["next_step"]) == (6, None, "x", True, 0.5, "continue")
    assert last[2]["k"] == 5 and last[2]["e"] is None and at(-1) == {}
    steps = [(r["seq"], r["retrieval_query"], r["draft"]) for r in events.as_of_each(updates, ("retrieval_query", "draft")).where("qid = 1").orderBy("seq").collect()]
    assert steps == [(0, None, None), (10, "a b", None), (11, "a b", "x"), (12, "a b", "x"), (20, None, "x")]
