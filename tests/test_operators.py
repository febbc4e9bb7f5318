"""Operators on small literals: the cases that the driver's tables don't have."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragframe.config import DEFAULT, Config
from ragframe.functions import providers, tables, text as X, tools
from ragframe.functions.fences import Fences
from ragframe.operators import agent, etl, ingest, memory, retrieve, route
from ragframe.sources import markdown, store


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'array<int>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("plain ", "plain"), ("<think>a</think> b ", "b"), ("a</think>b</think>c", "b"), ("</think>", ""), (None, None), ("", "")],
)
def test_strip_thoughts(spark, given, want):
    assert one(spark, X.strip_thoughts(F.col("c")), c=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [('{"query_type": "domain_question"}', "domain_question"), ("general_question", "general_question"), ('{"query_type": 3}', "undefined"), ("{bad", "undefined"), (None, "undefined"), ('{"other": 1}', "undefined")],
)
def test_coerce_output(spark, given, want):
    assert one(spark, F.coalesce(X.coerce_output(F.col("c")), F.lit("undefined")), c=given) == want


def test_parse_json_takes_defaults(spark):
    for given in ('{"confidence": "high"}', "{", None, "{}"):
        got = one(spark, X.parse_json(F.col("c"), "confidence double, next_step string", {"confidence": 0.0, "next_step": "undefined"}), c=given)
        assert (got["confidence"], got["next_step"]) == (0.0, "undefined")


def test_last_n_of_short_lists(spark):
    for a, want in (([], []), ([1], [1]), ([1, 2, 3, 4], [3, 4])):
        assert one(spark, X.last_n(F.col("a"), 2), a=a) == want


def test_escape_braces(spark):
    assert one(spark, X.escape_braces(F.col("c")), c="a{b}{{c") == "a{{b}}{{{{c"


def test_hashed_vector_is_the_providers(spark):
    texts = ["Hello, hello world", "", "!!", "Über 1 2 3"]
    native = [r["e"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.hashed_vector(F.col("t"), 16).alias("e")).collect()]
    other = providers.setup_embedding("hash:16")(pd.Series(texts)).tolist()
    for a, b in zip(native, other):
        assert a == pytest.approx(b) if a is not None else b is None


def test_split_headers_resets_lower_levels(spark):
    text = "intro\n# A\n## B\nx\n#### C\n# D\n```\n# not\n```\n##### five\n## E"
    df = spark.createDataFrame([("f", text), ("empty", ""), ("none", "no heading")], "k string, text string")
    rows = {(r["k"], r["section"]): r for r in ingest.split_headers(ingest.split_lines(df, "k"), "k").collect()}
    assert [rows["f", i]["h1"] for i in range(6)] == [None, "A", "A", "A", "D", "D"]
    assert [rows["f", i]["h2"] for i in range(6)] == [None, None, "B", "B", None, "E"] and rows["f", 3]["h4"] == "C"
    assert rows["f", 4]["text"] == "# D\n```\n# not\n```\n##### five" and rows["none", 0]["text"] == "no heading" and rows["empty", 0]["text"] == ""


def test_fence_aware_sections(spark):
    text = "# A\n````\n```\n# in\n```\n````\n# B\n```python\n# in\n```x\n# still in\n```\n## C"
    rng = random.Random(2)
    pieces = ["# a", "## b  ", "##### no", "#no", "```", "````", "~~~", "~~~~ x", "```py", "   ```", "    ```", "``", "text", "", "### c\r", "#### d # e"]
    files = [("f", text), ("", ""), ("n", "no heading")] + [(f"r{i}", "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(files, "k string, text string")
    got = {(r["k"], r["section"]): tuple(r[h] for h in ("h1", "h2", "h3", "h4", "text")) for r in ingest.split_headers_fenced(df, "k").collect()}
    assert [got["f", i][:2] for i in range(1, 4)] == [("A", None), ("B", None), ("B", "C")]
    want = {}
    for k, t in files:  # line by line
        fences, heads, n = Fences(), [None] * 4, 0
        for line in t.split("\n"):
            m = re.match(r"(#{1,4}) (.*)$", line) if fences.outside(line) else None
            if m:
                heads, n = [*heads[: len(m[1]) - 1], m[2].strip(), *[None] * (4 - len(m[1]))], n + 1
            want.setdefault((k, n), [*heads, []])[4].append(line)
    assert got == {k: (*v[:4], "\n".join(v[4])) for k, v in want.items()}
    tables.register(spark)
    ingest.split_lines(df, "k").createOrReplaceTempView("fence_lines")
    rows = spark.sql("SELECT * FROM sections(TABLE(fence_lines), 'k')").collect()
    assert {(r["k"], r["section"]): tuple(r[h] for h in ("h1", "h2", "h3", "h4", "text")) for r in rows} == got
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM sections(TABLE(SELECT 1 AS k), 'k')")


def test_functions_in_sql_texts(spark):
    tables.register(spark)
    text = " ".join(f"word{i}" for i in range(200))
    got = spark.sql(f"SELECT c.* FROM VALUES ('{text}'), (''), (NULL) t(text), LATERAL boundary_chunks(text, 100, 20) c ORDER BY chunk_ix").collect()
    assert [r["chunk"] for r in got] == ingest.boundary_chunks(text, 100, 20)
    assert spark.sql("SELECT echo_tool('x') AS a, echo_tool(NULL) AS b, model_template_tool('My Net') AS c").first()[:] == ("I got x", None, tools.model_template_tool("My Net"))


@pytest.mark.parametrize("n", [0, 1, 60, 61, 600, 601, 660, 661, 1140, 1141])
def test_fixed_chunks_reassemble(spark, n):
    text = "".join(chr(0x61 + i % 26) if i % 7 else "\U0001f600" for i in range(n))
    got = [r["chunk"] for r in ingest.chunk_fixed(spark.createDataFrame([(text,)], "text string")).orderBy("chunk_ix").collect()]
    assert all(len(c) <= 600 for c in got) and "".join([c if i == 0 else c[60:] for i, c in enumerate(got)]) == text


def test_boundary_chunks():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(80)) for i in range(4)) + "".join(chr(0x4E00 + i) for i in range(1500))
    got = ingest.boundary_chunks(text)
    assert all(0 < len(c) <= 600 for c in got) and all(c in text for c in got) and text.startswith(got[0]) and text.endswith(got[-1])
    at = 0
    for c in got:
        here = text.find(c, max(0, at - DEFAULT.chunk_overlap))
        assert 0 <= here <= at
        at = max(at, here + len(c))
    assert at == len(text) and ingest.boundary_chunks("") == []


def test_router_truth_table(spark):
    vals, names = (0.0, 0.29, 0.3, 0.49, 0.5, 1.0), ("coverage", "confidence", "relevance", "groundedness", "coherence", "conciseness")
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, X.NEXT_STEPS))).alias("next_step")).withColumn("k", F.explode(F.array(F.lit(5), F.lit(10))))
    for n in names:
        grid = grid.withColumn(n, F.explode(F.array(*map(F.lit, vals))))
    r = grid.select(route.route_grades(F.struct("next_step", *names), F.col("k")).alias("r"))
    counts = {x["action"]: x["count"] for x in r.groupBy("r.action").count().collect()}
    assert counts == {"modify_query": 279936, "undefined": 78720, "retrieve_more_info": 62208, "rewrite_answer": 45568, "continue": 128}


def test_topk_edges_and_question_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("a", 3, [0.0, 0.0]), ("b", 4, [0.0, 1.0]), ("b", 5, [0.15, 0.9886859966642595]), ("b", 6, None)], "store string, chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "qid long, embedding array<double>")
    want = [(1, "a", 1, 1.0, 1), (1, "a", 2, 1.0, 2), (1, "b", 5, 0.15, 1)]
    for _ in range(2):
        got = sorted((r["qid"], r["store"], r["chunk_id"], r["score"], r["rank"]) for r in retrieve.vector_topk(questions, chunks).collect())
        assert got == want
        monkeypatch.setattr(retrieve, "BROADCAST_QUESTIONS", 0)
        monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 1)
    hits = spark.createDataFrame([(1, s, i, 0.5) for i, s in enumerate("zzyyxx")], "qid long, store string, chunk_id long, score double")
    assert [(r["store"], r["chunk_id"]) for r in retrieve.rerank_topn(hits, 3).orderBy("rank").collect()] == [("x", 4), ("x", 5), ("y", 2)]


def test_reference_upsert_and_context(spark):
    log = spark.createDataFrame([(1, 0, "q", "old"), (1, 1, "r", "b"), (1, 2, "q", "new")], "conv_id long, seq long, retrieval_query string, hits string")
    assert {(r["retrieval_query"], r["first_seq"], r["hits"]) for r in retrieve.upsert_reference(log).collect()} == {("q", 0, "new"), ("r", 1, "b")}


def test_memory_windows(spark):
    rows = [(1, i, "system" if i % 3 == 0 else "user" if i % 3 == 1 else "assistant", "{x}") for i in range(14)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = memory.role_filter(memory.recent_window(m, 10))
    assert shown.count() == 7  # three system rows were among the ten
    text = memory.render_conversation(shown).first()["conversation"]
    assert text.startswith("user: {{x}}\n: assistant: {{x}}\n") and text.count("\n") == 7
    state = spark.createDataFrame([(1, "s", 14)], "conv_id long, context_summary string, summarised_till long")
    due = memory.summary_due(m, state).first()
    assert (due["n_new"], due["due"]) == (0, False)
    fresh = memory.fold_summary(m, state.limit(0), 9).first()
    assert fresh["summarised_till"] == 14 and fresh["context_summary"]
    assert one(spark, memory.memory_block(F.col("s"), F.col("c"), F.col("d")), s="", c=None, d="") == ""


def test_append_to_an_empty_log(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame([(1, 5, "user", "a"), (1, 9, "assistant", "b")], "conv_id long, ord int, role string, text string")
    assert [(r["turn"], r["text"]) for r in memory.append_message(empty, new).orderBy("turn").collect()] == [(0, "a"), (1, "b")]


def test_etl_on_a_small_book(spark):
    pages = {
        "book/a.md": "---- x\n(top)=\n# The top\n%comment\ntext {ref}`go <top>` costs $5\n```{literalinclude} inc.py\nlanguage: python\n```\nend\n(eof)=",
        "book/Schemas/b.md": "(one)=\n(two)=\n## Second\nsee <two> and {figure} x.png",
    }
    lines = [(o, p, i, x) for o, (p, t) in enumerate(pages.items()) for i, x in enumerate(t.split("\n"))]
    df = spark.createDataFrame(lines, "file_ord int, path string, line_no int, line string")
    inc = spark.createDataFrame([("book/inc.py", "print(1)")], "path string, content string")
    out = {r["kind"]: r["text"] for r in etl.single_markdown(df, inc).collect()}
    assert out["main"] == "# The top\ntext go (see section: The top) costs $5\n```\n\nprint(1)\n\n```\n\n\nend"
    assert out["schema"] == "## Second\nsee (see section: Second) and \nFigure: x.png"


def test_pages_joined_are_the_whole(spark, tmp_path):
    """Page by page is as all at once, but for a pattern across the border of two pages."""
    pages = ["````{tab-item} A", "```{csv-table}\n{ref}`x <one>`\n(one)=", "(one)=\n# One\n````{tab-item} B\n```{csv-table}\nrow"]
    lines = [(o, f"book/{o}.md", i, x) for o, t in enumerate(pages) for i, x in enumerate(t.split("\n"))]
    df = spark.createDataFrame(lines, "file_ord int, path string, line_no int, line string")
    out = etl.single_markdown(df, spark.createDataFrame([], "path string, content string"))
    want = ["A", "```\nx (see section: One)", "# One\nTable of B (separator='$')\n```\nName $ description $ reference\nrow"]
    assert [r["text"] for r in out.orderBy("file_ord").collect()] == want
    for parts in (1, 3):
        markdown.write_text(out, f"{tmp_path}/{parts}", parts)
        files = sorted((tmp_path / str(parts) / "kind=main").glob("part-*"))
        assert "".join(f.read_text() for f in files) == "\n".join(want) + "\n" and (len(files) == 1 or parts > 1)


def test_stores_must_be_folders(spark, tmp_path):
    for make, message in ((lambda: None, "no store"), (lambda: (tmp_path / "a.md").write_text("x"), "not a store")):
        make()
        with pytest.raises(ValueError, match=message):
            markdown.scan_stores(spark, str(tmp_path))


def test_ingest_twice_is_once(spark, tmp_path):
    for s, n, t in (("s1", "a.md", "# T\nhello world\n## U\nmore"), ("s1", "b.txt", "no"), ("s2", "c.md", "")):
        (tmp_path / "src" / s).mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / s / n).write_text(t)
    path = f"{tmp_path}/store"
    files = markdown.scan_stores(spark, f"{tmp_path}/src")
    kept, rejected = markdown.markdown_only(files)
    assert sorted((r["file_name"], r["text"] == "") for r in kept.collect()) == [("a.md", False), ("c.md", True)] and rejected.first()["status"] == "unsupported"
    for _ in range(2):
        store.append_chunks(ingest.ingest(files, store.open_store(spark, path)), path)
        got = store.open_store(spark, path).orderBy("chunk_ix").collect()
        assert [(r["file_name"], r["chunk_ix"], r["h1"], r["h2"], r["text"]) for r in got] == [("a.md", 0, "T", None, "# T\nhello world"), ("a.md", 1, "T", "U", "## U\nmore")]
    assert not store.drop_stores(spark, path) and store.drop_stores(spark, path, confirm=True) and store.open_store(spark, path).count() == 0


def test_tools(spark):
    known = tools.register_tools([tools])
    assert set(known) == {"echo_tool", "model_template_tool"} and known["echo_tool"]("x") == "I got x" and 'id="AB"' in known["model_template_tool"]("A B")
    text = [r["t"] for r in tools.described(spark, known).select(tools.tool_text(F.col("ord"), F.col("name"), F.col("description"), F.col("args")).alias("t")).collect()]
    assert text[0].startswith("## 1. echo_tool\nReturn what was given. Inputs:\n- text: ")
    calls = spark.createDataFrame([(1, "echo_tool", {"text": "a"}), (2, "nope", {}), (3, "echo_tool", {"bad": "a"})], "id long, tool string, args map<string,string>")
    got = {r["id"]: r["output"] for r in tools.call_tools(calls, known).collect()}
    assert got[1] == "I got a" and got[2] == "unknown tool: nope" and got[3].startswith("bad arguments")


def test_providers():
    waits: list[float] = []

    def broken(_):
        raise RuntimeError("down")

    assert providers.check_model_works(broken, wait=waits.append) == (False, "down") and waits == [1, 2]
    assert providers.check_model_works(providers.setup_llm("rule:offline"))[0]
    with pytest.raises(ValueError):
        providers.setup_llm("nobody:x")


def test_loop_is_bounded_and_ends(spark):
    chunks = ingest.embed(spark.createDataFrame([("s", 1, "the domain of red apples is fruit and red apples"), ("s", 2, "nothing here at all")], "store string, chunk_id long, text string"))
    rows = [(1, "what is the domain of red apples fruit"), (2, "hello there"), (3, "write code for the domain"), (4, ""), (5, "domain zebra quantum")]
    for rounds in (1, 2):
        states, trace = agent.agent_loop(spark.createDataFrame(rows, "qid long, query string"), chunks, Config(max_rounds=rounds))
        got = {r["qid"]: r for r in states.collect()}
        assert sorted(got) == [1, 2, 3, 4, 5] and all(r["node"] in ("reply", "ask_clarification", "answer_general", "not_available") and r["rounds"] <= rounds for r in got.values())
        assert got[2]["node"] == "answer_general" and got[3]["node"] == "not_available" and trace.where(f"round > {rounds}").count() == 0
    replies = {r["qid"]: r["reply"] for r in agent.ask(spark.createDataFrame(rows, "qid long, query string"), chunks, Config(max_rounds=1)).collect()}
    assert all(replies.values())
    with pytest.raises(ValueError):
        agent.ask(spark.createDataFrame([(1,)], "qid long"), chunks)


def test_classification_and_edges(spark):
    got = [one(spark, route.classify_query(F.col("q")), q=q) for q in ("", None, "hi", "the Domain?", "write a domain model")]
    assert got == ["undefined", "undefined", "general_question", "domain_question", "domain_code_generation"]
    assert one(spark, route.rewrite_query(F.col("q")), q="What is the capital, of a b c d e f g h i j?") == "capital b c d e f g h"
    nodes = {n for s, _, d in route.EDGES for n in (s, d)}
    assert all(any(s == n for s, _, _ in route.EDGES) for n in nodes - {"END"})


def test_grades_stay_in_range(spark):
    texts = ["", "a b c", "A b! c c c", "x y z"]
    df = spark.createDataFrame(list(itertools.product(texts, texts, texts)), "q string, c string, a string")
    for r in df.select(route.grade_answer(F.col("q"), F.col("c"), F.col("a")).alias("e")).select("e.*").collect():
        assert all(0 <= r[x] <= 1 for x in ("confidence", "coverage", "relevance", "groundedness", "coherence", "conciseness"))


def test_a_task_hands_on_k_hits_whatever_its_batches(monkeypatch):
    rng = np.random.default_rng(5)
    q = rng.integers(0, 4, (7, 8)) + 0.0
    q[0] = 0.0  # never hits
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    unit, qids = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0), np.arange(7) + 100
    vectors = rng.integers(0, 3, (900, 8)) + 0.0  # many equal scores
    ids, stores = rng.permutation(900), np.array(["abc"[i] for i in rng.integers(0, 3, 900)])
    length = np.linalg.norm(vectors, axis=1)
    scores = np.round(np.divide(unit @ vectors.T, length, out=np.zeros((7, 900)), where=length > 0), 6)
    for held in (retrieve.HELD, 1):
        monkeypatch.setattr(retrieve, "HELD", held)
        monkeypatch.setattr(retrieve, "CHUNK_BLOCK", 30)
        batches = (pd.DataFrame({"chunk_id": ids[i : i + 10], "store": stores[i : i + 10], "embedding": list(vectors[i : i + 10])}) for i in range(0, 900, 10))
        out = pd.concat(retrieve._best_of_task(qids, unit, batches, 4, 0.3))
        assert held == 1 or len(out) <= 7 * 3 * 4
        for i, qid in enumerate(qids):
            for store in "abc":
                want = sorted((-scores[i, c], ids[c]) for c in range(900) if stores[c] == store and scores[i, c] >= 0.3 and length[c] > 0)[:4]
                mine = out[(out["qid"] == qid) & (out["store"] == store)]
                assert sorted(zip(-mine["score"], mine["chunk_id"]))[:4] == want


def test_reachable_hits_give_the_same_references_for_every_k(spark):
    rng = np.random.default_rng(6)
    rows = [(q, s, int(c), float(x), r) for q in range(3) for s in "abcd" for r, (x, c) in enumerate(sorted(((round(x, 1), c) for c, x in enumerate(rng.random(10))), key=lambda t: (-t[0], t[1])), 1)]
    hits = spark.createDataFrame(rows, "qid long, store string, chunk_id long, score double, rank int")
    kept = retrieve.reachable(hits, 5, 10, 6).localCheckpoint()
    assert kept.count() < hits.count()
    for k in range(5, 11):
        got, want = (sorted(map(tuple, retrieve.rerank_topn(h.where(F.col("rank") <= k), 6).collect())) for h in (kept, hits))
        assert got == want


def test_tasks_leave_out_hits_that_no_reference_can_be(spark):
    rng = np.random.default_rng(8)
    vectors = [(f"s{rng.integers(0, 6)}", i, [float(x) for x in rng.integers(0, 3, 6)]) for i in range(3000)]  # many equal scores
    chunks = spark.createDataFrame(vectors, "store string, chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [float(x) for x in rng.integers(0, 4, 6)]) for q in range(9)], "qid long, embedding array<double>")
    whole, few = retrieve.vector_topk(asked, chunks, 10, 0.2).localCheckpoint(), retrieve.vector_topk(asked, chunks, 10, 0.2, (5, 12)).localCheckpoint()
    assert few.count() < whole.count()
    got, want = (sorted(map(tuple, retrieve.reachable(h, 5, 10, 12).select("qid", "store", "chunk_id", "score", "rank").collect())) for h in (few, whole))
    assert got == want
    # fewer hits than n: none may go
    got, want = (sorted(map(tuple, retrieve.vector_topk(asked, chunks.where("chunk_id < 40"), 10, 0.2, *r).select("qid", "store", "chunk_id", "score", "rank").collect())) for r in (((5, 500),), ()))
    assert got == want


def _search_by_hand(unit, vectors, ids, stores, k, n, least):
    """What `reachable` can keep of each question: the k best of each store at or over the n-th best of these."""
    length = np.linalg.norm(vectors, axis=1)
    scores = np.round(np.divide(unit @ vectors.T, length, out=np.zeros((len(unit), len(vectors))), where=length > 0), 6)
    for i, row in enumerate(scores):
        best = [h for s in np.unique(stores) for h in sorted((-row[c], s, ids[c]) for c in np.flatnonzero((stores == s) & (row >= least) & (length > 0)))[:k]]
        yield i, [h for h in sorted(best) if h[0] <= sorted(best)[:n][-1][0]]


def test_short_questions_are_screened_before_they_meet_chunks(monkeypatch):
    rng = np.random.default_rng(15)
    q = np.zeros((60, 24))
    for i in range(60):
        np.add.at(q[i], rng.integers(0, 24, rng.integers(1, 10)), 1.0)  # counts of words by bucket, some of them 2 or 3
    q[1] = q[0]
    q[2] *= 2.5
    vectors = rng.poisson(0.6, (6000, 24)) * rng.choice([1.0, 2.0, 0.37], (6000, 1))  # many equal cosines
    vectors[:40] = 0.0
    vectors[40:60, :] = q[:20]
    unit, ids, stores = q / np.linalg.norm(q, axis=1, keepdims=True), rng.permutation(6000), np.array(["abcde"[i] for i in rng.integers(0, 5, 6000)])
    products, met = [], retrieve._cosines
    monkeypatch.setattr(retrieve, "_cosines", lambda a, b, x, y: products.append(len(x)) or met(a, b, x, y))
    monkeypatch.setattr(retrieve, "_products", lambda single, narrow, some, bound: iter(()) if not len(some) else pytest.fail("a short question went by matrix products"))
    want = dict(_search_by_hand(unit, vectors, ids, stores, 5, 8, 0.3))
    for held, block, lanes in ((retrieve.HELD, 1000, 64), (700, 1000, 2048), (retrieve.HELD, 250, 7)):
        for name, value in (("HELD", held), ("CHUNK_BLOCK", block), ("LANES", lanes)):
            monkeypatch.setattr(retrieve, name, value)
        products.clear()
        batches = (pd.DataFrame({"chunk_id": ids[i : i + 100], "store": stores[i : i + 100], "embedding": list(vectors[i : i + 100])}) for i in range(0, 6000, 100))
        out = pd.concat(retrieve._best_of_task(np.arange(60), unit, batches, 5, 0.3, (5, 8)))
        if held == retrieve.HELD:
            assert sum(products) < 0.1 * 60 * 6000
        for i, hits in want.items():
            mine = out[out["qid"] == i]
            kept = [h for s in "abcde" for h in sorted(zip(-mine["score"][mine["store"] == s], mine["store"][mine["store"] == s], mine["chunk_id"][mine["store"] == s]))[:5]]
            assert [h for h in sorted(kept) if h[0] <= sorted(kept)[:8][-1][0]] == hits


def test_long_and_signed_vectors_meet_all_stores_at_once(monkeypatch):
    rng = np.random.default_rng(16)
    monkeypatch.setattr(retrieve, "CHUNK_BLOCK", 600)
    for vectors, q in ((rng.normal(size=(2500, 16)), rng.normal(size=(9, 16))), (np.abs(rng.normal(size=(2500, 16))), rng.integers(0, 3, (9, 16)) + 0.0), (rng.normal(size=(2500, 16)), rng.integers(0, 2, (9, 16)) + 0.0)):
        vectors[7, 3] = np.inf  # has no direction
        ids, stores = rng.permutation(2500), np.array(["abc"[i] for i in rng.integers(0, 3, 2500)])
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        adds, add = [], retrieve._Held.add
        monkeypatch.setattr(retrieve._Held, "add", lambda *a: adds.append(1) or add(*a))
        batches = (pd.DataFrame({"chunk_id": ids[i : i + 100], "store": stores[i : i + 100], "embedding": list(vectors[i : i + 100])}) for i in range(0, 2500, 100))
        out = pd.concat(retrieve._best_of_task(np.arange(9), unit, batches, 4, 0.1, (4, 6)))
        assert not adds  # a bound over all stores is there from the first block on
        keep = np.arange(2500) != 7
        for i, hits in _search_by_hand(unit, vectors[keep], ids[keep], stores[keep], 4, 6, 0.1):
            mine = out[out["qid"] == i]
            kept = [h for s in "abc" for h in sorted(zip(-mine["score"][mine["store"] == s], mine["store"][mine["store"] == s], mine["chunk_id"][mine["store"] == s]))[:4]]
            assert [h for h in sorted(kept) if h[0] <= sorted(kept)[:6][-1][0]] == hits


def test_text_retrieval_hands_on_only_hits_that_can_rank(spark, sf_dir, monkeypatch):
    from ragframe.plans import ingest_queries

    search, handed = retrieve.vector_topk, []
    monkeypatch.setattr(retrieve, "vector_topk", lambda *a, **b: handed.append(search(*a, **b)) or handed[-1])
    rows = ingest_queries.text_retrieval(spark, sf_dir).count()
    assert rows <= handed[0].count() < 5 * rows  # not k of each of 20 stores


def test_pages_are_rewritten_once(spark):
    lines = spark.createDataFrame([(1, "book/p1.md", 0, "(a)="), (1, "book/p1.md", 1, "# Title"), (2, "book/p2.md", 0, "{ref}`see <a>`")], "file_ord long, path string, line_no int, line string")
    out = etl.single_markdown(lines, spark.createDataFrame([], "path string, content string"))
    assert {r["file_ord"]: r["text"] for r in out.collect()} == {1: "# Title", 2: "see (see section: Title)"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "{ref" not in plan.replace("\\", "")  # no rewrite is left to the two reads of the pages


def test_the_embedder_takes_whole_texts(spark):
    texts = ["", None, "!!", "a", "Ab ab_ab\u00c9\u0130 9:;z`{x}~", " lead", "trail ", "\ud55c\uad6d x\u00df", *[f"w{i} w{i % 3}x" for i in range(50)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    by_hand = df.select("i", F.explode(X.tokens(F.col("t"))).alias("t")).groupBy("i", X.bucket(F.col("t"), 16).alias("b")).count().collect()
    want = np.zeros((len(texts), 16))
    for r in by_hand:
        want[r["i"], r["b"]] = r["count"]
    out = df.select("i", X.hashed_vector(F.col("t"), 16).alias("e"))
    for r in out.collect():
        norm = np.sqrt((want[r["i"]] ** 2).sum())
        assert r["e"] == (list(want[r["i"]] / norm) if norm else None)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no list of words goes to Python


def test_equal_vectors_are_searched_for_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"s{i % 2}", i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)], "store string, chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [1.0, float(q % 3), 0.0]) for q in range(12)] + [(90, None), (91, [0.0, 0.0, 0.0])], "qid long, embedding array<double>")
    rows = lambda df: sorted(map(tuple, df.select("qid", "store", "chunk_id", "score", "rank").collect()))
    want, search, n = rows(retrieve.vector_topk(asked, chunks, 4, 0.2)), retrieve.vector_topk, []
    monkeypatch.setattr(retrieve, "vector_topk", lambda q, *rest: n.append(q.count()) or search(q, *rest))
    assert rows(retrieve.distinct_topk(asked, chunks, 4, 0.2)) == want and n == [4]


def test_few_hits_get_their_texts_without_a_shuffle_of_the_texts(spark, monkeypatch):
    hits = spark.createDataFrame([(1, "a", 3), (2, "a", 3), (2, "b", 4), (3, "b", 9)], "qid long, store string, chunk_id long")
    texts = spark.createDataFrame([("a", 3, "x"), ("b", 4, "y"), ("b", 5, "z")], "store string, chunk_id long, text string")
    monkeypatch.setattr(retrieve, "BROADCAST_HITS", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n, joined in ((4, "BroadcastHashJoin"), (3, "SortMergeJoin")):
            monkeypatch.setattr(retrieve, "BROADCAST_HITS", n)
            out = retrieve.with_texts(hits, texts)
            assert sorted((r["qid"], r["text"]) for r in out.collect()) == [(1, "x"), (2, "x"), (2, "y")]
            assert joined in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_packed_vectors_are_those_of_arrays_and_are_searched_alike(spark):
    rows = [(f"s{i % 3}", i, None if i == 5 else " ".join(f"w{(i * j) % 23}" for j in range(i % 9))) for i in range(200)]  # some without a token
    docs = spark.createDataFrame(rows, "store string, chunk_id long, text string")
    plain, packed = ingest.embed(docs), ingest.embed(docs, packed=True)
    want = {r["chunk_id"]: r["embedding"] for r in plain.collect()}
    got = {r["chunk_id"]: r["embedding"] for r in packed.collect()}
    assert {i: v and np.frombuffer(v).tolist() for i, v in got.items()} == want and None in got.values()
    questions = ingest.embed(spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(20)], "qid long, text string"))
    hits = lambda chunks: sorted(map(tuple, retrieve.vector_topk(questions, chunks, 4).collect()))
    assert hits(packed) == hits(plain) != []
    batch = lambda *sizes: pa.RecordBatch.from_pydict({"chunk_id": [*range(len(sizes))], "store": ["s"] * len(sizes), "embedding": [np.arange(float(n)).tobytes() for n in sizes]})
    assert retrieve._columns(batch(3, 5, 5).slice(1))[2].tolist() == [[0.0, 1, 2, 3, 4]] * 2
    with pytest.raises(ValueError, match="one length"):
        retrieve._columns(batch(3, 5))
