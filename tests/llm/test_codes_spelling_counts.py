"""Vector codes, spelling groups and token counts against plain Python; their defined cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connection, same

from ragframe.llm import codebooks, counts, registry, spelling

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_spelling_groups"])
def test_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), connection(sf_dir), registry.oracle_sql()[name])


def plain_codes(rows, entries=256, rounds=4):
    """Codes, errors and books of (vec_id, vector) by Python integers."""
    import math

    ints = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows}
    w = len(next(iter(ints.values()))) // 4
    parts = {i: [v[p * w : p * w + w] for p in range(4)] for i, v in ints.items()}
    books = [[parts[i][p] for i in sorted(parts)[:entries]] for p in range(4)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            mine = defaultdict(list)
            for x in parts.values():
                mine[assign(p, x[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*mine[e])] if e in mine else old for e, old in enumerate(books[p])]
    found = {i: [assign(p, x[p]) for p in range(4)] for i, x in parts.items()}
    sha = hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in found.items()}, sha


def test_codes_equal_plain_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 3, 8).astype(np.float32)], int(i % 3)) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1], None) for i in range(200)]  # a group of equal vectors
    codes, books = codebooks.compressed(spark.createDataFrame(rows, VECTORS).repartition(5), entries=32)
    want, sha = plain_codes([r[:2] for r in rows], entries=32)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in codes.collect()} == want
    assert codebooks.digest(books[8]) == sha
    back = {r["vec_id"]: r["embedding"] for r in codebooks.decoded(codes, books).collect()}
    assert np.mean([(np.array(back[i]) - v) ** 2 for i, v, _ in rows]) < 0.25 * np.mean([np.square(v) for _, v, _ in rows])


def test_codes_defined_cases(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5] * 8, 1), (2, None, 1), (3, [None] * 8, 1), (4, [nan] * 8, 1), (5, [inf] * 8, 1), (6, [1e30] * 8, 1), (None, [-0.25] * 8, None), (7, [], None), (8, [1.0] * 6, 2), (1, [0.5] * 8, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], VECTORS + ", dim string, code int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(codebooks.op11_vector_codes(spark, str(tmp_path)).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got] == [(1, "00000000", 0, 0), (1, "00000000", 0, 0), (7, "00000000", 0, 0), (8, "00000000", 0, 0), (None, "02020202", 0, 0)]
    assert len({r["codebooks_sha256"] for r in got}) == 3  # one set of books a dimension
    none = codebooks.compressed(spark.createDataFrame([], VECTORS))[0]
    assert none.count() == 0
    with pytest.raises(ValueError):
        codebooks.compressed(df, entries=300)


def plain_spelling(docs):
    import re

    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: sorted((v for v in n if close(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 2 * n[w] else None for w, v in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_equals_pairs(spark):
    rng = np.random.default_rng(3)
    base = ["kitten", "mittens", "aaaaab", "straße", "école", "ÉCOLES", "bitter", "letter"]
    words = []
    for w in base:
        for k in range(60):
            x = list(w)
            for _ in range(int(rng.integers(0, 3))):
                i = int(rng.integers(0, len(x)))
                x[i : i + int(rng.integers(0, 2))] = "a" * int(rng.integers(0, 2)) if k % 2 else "éA"[int(rng.integers(0, 2))]
            words += ["".join(x)] * int(1 + 200 / (k + 1))
    rng.shuffle(words)
    docs = [(i, " ".join(words[i * 40 : i * 40 + 40]) + ", x÷y×") for i in range(len(words) // 40)] + [(None, "kitten kittén"), (3, None), (4, "")]
    got = spelling.grouped(spelling.vocabulary(spelling.with_typos(spelling.runs(spark.createDataFrame(docs, DOCS)))))
    want = plain_spelling(docs)
    assert {r["word"]: tuple(r)[1:] for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert any(v[1] not in (k, v[0]) for k, v in want.items())  # a chain of forms


def test_spelling_defined_cases(spark):
    assert spelling.grouped(spelling.vocabulary(spelling.runs(spark.createDataFrame([], DOCS)).select("run").withColumnRenamed("run", "word"))).count() == 0
    long = spark.createDataFrame([(1, "wordy " * 60_000 + "wordx " * 3, 5, "a")], DOCS + ", word int, key string")
    r = {r["word"]: r for r in spelling.grouped(spelling.vocabulary(spelling.with_typos(spelling.runs(long)))).collect()}
    assert r["wordy"]["n"] == 60_000 and r["wordx"]["form"] == r["wordx"]["root"] == "wordy"


ODD = [
    None, "", " ", "plain words, and more.", "  two  spaces\n\nlines\t tabs \r\n end \n", "a<|endoftext|>b <|endoftext|>  <|endoftext|>\n", "don't we'll I'm 'sx", "nb\xa0sp \xa0 x　y\x1cz\x85",
    "été ß İ \U0001f600 é", "0123456789 12,5", "<|endoftext|", "x" * 3000, "word " * 5000 + "\n" * 2000 + "end", "﻿mark\x00nul", "一二三。 क्",
]


def test_counts_equal_the_library(spark, tmp_path):
    from hypothesis import HealthCheck, given, settings, strategies as st
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(counts.vocabulary_path())
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(ODD)], DOCS + ", content string")
    got = {r["doc_id"]: r for r in counts.token_counts(docs, f"{tmp_path}/cache").collect()}
    for i, x in enumerate(ODD):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((x or "").encode()), n > 512), x
    own = counts.counter(counts.vocabulary_path())

    @settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\xa0 'a1.<|>"), st.characters(codec="utf-8")), max_size=40))
    def one(x):
        assert own.count([x]) == [len(t.encode(x, add_special_tokens=False).ids)]

    one()


def test_counts_cache(spark, tmp_path, monkeypatch):
    """Distinct misses only are encoded; other tokenizers have counts of their own; a double entry counts once."""
    encoded = spark.sparkContext.accumulator(0)
    plain = counts.counted

    def watched(texts, name):
        seen = texts.collect()
        encoded.add(len(seen))
        return plain(spark.createDataFrame(seen, texts.schema), name)

    monkeypatch.setattr(counts, "counted", watched)
    cache = f"{tmp_path}/cache"
    docs = spark.createDataFrame([(i, f"text {i % 10}") for i in range(200)] + [(None, None), (1, "text 1")], DOCS).repartition(7)
    first = counts.token_counts(docs, cache)
    assert encoded.value == 11 and first.count() == 202
    again = counts.token_counts(docs.unionByName(spark.createDataFrame([(500, "new"), (501, "new"), (502, "")], DOCS)), cache)
    assert encoded.value == 12 and again.count() == 205
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(f"{tmp_path}/double")
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(f"{tmp_path}/double")
    assert counts.token_counts(docs, f"{tmp_path}/double").count() == 202 and encoded.value == 12
    pieces = counts.token_counts(docs, cache, "piece_bpe_32k.model")
    assert encoded.value == 23 and pieces.where("doc_id IS NULL").first()["n_tokens"] == 0
    assert counts.token_counts(spark.createDataFrame([], DOCS), f"{tmp_path}/none").count() == 0


def test_counts_query(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(counts.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in counts.op13_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in texts.items()}
