"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_fingerprint, brute_lines, make, near_copies, text


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(12)
    passage = "\n".join(text(rng, 30) for _ in range(2))
    rows = near_copies(rng, 30) + [(100 + i, f"{text(rng, 80)}\n{passage}\n{text(rng, 20)}", "en", f"s{i % 3}") for i in range(20)]
    rows += [(200, "1234 !!", "en", "s0"), (201, None, "en", "s0"), (202, "", None, None), (0, rows[0][1], "en", "s")]
    docs = make(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    first = stages["language_id"](spark, docs, "")
    assert first.columns == docs.columns and Counter(r["doc_id"] for r in first.collect()) == Counter(i for i, *_ in rows if i not in (200, 201, 202))
    second = stages["line_dedup"](spark, first, "")
    want = {k: v for k, v in brute_lines([(r["doc_id"], r["text"]) for r in first.collect()]).items() if v}
    got = second.collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(i, v) for (i, _), v in want.items()} and all(r["n_chars"] == len(r["text"]) for r in got)
    third = stages["near_dedup"](spark, second, "")
    ids = [r["doc_id"] for r in got]
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(set(brute_components(ids, [brute_fingerprint(r["text"]) for r in got])))
    fourth = stages["mix_sources"](spark, third, "")
    assert fourth.columns == docs.columns and set(fourth.select("text").distinct().collect()) <= set(third.select("text").collect())
    last = stages["best_fit_packing"](spark, fourth, "").collect()
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == Counter(r["doc_id"] for r in fourth.collect())


def test_stages_with_null_ids_and_repeats(spark):
    import random

    rng = random.Random(15)
    own = [text(rng, 70) for _ in range(6)]
    rows = [(None, own[0], None, None), (None, own[1], "en", "s0"), (None, own[1], "en", "s0"), (3, own[2], "en", None), (3, own[3], "fr", "s1"), (3, own[3], "fr", "s1"), (4, own[3], "fr", "s1"), (5, None, None, "s1"), (None, None, None, None), (6, own[4] * 40, "en", "s0")]
    docs = make(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        if name in ("language_id", "line_dedup", "near_dedup"):
            got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
            kept = {(None, own[0]): 1, (None, own[1]): 2, (3, own[2]): 1, (3, own[3]): 2, (6, own[4] * 40): 1}
            if name == "language_id":
                kept[4, own[3]] = 1
            elif name == "near_dedup":
                kept = dict.fromkeys(kept, 1)
            assert got == kept, name
    assert docs.count() > 0 and docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_run_on_small_and_empty_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name(spark):
    """Columns beyond those of documents pass whatever their names, those included that operators use themselves."""
    import random

    rng = random.Random(21)
    rows = near_copies(rng, 6) + [(100 + i, text(rng, 60), "en", f"s{i % 2}") for i in range(6)]
    docs = make(spark, rows).drop("rate", "copies", "score", "row", "id")
    odd = ["__id", "__source", "__lang", "Rate", "a.b", "Text", "__th", "carried_row", "__gaps", "seed", "c0", "told", "row`s"]
    docs = docs.select("*", *[F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(odd)])
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == names
        got = docs.collect()
        assert got and all(r[names.index(n)] == f"{i} {r['doc_id']}" for r in got for i, n in enumerate(odd)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
