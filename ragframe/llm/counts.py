"""Token counts by way of a digest cache: a text that was counted before, here or in another run, isn't encoded again.

The cache is a table of (tokenizer, content, n_tokens): the digest of the tokenizer (its file, its library's version and the
rules of a count) and the digest of the normalised content. Normalised means as the tokenizer reads it, in UTF-8, null being
empty; nothing that could change a count is touched. A run computes digests once, looks the distinct ones up in the cache by
an equi-join, sends one row of each missing text (combined within tasks before the shuffle, so that copies don't meet in one)
to the encoder, appends the new counts to the cache, and joins the counts back to all documents.

A run that fails appends nothing; two runs at once may append a digest twice, which readers take once. Counts are the
library's own: texts are cut before runs of spaces, tabs and line ends, where no token of this byte-level pattern crosses
(special strings hold none of these characters), and each distinct piece is encoded once a part of a batch; pieces that come
back are remembered. Texts with other white space go to the library whole. So memory depends on neither the length of a text
nor the number of texts.

Defined cases: null and empty texts have no tokens; a null id is returned as it is; repeated rows are counted each; an empty
table gives no rows; columns beyond doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import shared_dir
from .common import in_parts, parts_of, release, saved, table

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Where an application keeps its cache; where it is unset, each run starts with an empty one in the shared folder.
CACHE_SETTING = "spark.ragframe.tokenCache"
#: Raise when the same content may be counted in another way.
RULES = "1: no added special tokens, special strings as the library's default, no truncation, no padding"
CACHE = "tokenizer string, content string, n_tokens long"
#: Pieces whose counts a worker remembers.
REMEMBERED = 300_000

_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_ODD = re.compile(r"[^\S \t\r\n]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Digest of all that decides a count: the tokenizer's file, its library's version and the rules."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    version = __import__(library).__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {version}\n{RULES}".encode()).hexdigest()


class Counter:
    """Numbers of tokens of texts by a tokenizer's file: the tokenizers library for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.known: dict[str, int] = {}
        self.pieces = False  # whether a text's tokens are those of its pieces
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self._encode = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            cut = t.pre_tokenizer
            self.pieces = t.normalizer is None and type(cut).__name__ == "ByteLevel" and not cut.add_prefix_space and cut.use_regex
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(ids) for ids in s.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.pieces:
            return self._encode(texts)
        cut = [[t] if _ODD.search(t) else _PIECE.findall(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {p: self.known[p] for p in set().union(*cut).intersection(self.known)}
        fresh = dict(zip(new, self._encode(new)))
        known = self.known
        known.update(fresh)
        out = [sum(map(known.__getitem__, pieces)) for pieces in cut]
        for p in [p for p in new if len(p) > 64]:  # whole texts and the like don't come back
            del known[p]
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter a worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def counted(texts: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """texts (content, text) -> content, n_tokens. The vocabulary is found on the machine that uses it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary_path(name))
        for b in batches:
            n: list[int] = []
            for first, end in parts_of(b.column(1)):
                n += own.count(b.column(1).slice(first, end - first).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["content", "n_tokens"])
        release()

    return texts.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def cached(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """content, n_tokens that the cache has for a tokenizer's digest; each content once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content string, n_tokens long")
    own = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return own.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, name: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (digest), n_bytes, n_tokens, over_limit of every document. cache: path of the cache, made if it isn't there."""
    spark, tokenizer = docs.sparkSession, tokenizer_digest(vocabulary_path(name))
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.sha2(text.cast("binary"), 256).alias("content")
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), content, F.octet_length(text).cast("long").alias("n_bytes")), "token-rows")
    missing = saved(rows.select("content").distinct().join(cached(spark, cache, tokenizer), "content", "left_anti"), "token-misses")
    if not missing.isEmpty():
        texts = in_parts(docs.select(content, text.alias("text"))).dropDuplicates(["content"])  # one copy leaves each task
        new = counted(texts.join(missing, "content", "left_semi"), name)
        new.select(F.lit(tokenizer).alias("tokenizer"), "content", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    # Saved, so that a content of many documents is split where it meets its count.
    counts = saved(rows.select("content").distinct().join(cached(spark, cache, tokenizer), "content"), "token-counts")
    out = rows.join(counts, "content")
    return out.select("doc_id", "content", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = spark.conf.get(CACHE_SETTING, None) or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents"), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")
