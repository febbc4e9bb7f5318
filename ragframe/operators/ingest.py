"""From files to embedded chunks: type gate, skip of known files, header split, size split, metadata, embedding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..config import DEFAULT, Config
from ..functions import fences
from ..functions.providers import setup_embedding
from ..functions.text import hashed_vector, name_hash, strip

# File types by name ending.
MIME = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf",
    ".json": "application/json", ".xml": "text/xml", ".py": "text/x-python", ".csv": "text/csv", ".png": "image/png", ".jpg": "image/jpeg", ".svg": "image/svg+xml",
}


def file_status(files: DataFrame) -> DataFrame:
    """files (file_name, ...) with mime and status: kept (markdown), unsupported or unknown."""
    ext = F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1))
    mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    out = files.withColumn("mime", F.try_element_at(mime, ext))
    return out.withColumn("status", F.when(F.col("mime").isNull(), "unknown").when(F.contains("mime", F.lit("markdown")), "kept").otherwise("unsupported"))


def skip_existing(new: DataFrame, existing: DataFrame, on: tuple[str, ...] = ("store", "file_hash")) -> DataFrame:
    return new.join(existing.select(*on).distinct(), list(on), "left_anti")


def split_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def split_headers(lines: DataFrame, key: str, levels: int = 4) -> DataFrame:
    """key, section, h1..h4, text: sections begin at headings of level 1-4 outside fences (every fence line toggles).

    The heading line stays in its section; a heading clears the levels below it.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.startswith("line", F.lit("```"))
    x = lines.withColumn("fence", fence).withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    x = x.withColumn("level", F.when(~F.col("inside") & ~F.col("fence"), F.nullif(F.length(F.regexp_extract("line", f"^(#{{1,{levels}}}) ", 1)), F.lit(0))))
    return _sections(x.withColumn("title", F.trim(F.substring(F.col("line"), F.col("level") + 2, F.length("line")))), key, levels)


def _sections(x: DataFrame, key: str, levels: int) -> DataFrame:
    """Sections of lines whose headings have a level and a title."""
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("section", F.count("level").over(upto))
    for n in range(1, levels + 1):
        own = F.last(F.when(F.col("level") == n, F.struct("line_no", F.col("title").alias("t"))), True).over(upto)
        above = F.last(F.when(F.col("level") < n, F.col("line_no")), True).over(upto)
        x = x.withColumn(f"h{n}", F.when(above.isNull() | (own["line_no"] > above), own["t"]))
    heads = [f"h{n}" for n in range(1, levels + 1)]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return x.groupBy(key, "section", *heads).agg(text.alias("text"))


def split_headers_fenced(docs: DataFrame, key: str, levels: int = 4) -> DataFrame:
    """split_headers of texts, with fences that open and close by their kind and length (functions.fences).

    Where fences open and close is found from each file's fence lines alone; windows carry that to all lines.
    """
    lines = split_lines(docs, key)
    marks = lines.withColumn("fence", fences.mark(F.col("line"))).where("fence <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "fence", fences.bare(F.col("line")).alias("bare")))).alias("marks"))
    turns = marks.select(F.col(key).alias("__key"), F.inline(fences.turns(F.col("marks")))).withColumnRenamed("line_no", "__at")
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.join(turns, (F.col(key) == F.col("__key")) & (F.col("line_no") == F.col("__at")), "left")
    x = x.withColumn("inside", F.coalesce(F.last("opens", True).over(upto), F.lit(False))).drop("__key", "__at", "opens")
    x = x.withColumn("level", F.when(~F.col("inside"), F.nullif(F.length(F.regexp_extract("line", f"^(#{{1,{levels}}}) ", 1)), F.lit(0))))
    return _sections(x.withColumn("title", strip(F.substring(F.col("line"), F.col("level") + 1, F.length("line")))), key, levels)


def chunk_fixed(docs: DataFrame, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> DataFrame:
    """docs with chunk_ix and chunk: pieces of size characters, each overlap characters into the last; empty texts have none."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(size - overlap))
    chunks = F.transform(starts, lambda i: F.substring(F.col("text"), i + 1, F.lit(size)))
    return docs.where(F.length("text") > 0).select("*", F.posexplode(chunks).alias("chunk_ix", "chunk"))


def boundary_chunks(text: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> list[str]:
    """Pieces of at most size characters, cut at the last blank line, else newline, else space, else hard; overlap at most that."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for sep in ("\n\n", "\n", " "):
                cut = text.rfind(sep, at + overlap + 1, end)
                if cut > 0:
                    end = cut + len(sep)
                    break
        out.append(text[at:end])
        if end == len(text):
            break
        back = text.find(" ", max(at + 1, end - overlap), end)
        at = back + 1 if back >= 0 else end
    return out


def chunk_boundary(docs: DataFrame, key: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b["text"]) for i, c in enumerate(boundary_chunks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_ix", "chunk"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, chunk_ix int, chunk string")


def attach_metadata(chunks: DataFrame, file_name: Column, file_path: Column) -> DataFrame:
    return chunks.withColumns({"file_hash": name_hash(file_name), "file_name": file_name, "file_path": file_path})


def embedder(cfg: Config = DEFAULT, packed: bool = False) -> Callable[[Column], Column]:
    """Text column to vector column by the configured embedding model; the offline hashing model is a function of our own.

    packed: each vector is the bytes of its doubles instead of an array. Searches take both; tables of bytes are written and
    read far faster than those of arrays, whose elements the JVM takes one by one.
    """
    if cfg.embedding_model == DEFAULT.embedding_model:
        return lambda c: hashed_vector(c, cfg.dim, packed)
    model = setup_embedding(cfg.embedding_model)

    @F.pandas_udf("binary" if packed else "array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        got = model(texts)
        return got.map(lambda v: None if v is None else np.asarray(v, "<f8").tobytes()) if packed else got

    return vectors


def embed(docs: DataFrame, cfg: Config = DEFAULT, text: str = "text", packed: bool = False) -> DataFrame:
    return docs.withColumn("embedding", embedder(cfg, packed)(F.col(text)))


def ingest(files: DataFrame, existing: DataFrame, cfg: Config = DEFAULT, identity: str = "name") -> DataFrame:
    """Chunks (in the store's schema) of the files (store, file_name, file_path, text) whose hash is not there yet.

    identity: name (an edited file is not read again) or content.
    """
    files = file_status(files).where("status = 'kept'").withColumn("file_hash", F.sha2(F.col("file_name" if identity == "name" else "text"), 256))
    new = skip_existing(files, existing)
    keyed = new.withColumn("__f", F.struct("store", "file_hash", "file_name", "file_path"))
    sections = split_headers(split_lines(keyed, "__f"), "__f", 4)
    chunks = chunk_fixed(sections, cfg.chunk_size, cfg.chunk_overlap).drop("text").withColumnRenamed("chunk", "text")
    ordered = chunks.withColumn("chunk_ix", (F.row_number().over(Window.partitionBy("__f").orderBy("section", "chunk_ix")) - 1).cast("int"))
    return embed(ordered.select("__f.*", "chunk_ix", "h1", "h2", "h3", "h4", "text"), cfg).withColumn("model", F.lit(cfg.embedding_model))
