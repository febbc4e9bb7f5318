"""Vector code compression: every vector becomes one byte a part, the number of its nearest entry in that part's codebook.

Components become integers, so that every distance and every mean is exact, whatever the partitions and their order.
Codebooks (at most ENTRIES x dimension integers, a bound that no input changes) are broadcast. Tasks take Arrow batches of
vectors, compute all distances to a codebook by expanding the norm, |x|^2 - 2xc + |c|^2, with an exact int64 matrix product,
take the first least one, and add up their vectors by entry. These sums, one row an entry and component of each task, meet
in a grouped shuffle; means come back to the driver as the next codebooks.

Defined cases: vectors that are null or hold null or non-finite components take no part, and neither do those with a component
whose square has no place in 64 bits (an integer beyond sqrt(2^61 / dimension), which is 1.9e8 for 64 dimensions). Vectors of
each dimension have codebooks of their own. A dimension that isn't a multiple of the parts is filled up with zeros at its end
(an empty vector has empty parts, code 0 and error 0). Rows without an id are kept, last in order; rows that share an id are
told apart by their components. With fewer vectors than entries each vector is an entry. An empty table gives no rows; columns
beyond the three named are neither read nor returned. label_error is null if it is beyond a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import saved, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances to a codebook are held at a time.
BLOCK = 4096

#: By dimension: one codebook a part, entries x width.
Books = dict[int, list[np.ndarray]]


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, dim, v (floor(scale * x) of each component) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("x")).where(F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))
    most = F.sqrt(F.lit(2.0**61) / F.greatest(F.size("x"), F.lit(1)))
    some = some.where(F.forall("x", lambda x: F.abs(x * scale) < most - 1))
    return some.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def cut(v: np.ndarray, parts: int) -> list[np.ndarray]:
    """A matrix of vectors in equal consecutive parts, filled up with zeros where they aren't equal."""
    width = -(-v.shape[1] // parts)
    filled = np.zeros((len(v), width * parts), np.int64)
    filled[:, : v.shape[1]] = v
    return [filled[:, p * width : (p + 1) * width] for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest entry, ties to the smaller, and their squared distance."""
    to_entry = (book * book).sum(axis=1) - 2 * (x @ book.T)
    at = to_entry.argmin(axis=1)
    return at, to_entry[np.arange(len(x)), at] + (x * x).sum(axis=1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(dimension, places in the batch, matrix) of at most BLOCK vectors each. Columns dim and v are found by name."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        of = np.flatnonzero(dims == dim)
        for i in range(0, len(of), BLOCK):
            places = pa.array(of[i : i + BLOCK])
            yield dim, places, batch.column("v").take(places).flatten().to_numpy().reshape(len(places), dim)


def first_books(ints: DataFrame, entries: int, parts: int) -> Books:
    """Codebooks from the vectors of the smallest ids of each dimension."""
    out = {}
    for r in ints.select("dim").distinct().collect():
        least = ints.where(F.col("dim") == r["dim"]).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        out[r["dim"]] = cut(np.array([x["v"] for x in least], np.int64).reshape(len(least), r["dim"]), parts)
    return out


def sums(ints: DataFrame, books: Books) -> DataFrame:
    """dim, part, entry, at, x: over all vectors whose part is nearest to an entry, their number (at 0) and the sum of each component (at 1, 2, ...)."""
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = {d: [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in of] for d, of in books.items()}
        for batch in batches:
            for dim, _, m in _blocks(batch):
                for part, book, own in zip(cut(m, len(books[dim])), books[dim], total[dim]):
                    at, _ = nearest(part, book)
                    order = at.argsort(kind="stable")
                    entries, starts = np.unique(at[order], return_index=True)
                    counted = np.concatenate([np.ones((len(part), 1), np.int64), part], axis=1)[order]
                    own[entries] += np.add.reduceat(counted, starts, axis=0)
        rows = [(d, p, int(e), own[e].tolist()) for d, of in total.items() for p, own in enumerate(of) for e in np.flatnonzero(own[:, 0])]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["dim", "part", "entry", "s"])

    of_tasks = ints.select("dim", "v").mapInArrow(run, "dim int, part int, entry int, s array<long>")
    each = of_tasks.select("dim", "part", "entry", F.posexplode("s").alias("at", "x"))
    return each.groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))


def trained(ints: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> Books:
    """Codebooks after so many rounds of assignment and means; an entry without vectors stays as it is."""
    books = first_books(ints, entries, parts)
    for _ in range(rounds):
        found: dict[tuple[int, int, int], dict[int, int]] = {}
        for r in sums(ints, books).collect():
            found.setdefault((r["dim"], r["part"], r["entry"]), {})[r["at"]] = int(r["x"])
        books = {d: [b.copy() for b in of] for d, of in books.items()}
        for (d, p, e), x in found.items():
            books[d][p][e] = [x[i] // x[0] for i in range(1, len(x))]
    return books


def coded(ints: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, dim, code (two hex digits a part), error of every vector."""
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, places, m in _blocks(batch):
                found = [nearest(part, book) for part, book in zip(cut(m, len(shared.value[dim])), shared.value[dim])]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                each = 2 * len(found)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(places) for c in ("vec_id", "label", "dim")), pa.array([codes[i : i + each] for i in range(0, len(codes), each)]), pa.array(sum(d for _, d in found))],
                    names=["vec_id", "label", "dim", "code", "error"],
                )

    kinds = dict(ints.dtypes)
    return ints.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """vec_id, label, dim, code, error of every vector that takes part, saved; and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    ints = saved(integers(vectors, id_col, vector_col, label_col, scale), "codebook-integers")
    books = trained(ints, entries, parts, rounds)
    return saved(coded(ints, books), "codebook-codes"), books


def decoded(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding: what the codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.concatenate([book[e] for book, e in zip(shared.value[d], bytes.fromhex(c))])[:d] / scale for d, c in zip(b.column("dim").to_pylist(), b.column("code").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "dim", "code").mapInArrow(run, f"vec_id {dict(codes.dtypes)['vec_id']}, embedding array<double>")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    by_label = saved(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "codebook-labels").withColumnRenamed("label", "same")
    marks = F.create_map(*[F.lit(x) for d, b in books.items() for x in (d, digest(b))]) if books else F.create_map().cast("map<int,string>")
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", marks[F.col("dim")].alias("codebooks_sha256"))


def _oracle(entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """SQL for vectors of one dimension, a multiple of the parts; numbers stay below 2^53, so doubles are exact."""
    sql = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) r(p)),
c0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM x) WHERE e < {entries})"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT vec_id, p, min((list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v))::BIGINT * {entries} + e) AS d FROM x JOIN c{i} c USING (p) GROUP BY vec_id, p)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS v FROM (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, d % {entries} AS e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{i} JOIN x USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (p, e))"""
    return sql + f""",
codes AS (SELECT vec_id, string_agg(printf('%02x', d % {entries}), '' ORDER BY p) AS code, sum(d // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"""


ORACLE_SQL = _oracle()
