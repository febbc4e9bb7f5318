"""Line dedup: repeated line runs by a suffix array over line ids. DataFrame operations only.

A document is the sequence of its lines (split at newline); a line's id is its 128-bit hash. A run is a stretch of
consecutive lines of MIN_WORDS words or more. A line goes if it lies in a run whose very sequence of lines begins
earlier (in an earlier document, by id and then md5 of the text, or further up in the same one); the first copy stays.

Method. Only lines that occur more than once can be part of a repeated run; they get the rank of their line in the
suffix order. Prefix doubling then refines: the rank over 2**(k+1) lines is the rank over 2**k plus the number of
suffixes of the same rank whose following 2**k lines rank lower. Equal ranks are the intervals of the suffix array
whose longest common prefix is 2**k lines or more; suffixes alone in their interval drop out. From every line the
shortest run that reaches MIN_WORDS is taken, forwards and backwards: these runs cover exactly what all longer repeated
runs cover. A run of m lines is named by m and the ranks of its first and last 2**k lines (2**k <= m < 2**(k+1)), which
is its interval at depth m; all but the interval's first member are later copies. Copies that go on at one distance from
their first are one maximal run (`repeats`), whose length is the longest common prefix of the two suffixes. Doubling
ends at the longest shortest run's length, or as soon as no interval is left.

Ranks come from pre-aggregated counts of distinct (rank, following rank) pairs with two-level running sums, so that no
task sorts the whole, and a line that is a third of all counts as one row there.

Defined cases: null text stays null and has no lines; a null id sorts last; rows that agree in id and text count as one
document and all get its result; a document may lose all lines and then has the empty text; an empty table gives no
rows; `deduped` passes other columns through and needs `doc_id` and `text`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import n_words, saved, table

MIN_WORDS = 50
#: Groups for two-level running sums at most, and ranks of one.
BUCKETS, BUCKET_ROWS = 4096, 512

DOC = ("id", "th")


def _lines(docs: DataFrame) -> DataFrame:
    split = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), n_words("line").alias("w"))


def _running(counts: DataFrame, keys: list[str], bucket: Column, order: list[str], n: str) -> DataFrame:
    """counts with `before`: the sum of n over earlier rows (by bucket, then order) of the same keys, in two levels."""
    with_bucket = counts.withColumn("__b", bucket)
    sums = with_bucket.groupBy(*keys, "__b").agg(F.sum(n).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return with_bucket.withColumn("__i", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(sums, [*keys, "__b"]).withColumn("before", F.col("__o") + F.col("__i")).drop("__b", "__i", "__o")


def _positions(docs: DataFrame) -> tuple[DataFrame, int]:
    """Lines that occur more than once, with their rank r0 in the suffix order; and the bound of ranks."""
    lines = saved(_lines(docs).distinct(), "lines")
    counts = saved(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "line-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = _running(counts, [], F.shiftrightunsigned("h1", 52), ["h1", "h2"], "n").select("h1", "h2", F.col("before").alias("r0"))
    return saved(lines.join(ranked, ["h1", "h2"]).select(*DOC, "pos", "w", "r0"), "line-ranks"), total


def _doubled(at: DataFrame, k: int, total: int) -> DataFrame:
    """at with r{k+1}, null where the following lines are missing or nothing else has the same."""
    now, step = f"r{k}", 1 << k
    w = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(step, step)
    pairs = saved(at.withColumn("__next", F.first(now).over(w)), "line-pairs")
    counts = pairs.where(F.col(now).isNotNull() & F.col("__next").isNotNull()).groupBy(now, "__next").agg(F.count("*").alias("n"))
    buckets = max(1, min(BUCKETS, total // BUCKET_ROWS))
    bucket = F.floor(F.col("__next") * F.lit(buckets) / F.lit(max(1, total))).cast("long")
    ranks = _running(counts, [now], bucket, ["__next"], "n").where("n > 1").select(F.col(now).alias("__a"), F.col("__next").alias("__b"), (F.col(now) + F.col("before")).alias(f"r{k + 1}"))
    out = pairs.join(ranks, (pairs[now] == ranks["__a"]) & (pairs["__next"] == ranks["__b"]), "left").drop("__a", "__b", "__next")
    return saved(out, "line-ranks")


def _runs(at: DataFrame) -> DataFrame:
    """id, th, s, e of the shortest runs of MIN_WORDS words from each line forwards and backwards, within unbroken stretches."""
    by_pos = Window.partitionBy(*DOC).orderBy("pos")
    stretch = at.select(*DOC, "pos", "w", (F.col("pos") - F.row_number().over(by_pos)).alias("seg"))
    seg = Window.partitionBy(*DOC, "seg")
    upto = seg.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = stretch.withColumn("cum", F.sum("w").over(upto)).withColumn("c0", F.col("cum") - F.col("w")).withColumn("first", F.min("pos").over(seg)).withColumn("last", F.max("pos").over(seg)).withColumn("all", F.sum("w").over(seg))
    x = x.withColumn("f", F.min("pos").over(seg.orderBy("c0").rangeBetween(MIN_WORDS, Window.unboundedFollowing)))
    x = x.withColumn("g", F.max("pos").over(seg.orderBy("cum").rangeBetween(Window.unboundedPreceding, -MIN_WORDS)))
    ahead = x.where((F.col("all") - F.col("c0")) >= MIN_WORDS).select(*DOC, F.col("pos").alias("s"), F.coalesce(F.col("f") - 1, F.col("last")).alias("e"))
    behind = x.where(F.col("cum") >= MIN_WORDS).select(*DOC, F.coalesce(F.col("g") + 1, F.col("first")).alias("s"), F.col("pos").alias("e"))
    return ahead.unionByName(behind).distinct()


def repeats(docs: DataFrame) -> DataFrame:
    """id, th, s, e, lcp, first: the maximal runs (lines s to e, lcp of them) that an earlier copy has from `first` (z, id, th, s) on.

    Shortest runs that overlap or touch and lie at one distance from their first copies are one longer run: as far as they
    go on, so far the two suffixes have the same lines.
    """
    at, total = _positions(docs)
    runs = saved(_runs(at).withColumn("m", F.col("e") - F.col("s") + 1), "line-runs")
    longest = runs.agg(F.max("m")).first()[0] or 1
    depth = 0
    while 2 << depth <= longest:
        at = _doubled(at, depth, total)
        depth += 1
        if at.where(F.col(f"r{depth}").isNotNull()).isEmpty():
            break
    # A run whose lines' power of two was never reached holds a stretch that occurs once: it is no repeat.
    power = F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")
    runs = runs.withColumn("k", power).where(F.col("k") <= depth).withColumn("q", (F.col("e") - F.expr("shiftleft(1L, k)") + 1).cast("int"))
    ranks = F.array(*[f"r{k}" for k in range(depth + 1)])
    where = lambda rank: at.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("pos").alias("__pos"), ranks.alias(rank))
    on = lambda pos: F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")) & (F.col(pos) == F.col("__pos"))
    named = runs
    for pos, rank in (("s", "ra"), ("q", "rb")):
        named = named.join(where(rank), on(pos)).drop("__id", "__th", "__pos").withColumn(rank, F.get(rank, F.col("k")))
    named = named.select(*DOC, "s", "e", "m", "ra", "rb")
    named = saved(named.where("ra is not null and rb is not null"), "line-named")
    place = F.struct(F.col("id").isNull().alias("z"), "id", "th", "s")
    # A table of its own, so that both sides of the join are plain shuffles, whose large parts Spark splits: an interval is one key.
    firsts = saved(named.groupBy("m", "ra", "rb").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-firsts")
    later = named.join(firsts, ["m", "ra", "rb"]).where(place > F.col("first"))
    later = later.select(*DOC, "s", "e", F.col("first.z").alias("z"), F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"), (F.col("s") - F.col("first.s")).alias("apart"))
    diagonal = [*DOC, "z", "first_id", "first_th", "apart"]
    w = Window.partitionBy(*diagonal).orderBy("s", "e")
    runs = later.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("nth", F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), 1).otherwise(0)).over(w))
    runs = runs.groupBy(*diagonal, "nth").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    first = F.struct("z", F.col("first_id").alias("id"), F.col("first_th").alias("th"), (F.col("s") - F.col("apart")).alias("s"))
    return runs.select(*DOC, "s", "e", (F.col("e") - F.col("s") + 1).alias("lcp"), first.alias("first"))


def removed(docs: DataFrame) -> DataFrame:
    """id, th, gaps: for documents that lose lines, the (s, e) stretches that go, apart from each other and in order."""
    w = Window.partitionBy(*DOC).orderBy("s", "e")
    parts = repeats(docs).withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), 1).otherwise(0))
    parts = parts.withColumn("gap", F.sum("new").over(w)).groupBy(*DOC, "gap").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return parts.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gaps"))


def cut(docs: DataFrame) -> DataFrame:
    """docs with `__gaps` (null where nothing goes). Texts are shuffled once, at every size: how many documents lose lines has no bound."""
    gaps = saved(removed(docs), "line-gaps")
    gaps = gaps.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gaps").alias("__gaps")).hint("merge")
    return docs.join(gaps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.md5(F.col("text").cast("binary")) == F.col("__th")), "left").drop("__id", "__th")


def kept_text() -> Column:
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("__gaps", lambda g: (i >= g["s"]) & (i <= g["e"])))
    return F.when(F.col("__gaps").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def n_cut() -> Column:
    return F.coalesce(F.aggregate("__gaps", F.lit(0).cast("long"), lambda a, g: a + g["e"] - g["s"] + 1), F.lit(0).cast("long"))


def deduped(docs: DataFrame) -> DataFrame:
    """docs with their texts cut, and n_chars, if there, counted anew; documents that lose every line go."""
    out = cut(docs).withColumn("__n", n_cut())
    lost = F.col("__n") >= F.size(F.split("text", "\n", -1))
    out = out.where(F.col("__gaps").isNull() | ~lost).withColumn("text", kept_text())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gaps").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return cut(docs).select("doc_id", lines.alias("n_lines"), n_cut().alias("n_removed"), kept_text().alias("text"))


ORACLE_SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, text, md5(text) AS th FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, th, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
cum AS (
  SELECT doc_id, th, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w,
         sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) OVER (PARTITION BY doc_id, th ORDER BY pos) AS cum
  FROM lines),
ends AS (
  SELECT a.doc_id, a.th, a.pos AS s, min(b.pos) AS e FROM cum a JOIN cum b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.th = b.th AND b.pos >= a.pos
  WHERE b.cum - a.cum + a.w >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, b.th, max(a.pos) AS s, b.pos AS e FROM cum a JOIN cum b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.th = b.th AND b.pos >= a.pos
  WHERE b.cum - a.cum + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.th, b.pos),
runs AS (SELECT e.*, array_to_string(list_slice(string_split(d.text, chr(10)), s, e), chr(10)) AS run FROM ends e JOIN docs d ON e.doc_id IS NOT DISTINCT FROM d.doc_id AND e.th = d.th),
later AS (SELECT *, row_number() OVER (PARTITION BY md5(run), e - s ORDER BY doc_id NULLS LAST, th, s) AS nth FROM runs),
gone AS (SELECT DISTINCT l.doc_id, l.th, c.pos FROM later l JOIN cum c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.th = c.th AND c.pos BETWEEN l.s AND l.e WHERE nth > 1),
texts AS (
  SELECT c.doc_id, c.th, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM cum c LEFT JOIN gone g ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.th = g.th AND c.pos = g.pos GROUP BY c.doc_id, c.th)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN texts t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND md5(d.text) = t.th
"""
