"""Spelling variants: each word's near words, the form it varies and the root of its forms, by groups instead of pairs.

Two words are near if one inserted, deleted or replaced code point makes one the other. Every word goes to groups: one for
each place (what stands before and after it, the place itself open), where words that differ there meet; one for each
result of a deletion, where it meets the word that is that result. Windows give each group's size and its first two words
by count, which say all that a member needs: how many others there are, and the most frequent of them. A group has at most
one word a letter and place, so it is bounded by alphabet and word length, whatever the input. Pairs are never built; words
combine what their groups say.

A word's form has at least twice its count, so chains of forms are short (below 63), and pointer doubling finds their ends
in six joins at most.

Defined cases: a null text has no words; a null id is the empty text where ids are hashed; repeated rows count each; no words
give no rows; columns beyond doc_id and text aren't read. A run shorter than five code points is no word and is dropped
before anything is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from .common import saved, table

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shortest word, least count, and one in how many (document, run) pairs loses a letter.
SHORTEST, LEAST, TYPO_EVERY = 5, 3, 97
#: How many times more frequent a form is than its variant.
TIMES = 2
#: Stands for the open place of a group; no letter of a word.
OPEN = "?"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """doc_id, run of every run of letters in whole texts, A-Z in lower case; those too short for a word are left out."""
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    return found.where(F.length("run") >= shortest).withColumn("run", F.translate("run", CAPITALS, CAPITALS.lower()))


def with_typos(found: DataFrame, every: int = TYPO_EVERY) -> DataFrame:
    """doc_id, run -> word: where `every` divides the hash of document and run, without the code point that the hash points at."""
    hashed = found.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % every == 0, _without(F.col("run"), at + 1)).otherwise(F.col("run")).alias("word"))


def _without(word: Column, i: Column) -> Column:
    """The word without its i-th code point (from 1)."""
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near(words: DataFrame) -> DataFrame:
    """words (word unique, n) -> word, n_near, best (struct m, word: minus the count of its most frequent near word, ties to the smaller, and that word); words without a near word are left out."""
    word = F.col("word")
    places = F.sequence(F.lit(1), F.length(word))
    open_at = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(OPEN), F.substring(word, i + 1, F.length(word))))
    shorter = F.array_distinct(F.transform(places, lambda i: _without(word, i)))
    member = lambda own: lambda key: F.struct(key.alias("key"), F.lit(own).alias("own"))
    groups = F.concat(F.transform(F.concat(open_at, shorter), member(False)), F.array(member(True)(word)))
    dealt = words.select("word", "n", F.inline(groups))
    ordered = Window.partitionBy("key").orderBy(F.desc("own"), F.desc("n"), "word")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("m"), "word")
    seen = dealt.select(
        "word", F.contains("key", F.lit(OPEN)).alias("replaced"), F.row_number().over(ordered).alias("nth"), F.count("*").over(whole).alias("size"),
        F.first("own").over(whole).alias("owned"), F.first(one).over(whole).alias("first"), F.lead(one).over(ordered).alias("second"),
    )
    leads = F.col("nth") == 1
    told = seen.where((F.col("size") > 1) & (F.col("replaced") | F.col("owned"))).select(
        "word",
        F.when(F.col("replaced") | leads, F.col("size") - 1).otherwise(1).alias("n_near"),  # a longer word meets the one that its deletion gives
        F.when(leads, F.col("second")).otherwise(F.col("first")).alias("best"),
    )
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word unique, form) -> word, root: the end of each chain of forms, by pointer doubling."""
    hops = saved(forms.select("word", F.col("form").alias("root")), "spelling-hops")
    while True:
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = saved(hops.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-hops")
        hops = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return hops


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word unique, n) -> word, form, root, n, n_near, form_n of each."""
    found = words.join(near(words), "word", "left")
    form = -F.col("best.m") >= times * F.col("n")
    told = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))
    told = saved(told, "spelling-forms")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(with_typos(runs(table(spark, sf_dir, "documents"))))
    return grouped(saved(words, "spelling-words"))


#: CRC-32 of a word's bytes by its table of 256 remainders; letters beyond ASCII here have two bytes.
ORACLE_SQL = f"""WITH RECURSIVE remainders AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), i::BIGINT) AS c FROM range(256) r(i))),
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{CAPITALS}', '{CAPITALS.lower()}') AS run FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS times, doc_id || ':' || run AS s FROM found WHERE length(run) >= {SHORTEST} GROUP BY ALL),
coded AS (SELECT *, flatten(list_transform(list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT), lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END)) AS bytes FROM distinct_runs),
hashed AS (SELECT doc_id, run, times, xor(list_reduce(bytes, lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM coded, remainders),
typed AS (SELECT times, CASE WHEN h % {TYPO_EVERY} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {LEAST}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
opened AS (SELECT word, n, i, word[1 : i - 1] AS before, word[i + 1 :] AS after FROM places),
shorter AS (SELECT DISTINCT word, n, before || after AS short FROM opened),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM opened a JOIN opened b ON a.i = b.i AND a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION ALL SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.short = w.word
  UNION ALL SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.short = w.word),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS nth FROM pairs),
told AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= {TIMES} * w.n THEN r.other END AS form, CASE WHEN r.other_n >= {TIMES} * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.nth = 1),
chain(word, stop, steps) AS (SELECT word, word, 0 FROM told UNION ALL SELECT c.word, t.form, c.steps + 1 FROM chain c JOIN told t ON t.word = c.stop WHERE t.form IS NOT NULL)
SELECT t.word, t.form, r.root, t.n, t.n_near, t.form_n FROM told t JOIN (SELECT word, max_by(stop, steps) AS root FROM chain GROUP BY word) r USING (word)"""
