"""From a book's page sources to one cleaned text: lines carry (file_ord, line_no), state is carried by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.text import dropped_line, regex_rewrites, strip
from ..sources.shared import saved

FILE = ("file_ord",)


def scan_toc(lines: DataFrame) -> DataFrame:
    """Listed paths in order: ord, path. Lines with `file:`; a path without suffix is markdown; notebooks are left out."""
    path = strip(F.get(F.split("line", "file:", -1), F.lit(1)))
    listed = lines.where(F.contains("line", F.lit("file:"))).withColumn("path", path)
    return default_suffix(listed)


def default_suffix(paths: DataFrame) -> DataFrame:
    named = paths.withColumn("path", F.when(F.rlike("path", F.lit(r"\.[^/.]+$")), F.col("path")).otherwise(F.concat("path", F.lit(".md"))))
    return named.where(~F.contains("path", F.lit("ipynb")))


def drop_prefix_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~dropped_line(F.col("line")))


def _anchor(c):
    return F.startswith(c, F.lit("(")) & F.endswith(strip(c), F.lit(")="))


def capture_anchors(lines: DataFrame, file: tuple[str, ...] = FILE) -> tuple[DataFrame, DataFrame]:
    """Lines without `(name)=` anchors; and refs (ref, title): each anchor's title is the next line that isn't one.

    Of several anchors in a row the last counts, as does the last of equal names in the whole corpus.
    """
    kept, titles = titled_anchors(lines, file)
    return kept, last_titles(titles, file)


def last_titles(titles: DataFrame, file: tuple[str, ...] = FILE) -> DataFrame:
    """ref, title: of equal names the last in the corpus."""
    return titles.groupBy("ref").agg(F.max_by("title", F.struct(*file, "line_no")).alias("title"))


def titled_anchors(lines: DataFrame, file: tuple[str, ...] = FILE) -> tuple[DataFrame, DataFrame]:
    """Lines without anchors; and what each page names: file, line_no, ref, title."""
    w = Window.partitionBy(*file).orderBy("line_no")
    x = lines.withColumn("anchor", _anchor(F.col("line"))).withColumn("after", F.lead("line").over(w))
    found = x.where(F.col("anchor") & F.col("after").isNotNull() & ~_anchor(F.col("after")))
    ref = F.concat(F.lit("<"), F.regexp_extract("line", r"^\((.*)\)=", 1), F.lit(">"))
    title = F.concat(F.lit("(see section: "), strip(F.replace("after", F.lit("#"), F.lit(""))), F.lit(")"))
    return x.where(~F.col("anchor")).drop("anchor", "after"), found.select(*file, "line_no", ref.alias("ref"), title.alias("title"))


def include_path() -> Column:
    """The file that an include line (path, line) names, beside its page."""
    return F.concat(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("/"), strip(F.split_part("line", F.lit("{literalinclude}"), F.lit(2))))


def include_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines with `{literalinclude} name` become the named sibling file, fenced. lines: dir, line; files: path, content."""
    mark = F.lit("{literalinclude}")
    name = strip(F.split_part("line", mark, F.lit(2)))
    keyed = lines.withColumn("__inc", F.contains("line", mark)).withColumn("__path", F.when(F.col("__inc"), F.concat(F.col("dir"), F.lit("/"), name)))
    joined = keyed.join(files.select(F.col("path").alias("__p"), "content"), F.col("__path") == F.col("__p"), "left")
    text = F.when(F.col("__inc"), F.concat(F.lit("```\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n```\n"))).otherwise(F.col("line"))
    return joined.withColumn("included", F.col("__inc")).withColumn("line", text).drop("__inc", "__path", "__p", "content")


def include_state(lines: DataFrame, file: tuple[str, ...] = FILE) -> DataFrame:
    """The fence that closes an include's block becomes an empty line: the first fence line after the include."""
    kind = F.when(F.contains("line", F.lit("{literalinclude}")), "include").when(F.contains("line", F.lit("```")), "fence")
    before = Window.partitionBy(*file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("__k", kind)
    x = x.withColumn("closes", F.coalesce((F.col("__k") == "fence") & (F.last("__k", True).over(before) == "include"), F.lit(False)))
    return x.withColumn("line", F.when(F.col("closes"), "").otherwise(F.col("line"))).drop("__k")


def split_by_path(rows: DataFrame, path: str = "path") -> DataFrame:
    return rows.withColumn("kind", F.when(F.contains(path, F.lit("Schemas/")), "schema").otherwise("main"))


def concat_ordered(lines: DataFrame, by: tuple[str, ...], order: tuple[str, ...], sep: str = "\n") -> DataFrame:
    """One text a group, its lines in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(*by).agg(F.array_join(F.transform(parts, lambda s: s["line"]), sep).alias("text"))


def named_refs(text: Column) -> Column:
    """The distinct `<ref>`s of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<[^<>\s]+>"), F.lit(0)))


def resolve_refs(texts: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Every known `<ref>` in the texts becomes its title; each text meets only the refs that it has."""
    names = texts.select(F.col(key).alias("__key"), F.explode(named_refs(F.col("text"))).alias("ref"))
    pairs = names.join(refs, "ref").groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("ref", "title"))).alias("__refs"))
    joined = texts.join(pairs, texts[key].eqNullSafe(pairs["__key"]), "left")
    done = F.aggregate(F.coalesce("__refs", F.array().cast("array<struct<ref:string,title:string>>")), F.col("text"), lambda t, r: F.replace(t, r["ref"], r["title"]))
    return joined.withColumn("text", done).drop("__key", "__refs")


def single_markdown(lines: DataFrame, files: DataFrame) -> DataFrame:
    """kind, file_ord, path, text: all pages (file_ord, path, line_no, line) cleaned, with their includes and references.

    Each page is rewritten by itself, with the line end that joins it to the next, so that no task holds more than a page;
    the texts of a kind joined by line ends in the order of file_ord are the whole (see sources.markdown.write_text). Only
    a pattern that would begin in one page and end in the next isn't found. The rewritten pages are saved: their references
    are looked up first, and then replaced.
    """
    kept, refs = capture_anchors(drop_prefix_lines(lines))
    return resolve_refs(saved(rewritten_pages(kept, files), "pages"), refs, "file_ord")


def rewritten_pages(kept: DataFrame, files: DataFrame) -> DataFrame:
    """kind, file_ord, path, text of pages (lines without anchors) with their includes, rewritten, references still by name."""
    stated = include_state(kept).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    whole = split_by_path(include_files(stated, files))
    pages = concat_ordered(whole, ("kind", "file_ord", "path"), ("line_no",))
    pages = pages.withColumn("text", regex_rewrites(F.concat("text", F.lit("\n"))))
    return pages.withColumn("text", F.substring("text", F.lit(1), F.length("text") - 1))
