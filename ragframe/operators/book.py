"""A cleaned corpus that is kept up to date: after edits only the pages that they can reach are cleaned again.

    <path>/pages/   kind, file_ord, path, text; needs: what the page depends on, includes by path and references by name
    <path>/titles/  file_ord, line_no, ref, title: what a page names for others

Both are appended to, version by version; the newest rows of a page count, and a page that went has an empty last one. A page
is reached by its own edit, by an edit of a file that it includes, and by a change of the title that one of its references
resolves to, which may come from an edit, a new page or one that went. Titles are made of pages' own lines, so nothing reaches
further than that. What an update reads of the unchanged pages are their needs and titles, not their lines or texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from ..sources.shared import exists, saved
from . import etl

PAGES = "kind string, file_ord long, path string, text string, needs array<string>, gone boolean, version int"
TITLES = "file_ord long, line_no int, ref string, title string, version int"


@dataclass(frozen=True)
class Book:
    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _newest(self) -> DataFrame:
        w = Window.partitionBy("file_ord").orderBy(F.desc("version"))
        return self._read("pages", PAGES).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")

    def pages(self) -> DataFrame:
        """kind, file_ord, path, text of all pages."""
        return self._newest().where("NOT gone").select("kind", "file_ord", "path", "text")

    def titles(self) -> DataFrame:
        """file_ord, line_no, ref, title as of each page's newest version."""
        now = self._newest().select("file_ord", "version")
        return self._read("titles", TITLES).join(now, ["file_ord", "version"], "left_semi").drop("version")

    def version(self) -> int:
        return self._read("pages", PAGES).agg(F.max("version")).first()[0] or 0

    def rewritten(self, version: int) -> DataFrame:
        """file_ord, gone of the pages that a version wrote."""
        return self._read("pages", PAGES).where(F.col("version") == version).select("file_ord", "gone")

    def update(self, lines: DataFrame, files: DataFrame, edited: DataFrame | None = None, edited_files: DataFrame | None = None) -> int:
        """Bring the book up to the lines (file_ord, path, line_no, line) and includes (path, content) of now; the new version.

        edited: file_ord of pages that are new, have other lines or went; edited_files: path of includes that changed. Without
        them all pages are cleaned. A version that was only half written is never the newest: pages are written last.
        """
        before, version = self._newest(), self.version() + 1
        lines = lines.withColumn("file_ord", F.col("file_ord").cast("long"))
        if edited is None and edited_files is None:
            edited = lines.select("file_ord").union(before.select("file_ord"))
        none = lambda c: self.spark.createDataFrame([], c)
        edited = saved((none("file_ord long") if edited is None else edited.select(F.col("file_ord").cast("long").alias("file_ord"))).distinct(), "book-edited")
        edited_files = none("path string") if edited_files is None else edited_files.select("path").distinct()

        old = self.titles()
        own = lines.join(edited, "file_ord", "left_semi")
        _, fresh = etl.titled_anchors(etl.drop_prefix_lines(own))
        now = saved(old.join(edited, "file_ord", "left_anti").unionByName(fresh.select(*old.columns)), "book-titles")
        refs = etl.last_titles(now)
        was = etl.last_titles(old).withColumnRenamed("title", "was")
        moved = refs.join(was, "ref", "full").where(~F.col("title").eqNullSafe(F.col("was"))).select(F.col("ref").alias("need"))
        causes = moved.union(edited_files.select(F.col("path").alias("need")))
        needing = before.where("NOT gone").select("file_ord", F.explode("needs").alias("need"))
        reached = saved(needing.join(causes, "need", "left_semi").select("file_ord").union(edited).distinct(), "book-reached")

        again = lines.join(reached, "file_ord", "left_semi")
        kept, _ = etl.titled_anchors(etl.drop_prefix_lines(again))
        pages = saved(etl.rewritten_pages(kept, files), "book-pages")
        included = kept.where(F.contains("line", F.lit("{literalinclude}"))).select("file_ord", etl.include_path().alias("need")).groupBy("file_ord").agg(F.collect_set("need").alias("files"))
        cleaned = etl.resolve_refs(pages.withColumn("refs", etl.named_refs(F.col("text"))), refs, "file_ord").join(included, "file_ord", "left")
        needs = F.concat("refs", F.coalesce("files", F.array().cast("array<string>")))
        out = cleaned.select("kind", "file_ord", "path", "text", needs.alias("needs"), F.lit(False).alias("gone"))
        went = reached.join(pages.select("file_ord"), "file_ord", "left_anti").join(before, "file_ord").where("NOT gone").select("kind", "file_ord", "path", F.lit("").alias("text"), F.array().cast("array<string>").alias("needs"), F.lit(True).alias("gone"))
        named = now.join(reached, "file_ord", "left_semi")  # of pages that were reached but not edited as they are
        named.select("file_ord", "line_no", "ref", "title", F.lit(version).alias("version")).write.mode("append").parquet(f"{self.path}/titles")
        out.unionByName(went).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{self.path}/pages")
        return version
