"""A book kept up to date equals one cleaned anew, and only reached pages are written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ragframe.operators import etl
from ragframe.operators.book import Book

PAGES = {
    1: ("book/a.md", ["(one)=", "# First", "see <two> and <none>", "---- dropped"]),
    2: ("book/b.md", ["(two)=", "# Second", "```{literalinclude} x.txt", "```"]),
    3: ("book/c.md", ["plain, {ref}`see <one>`", "(two)="]),
    4: ("book/d.md", ["nothing"]),
    5: ("Schemas/e.md", ["```{literalinclude} y.txt", "```", "(three)=", "# Third"]),
}
FILES = {"book/x.txt": "xx <three>", "Schemas/y.txt": "yy", "book/unused.txt": "u"}


def tables(spark, pages, files):
    rows = [(i, p, n, line) for i, (p, ls) in pages.items() for n, line in enumerate(ls)]
    return spark.createDataFrame(rows, "file_ord long, path string, line_no int, line string"), spark.createDataFrame(sorted(files.items()), "path string, content string")


def rows(df):
    return sorted(tuple(r) for r in df.select("kind", "file_ord", "path", "text").collect())


@pytest.mark.parametrize(
    ("change", "edited", "edited_files", "reached"),
    [
        (lambda p, f: p[4][1].append("more"), [4], [], {4}),
        (lambda p, f: p[2][1].__setitem__(1, "# Other"), [2], [], {1, 2}),  # the title of <two>
        (lambda p, f: f.update({"Schemas/y.txt": "new"}), [], ["Schemas/y.txt"], {5}),
        (lambda p, f: p.update({6: ("book/f.md", ["(none)=", "# None", "see <three>"])}), [6], [], {1, 6}),  # now <none> resolves
        (lambda p, f: p.pop(5), [5], [], {2, 5}),  # <three> resolves no more, where x.txt is included
        (lambda p, f: p[3][1].append("# Second again"), [3], [], {1, 3}),  # the last of two anchors of one name
        (lambda p, f: None, [], ["book/unused.txt"], set()),
    ],
)
def test_updates_reach_what_they_must(spark, tmp_path, change, edited, edited_files, reached):
    pages, files = {k: (p, list(ls)) for k, (p, ls) in PAGES.items()}, dict(FILES)
    book = Book(spark, f"{tmp_path}/b")
    assert book.update(*tables(spark, pages, files)) == 1 and rows(book.pages()) == rows(etl.single_markdown(*tables(spark, pages, files)))
    change(pages, files)
    now = tables(spark, pages, files)
    version = book.update(*now, spark.createDataFrame([(i,) for i in edited], "file_ord long"), spark.createDataFrame([(f,) for f in edited_files], "path string"))
    assert version == 2 and rows(book.pages()) == rows(etl.single_markdown(*now))
    assert {r["file_ord"] for r in book.rewritten(2).collect()} == reached
    assert {r["file_ord"] for r in book.rewritten(2).where("gone").collect()} == {i for i in edited if i not in pages}
    assert book.titles().join(now[0].select("file_ord").distinct(), "file_ord", "left_anti").isEmpty()
    assert book._newest().where(F.col("file_ord") == 4).count() == 1
