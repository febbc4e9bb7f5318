"""Table functions and tools for SQL texts: `register(spark)`, then

    SELECT doc_id, c.* FROM documents, LATERAL boundary_chunks(text, 600, 60) c
    SELECT * FROM sections(TABLE(lines), 'file')                     -- lines: file, line_no, line
    SELECT echo_tool(url) FROM pages

`sections` says in its analysis how its table must come: by file, lines in order; so it sees one line at a time and holds
one section, whatever the size of a file. The batch operators of `operators.ingest` do the same without SQL texts.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Row, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..config import DEFAULT
from . import tools as T
from .fences import Fences
from .text import TRIM_CHARS

LEVELS = 4


@F.udtf(returnType="chunk_ix int, chunk string")
class BoundaryChunks:
    """(text, size, overlap) -> its pieces, cut at blank lines, line ends or spaces."""

    def eval(self, text: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap):
        from ..operators.ingest import boundary_chunks

        yield from enumerate(boundary_chunks(text or "", size, overlap))


@F.udtf
class Sections:
    """(lines, name of the file column) -> file, section, h1..h4, text: sections begin at headings outside fences."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, file: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or not file.isConstantExpression:
            raise ValueError("sections(TABLE(lines), 'column of the file')")
        kinds = {f.name: f.dataType for f in lines.dataType}
        if missing := {file.value, "line_no", "line"}.difference(kinds):
            raise ValueError(f"sections: no column {', '.join(sorted(missing))}")
        schema = StructType().add(file.value, kinds[file.value]).add("section", LongType())
        for i in range(1, LEVELS + 1):
            schema = schema.add(f"h{i}", StringType())
        return AnalyzeResult(schema.add("text", StringType()), partitionBy=[PartitioningColumn(file.value)], orderBy=[OrderingColumn("line_no")])

    def __init__(self):
        self.fences, self.key, self.n, self.heads, self.lines = Fences(), None, 0, [None] * LEVELS, []

    def eval(self, row: Row, file: str):
        self.key, line = row[file], row["line"]
        if self.fences.outside(line):
            level = len(line) - len(line.lstrip("#"))
            if 0 < level <= LEVELS and line[level : level + 1] == " ":
                if self.lines or self.n:
                    yield self._section()
                self.heads[level - 1 :] = [line[level:].strip(TRIM_CHARS), *[None] * (LEVELS - level)]
                self.lines, self.n = [], self.n + 1
        self.lines.append(line)

    def terminate(self):
        if self.lines:
            yield self._section()

    def _section(self):
        return (self.key, self.n, *self.heads, "\n".join(self.lines))


def register(spark: SparkSession, tools: dict[str, Callable[..., str]] | None = None) -> None:
    """Make the table functions and the tools known to SQL texts of this session. A tool takes its parameters in order, as texts."""
    spark.udtf.register("boundary_chunks", BoundaryChunks)
    spark.udtf.register("sections", Sections)
    for name, tool in (T.register_tools([T]) if tools is None else tools).items():
        spark.udf.register(name, F.udf(lambda *a, tool=tool: None if None in a[: _needed(tool)] else str(tool(*a)), "string"))


def _needed(tool: Callable) -> int:
    """How many parameters a tool can't do without."""
    return sum(p.default is inspect.Parameter.empty for p in inspect.signature(tool).parameters.values())
