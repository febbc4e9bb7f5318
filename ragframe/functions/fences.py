"""Code fences of a markdown text: one opens at three backticks or tildes or more, and closes at a bare one of its kind that is at least as long."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import TRIM_CHARS, strip

FENCE = r"^ {0,3}(`{3,}|~{3,})"


class Fences:
    """Line after line, whether it stands outside fences and is none."""

    def __init__(self) -> None:
        self.open = ""

    def outside(self, line: str) -> bool:
        mark = re.match(FENCE, line)
        if not mark:
            return not self.open
        if not self.open:
            self.open = mark[1]
        elif mark[1][0] == self.open[0] and len(mark[1]) >= len(self.open) and not line[mark.end() :].strip(TRIM_CHARS):
            self.open = ""
        return False


def mark(line: Column) -> Column:
    """The fence that a line begins with; empty if there is none."""
    return F.regexp_extract(line, FENCE, 1)


def bare(line: Column) -> Column:
    """Whether nothing follows the fence."""
    return F.length(strip(F.regexp_replace(line, FENCE, ""))) == 0


def turns(marks: Column) -> Column:
    """marks: array of (line_no, fence, bare) in order -> array of (line_no, opens) where a fence opens or closes. A fold in the JVM over a file's fence lines alone."""
    turn = "array<struct<line_no: int, opens: boolean>>"
    start = F.struct(F.lit("").alias("open"), F.array().cast(turn).alias("turns"))

    def step(state: Column, m: Column) -> Column:
        opens = state["open"] == ""
        closes = ~opens & (F.substring(m["fence"], 1, 1) == F.substring(state["open"], 1, 1)) & (F.length(m["fence"]) >= F.length(state["open"])) & m["bare"]
        now = F.when(opens, m["fence"]).when(closes, "").otherwise(state["open"])
        added = F.when(opens | closes, F.array(F.struct(m["line_no"].cast("int").alias("line_no"), opens.alias("opens")))).otherwise(F.array().cast(turn))
        return F.struct(now.alias("open"), F.concat(state["turns"], added).alias("turns"))

    return F.aggregate(marks, start, step)["turns"]
