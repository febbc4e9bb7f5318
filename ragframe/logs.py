"""Logging of the driver by level: what informs goes to one stream, all else to another."""

from __future__ import annotations

import logging
import sys
from typing import TextIO


class ByLevel(logging.Handler):
    """INFO to the first stream, other levels to the second; the streams are looked up when something is logged, unless given."""

    def __init__(self, informs: TextIO | None = None, others: TextIO | None = None):
        super().__init__()
        self.informs, self.others = informs, others
        self.setFormatter(logging.Formatter("{asctime} {levelname} {name}.{funcName}: {message}", style="{"))

    def emit(self, record: logging.LogRecord) -> None:
        out = (self.informs or sys.stdout) if record.levelno == logging.INFO else (self.others or sys.stderr)
        out.write(self.format(record) + "\n")


def split_logger(name: str = "ragframe", level: int = logging.INFO, informs: TextIO | None = None, others: TextIO | None = None) -> logging.Logger:
    """The logger of this name with one such handler; called again, it replaces it."""
    logger = logging.getLogger(name)
    logger.handlers[:] = [ByLevel(informs, others)]
    logger.propagate = False
    logger.setLevel(level)
    return logger
