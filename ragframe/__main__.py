"""Ask from the command line: `python -m ragframe --sources DIR --store DIR [--single-query TEXT]`, or question by question until `quit`."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import replace

from .config import Config
from .engine import Engine, session
from .operators import route
from .sources import shared


def main(args: list[str] | None = None, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    cfg = Config.of()
    p = argparse.ArgumentParser(prog="ragframe")
    p.add_argument("--chat-model", default=cfg.chat_model)
    p.add_argument("--embedding-model", default=cfg.embedding_model)
    p.add_argument("--single-query", default="")
    p.add_argument("--regen-vector-stores", action="store_true")
    p.add_argument("--sources", help="folder of stores, each a folder of markdown files")
    p.add_argument("--store", required=True, help="where the chunks are kept")
    p.add_argument("--graph", action="store_true", help="print the control graph as mermaid text and end")
    p.add_argument("--serve", type=int, metavar="PORT", help="answer POST /query?query=... instead")
    a = p.parse_args(args)
    if a.graph:
        return write(route.mermaid())
    engine = Engine(session(), a.store, replace(cfg, chat_model=a.chat_model, embedding_model=a.embedding_model))
    if a.sources:
        engine.load(a.sources, a.regen_vector_stores)
    if a.serve is not None:
        from .serve import server

        server(engine, a.serve).serve_forever()
    elif a.single_query:
        if a.single_query.lower() != "quit":
            write(engine.ask(a.single_query))
    else:
        while (query := read("> ")) != "quit":
            write(engine.ask(query))


if __name__ == "__main__":
    main()
    shared.clear(session())
