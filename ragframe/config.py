"""Parameters of the engine, and the session settings its semantics rely on."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

#: UTC for reproducible times; a map built with a repeated key keeps the last value.
SESSION = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


@dataclass(frozen=True)
class Config:
    """One place for the constants that define semantics."""

    k: int = 5  # hits per store
    k_max: int = 10
    threshold: float = 0.15  # least relevance of a hit
    chunk_size: int = 600  # characters
    chunk_overlap: int = 60
    max_references: int = 10  # hits over all stores
    window: int = 10  # messages in the recent window, and before a summary is due
    pass_bar: float = 0.5  # least grade that passes
    coverage_floor: float = 0.3
    max_rounds: int = 6  # bound of the agent loop
    dim: int = 64  # of the hashing embedder
    domain: str = "domain"  # word that marks a question of the domain
    temperature: float = 0.3
    grader_temperature: float = 0.0
    probe_timeout: int = 30
    probe_tries: int = 3
    answer_tries: int = 3  # calls for one answer until it can be read
    chat_model: str = "rule:offline"
    model_nodes: str = ""  # nodes that ask the chat model, by comma; all, if empty
    embedding_model: str = "hash:offline"
    code_route: bool = False  # whether code questions take the code branch

    @classmethod
    def of(cls, environment: Mapping[str, str] | None = None, conf: Callable[[str, None], str | None] | None = None) -> Config:
        """Defaults, then variables RAGFRAME_<FIELD> of the environment, then settings spark.ragframe.<field> (conf: spark.conf.get)."""
        env, out = os.environ if environment is None else environment, cls()
        for f in fields(cls):
            given = conf(f"spark.ragframe.{f.name}", None) if conf else None
            given = env.get(f"RAGFRAME_{f.name.upper()}") if given is None else given
            if given is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: given.strip().lower() in ("1", "true", "yes") if kind is bool else kind(given)})
        return out


DEFAULT = Config()
