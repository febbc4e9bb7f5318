"""Model providers: offline rules by default, others plugged in by prefix. A provider maps a batch of prompts to texts."""

from __future__ import annotations

import inspect
import queue
import threading
import time
from collections.abc import Callable

import numpy as np
import pandas as pd

Chat = Callable[[pd.Series], pd.Series]
_CHATS: dict[str, Callable[[str], Chat]] = {}
_EMBEDDERS: dict[str, Callable[[str], Callable[[pd.Series], pd.Series]]] = {}
_MODELS: dict[str, Callable[[], set[str]]] = {}


def register_chat(prefix: str, factory: Callable[[str], Chat], models: Callable[[], set[str]] | None = None) -> None:
    """A provider of chat models; `models` lists what it has, if it can tell."""
    _CHATS[prefix] = factory
    if models:
        _MODELS[prefix] = models


def register_embedder(prefix: str, factory) -> None:
    _EMBEDDERS[prefix] = factory


def _made(kind: dict, name: str, **settings):
    """What the provider makes; of the settings it gets those that it knows."""
    prefix, _, rest = name.partition(":")
    if prefix.lower() not in kind:
        raise ValueError(f"no provider is registered for {name!r}; known: {sorted(kind)}")
    factory = kind[prefix.lower()]
    known = inspect.signature(factory).parameters
    return factory(rest, **{k: v for k, v in settings.items() if k in known})


def setup_llm(name: str, **settings) -> Chat:
    """The chat model of a name `provider:model`. settings: temperature, for providers that take it."""
    return _made(_CHATS, name, **settings)


def setup_embedding(name: str):
    """The embedding model of a name `provider:model`."""
    return _made(_EMBEDDERS, name)


def check_model_present(name: str) -> None:
    """Raise if no provider knows the model; providers that list their models are asked."""
    prefix, _, model = name.partition(":")
    _made(_CHATS | _EMBEDDERS, name)
    known = _MODELS.get(prefix.lower())
    if known is not None and model not in known():
        raise LookupError(f"provider {prefix!r} has no model {model!r}; it has {sorted(known())}")


def check_model_works(model: Chat, timeout: float = 30, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> tuple[bool, str]:
    """Probe a model before a job; a try ends after `timeout` seconds, and tries are 2**attempt seconds apart."""
    why = "no try"
    for attempt in range(retries):
        done: queue.Queue = queue.Queue()

        def probe(done=done) -> None:
            try:
                model(pd.Series(["ping"]))
                done.put("")
            except Exception as e:  # noqa: BLE001  the probe reports whatever a provider raises
                done.put(str(e) or type(e).__name__)

        threading.Thread(target=probe, daemon=True).start()  # a hung model must not hold the job
        try:
            why = done.get(timeout=timeout)
            if not why:
                return True, "works"
        except queue.Empty:
            why = f"no answer within {timeout:g} s"
        if attempt + 1 < retries:
            wait(backoff(attempt))
    return False, why


def backoff(attempt: int) -> int:
    return 2**attempt


def _rule_chat(_: str) -> Chat:
    """Answers with the first line of the prompt's last paragraph: deterministic and offline."""
    return lambda prompts: prompts.fillna("").str.split("\n\n").str[-1].str.split("\n").str[0]


def _hash_embedder(dim: str):
    import hashlib
    import re

    n = int(dim) if dim.isdigit() else 64

    def one(text: str):
        v = np.zeros(n)
        for t in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()):
            if t:
                v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % n] += 1
        return (v / np.linalg.norm(v)).tolist() if v.any() else None

    return lambda texts: texts.map(one)


register_chat("rule", _rule_chat, lambda: {"offline"})
register_embedder("hash", _hash_embedder)
