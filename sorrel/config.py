"""Settings from the environment: where the document table and the index are, and whether model slots are on."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    documents: str = "warehouse/documents"
    index: str = "warehouse/index"
    failures: str = "warehouse/failures"
    model_expansion: bool = False
    reranker: str = ""
    embedding: str = ""


def load_config(environment: Mapping[str, str] | None = None) -> Config:
    """SORREL_DOCUMENTS, SORREL_INDEX, SORREL_FAILURES, SORREL_MODEL_EXPANSION (true or false), SORREL_RERANKER (a scorer of
    pairs, as module:function) and SORREL_EMBEDDING (the folder of a learned embedding), else the defaults."""
    env = os.environ if environment is None else environment
    plain = Config()
    return Config(
        env.get("SORREL_DOCUMENTS", plain.documents), env.get("SORREL_INDEX", plain.index), env.get("SORREL_FAILURES", plain.failures), env.get("SORREL_MODEL_EXPANSION", "false").lower() == "true",
        env.get("SORREL_RERANKER", plain.reranker), env.get("SORREL_EMBEDDING", plain.embedding),
    )


def named(path: str) -> Callable | None:
    """The function that module:function names, imported once in each process; None for an empty name."""
    if not path:
        return None
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)
