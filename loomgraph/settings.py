"""Settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from .functions.constants import MAX_CONTEXT_NODES

SEMANTIC = ("auto", "embeddings", "llm", "off")


@dataclass(frozen=True)
class Settings:
    """``semantic``: how questions that no name and no word matches are met: by vectors where there are any, then by a model's
    choice of names (auto), by vectors alone (embeddings), by that choice alone (llm), or not at all (off). ``max_nodes``:
    matches of a question. ``retries``: how often a model's call is tried again before its error counts."""

    semantic: str = "auto"
    max_nodes: int = MAX_CONTEXT_NODES
    retries: int = 3

    @classmethod
    def read(cls, environment=None) -> Settings:
        """From LOOMGRAPH_SEMANTIC, LOOMGRAPH_MAX_NODES and LOOMGRAPH_RETRIES; what isn't set keeps its default."""
        own = os.environ if environment is None else environment
        found = {}
        for name, default in cls().__dict__.items():
            if (value := own.get(f"LOOMGRAPH_{name.upper()}")) is not None:
                value = value.strip().strip("\"'")
                found[name] = int(value) if isinstance(default, int) else value.lower() if name == "semantic" else value
        if found.get("semantic", "auto") not in SEMANTIC:
            raise ValueError(f"LOOMGRAPH_SEMANTIC is one of {', '.join(SEMANTIC)}")
        return cls(**found)
