"""Settings: typed, read once, missing required ones fail at once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache


class MissingSettings(ValueError):
    """Names every required setting that is absent."""


@dataclass(frozen=True)
class Settings:
    warehouse: str
    extractor: str = "rules"
    embedder: str = "hashing"
    embedding_dim: int = 256
    similarity_threshold: float = 0.87
    route_confidence: float = 0.6
    chunk_tokens: int = 800
    chunk_overlap: int = 100

    def table(self, name: str) -> str:
        """Where a table of the warehouse lies."""
        return f"{self.warehouse.rstrip('/')}/{name}"

    @classmethod
    def load(cls, values: Mapping[str, str], prefix: str = "SPARKWRIGHT_") -> "Settings":
        """From a mapping such as the environment; values become the fields' types."""
        found = {}
        for name, kind in cls.__annotations__.items():
            raw = values.get(prefix + name.upper())
            if raw not in (None, ""):
                found[name] = {"int": int, "float": float}.get(kind, str)(raw)
        if missing := [prefix + n.upper() for n in ("warehouse",) if n not in found]:
            raise MissingSettings("settings are missing: " + ", ".join(missing))
        return cls(**found)


@lru_cache(maxsize=1)
def settings() -> Settings:
    """Those of the environment, read once."""
    return Settings.load(os.environ)
