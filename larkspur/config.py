"""Settings with their defaults and bounds."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

#: Bounds of numeric settings, ends included.
BOUNDS = {"top_k": (1, 1000), "max_tokens": (1, 100_000), "min_bytes": (0, 100_000), "overlap_characters": (0, 10_000), "token_budget": (1, 10_000_000), "cache_seconds": (0, 86_400), "cache_entries": (1, 1_000_000), "vector_index_from": (1, 10**9)}


@dataclass(frozen=True)
class Config:
    """What an engine is run with."""

    mode: str = "hybrid"
    top_k: int = 10
    max_tokens: int = 512
    min_bytes: int = 50
    overlap_characters: int = 0
    token_budget: int = 1500
    cache_seconds: float = 300.0
    cache_entries: int = 10_000
    #: vectors from which on searches use an index of them; fewer are scanned
    vector_index_from: int = 10_000

    def __post_init__(self):
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {getattr(self, name)}")
        if self.mode not in ("vector", "fts", "bm25", "hybrid"):
            raise ValueError(f"unknown mode {self.mode!r}")


def updated(config: Config, changes: Mapping[str, object]) -> Config:
    """A copy with some settings changed; unknown names are an error, and the result is checked as a whole."""
    known = {f.name for f in fields(Config)}
    if unknown := set(changes) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(config, **changes)


def positive_int(value: str | int | None, default: int) -> int:
    """A request's parameter as a positive number; the default where it is missing, no number, or not positive."""
    try:
        found = int(value)
    except (TypeError, ValueError):
        return default
    return found if found > 0 else default


class Watched:
    """Settings of a JSON file, read again when the file has changed. A file that is missing or wrong leaves the settings as they are."""

    def __init__(self, path: str, config: Config | None = None, changed: Callable[[Config], None] | None = None):
        self.path, self.config, self.changed, self.error, self._seen = path, config or Config(), changed, None, None
        self.reload()

    def reload(self) -> bool:
        """Whether the settings changed."""
        try:
            stat = os.stat(self.path)
            if (stat.st_mtime_ns, stat.st_size) == self._seen:
                return False
            self._seen = stat.st_mtime_ns, stat.st_size
            with open(self.path, encoding="utf-8") as file:
                new = updated(self.config, json.load(file))
        except (OSError, ValueError, TypeError) as error:
            self.error = error
            return False
        self.error = None
        if new == self.config:
            return False
        self.config = new
        if self.changed:
            self.changed(new)
        return True
