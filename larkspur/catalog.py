"""Every registered query with the SQL it equals."""

from __future__ import annotations

from larkspur.plans import chunking, codes, files, scalars, search, storage  # noqa: F401  they register their queries
from larkspur.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
