"""Named queries over the driver tables, and the same questions in DuckDB SQL."""

from __future__ import annotations

from . import cases, events, evidence, facts, literals, messages, rules, stored, texts, vectors  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
