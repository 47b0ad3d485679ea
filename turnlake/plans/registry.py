"""All registered queries of the reference's operators, with their SQL."""

from __future__ import annotations

from . import analytics, conversation, corpus, memory, people, streams  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
