"""The catalog of queries and their oracle SQL."""

from __future__ import annotations

from . import alignment, attached, features, geometry, relational, storage, tuners, vectors  # noqa: F401  (their queries register on import)
from .registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
