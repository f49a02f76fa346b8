"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import operator_queries  # noqa: F401  (adds its queries)
from .queries import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
