"""The registered queries: each operator applied to the tables, and the same in SQL."""

from __future__ import annotations

from . import assembly, cleaning, guides, matching, quality, state, structure  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
