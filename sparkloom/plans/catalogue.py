"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from . import answer_queries, search_queries, table_queries, text_queries  # noqa: F401
from .base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
