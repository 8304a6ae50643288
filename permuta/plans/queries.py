"""Queries over the given tables, one for each operator."""

from __future__ import annotations

from . import ranking_queries, study_queries  # noqa: F401
from .fixtures import QUERIES, SQL, Query

letter_language = ranking_queries.letter_language


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
