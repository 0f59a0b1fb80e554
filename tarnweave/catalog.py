"""All queries of the library proper, with their SQL."""

from __future__ import annotations

from .plans import catalog_graph, catalog_reports, catalog_rules, catalog_scalars, catalog_stream, catalog_taint, catalog_text, catalog_trace  # noqa: F401
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
