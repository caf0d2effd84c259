"""Queries over the test tables, by area; see registry."""

from __future__ import annotations

from loomspark.plans import control_queries, dataset_queries, diagnostic_queries, ensemble_queries, event_queries, feature_queries, memory_queries, panel_queries, ranking_queries, selection_queries, validation_queries  # noqa: F401  they register
from loomspark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
