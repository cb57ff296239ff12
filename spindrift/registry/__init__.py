"""Registered queries and their SQL twins."""

from __future__ import annotations

from .base import ORACLES, QUERIES


def load_all() -> tuple[dict, dict]:
    """Import every query module and return (queries, oracle SQL)."""
    from . import (  # noqa: F401
        bandit_queries,
        catalog_queries,
        cleaning_queries,
        experiment_queries,
        feature_queries,
        monitoring_queries,
        recommend_queries,
        search_queries,
        source_queries,
        stream_queries,
    )

    return QUERIES, ORACLES
