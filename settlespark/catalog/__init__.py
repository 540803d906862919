"""Named queries over the driver tables, grouped by subject."""

from __future__ import annotations

from importlib import import_module

from settlespark.catalog.registry import ORACLES, QUERIES, Query

MODULES = (
    "feature_queries", "settle_queries", "table_queries", "review_queries", "model_queries",
)


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    for module in MODULES:
        import_module(f"settlespark.catalog.{module}")
    return QUERIES, ORACLES
