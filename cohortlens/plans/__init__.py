"""Registered queries over the driver's tables."""

from importlib import import_module

QUERY_MODULES = [
    "vector_queries", "score_queries", "axis_queries", "cohort_queries", "engagement_queries", "comparison_queries", "review_queries",
    "source_queries", "pixel_queries",
]


def load():
    """(queries, oracle SQL) of every query module."""
    for name in QUERY_MODULES:
        import_module(f"{__name__}.{name}")
    registry = import_module(f"{__name__}.registry")
    return registry.QUERIES, registry.ORACLES
