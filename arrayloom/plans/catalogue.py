"""All queries over the library's own operators."""

from __future__ import annotations

from arrayloom.plans import array_queries, frame_queries, random_queries, registry, stats_queries  # noqa: F401  they register their queries


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
