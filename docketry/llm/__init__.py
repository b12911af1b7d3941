"""Operators for preparing training data: deduplication, filtering, scoring, packing.

Nothing else in the library imports this package.
"""

from __future__ import annotations


def queries() -> dict:
    """The registered queries of this package."""
    from docketry.llm import registry

    return registry.queries()


def oracle_sql() -> dict:
    """DuckDB SQL for those queries that SQL can express."""
    from docketry.llm import registry

    return registry.oracle_sql()
