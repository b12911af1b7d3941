"""The queries of the engine proper, with the SQL they are held against."""

from __future__ import annotations

from docketry.plans import answers, cases, classification, composition, evaluation, loads, reports, retrieval, shapes, storage, streams, titles  # noqa: F401  they register their queries
from docketry.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    """Every registered query."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(ORACLES)
