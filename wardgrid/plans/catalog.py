"""All registered queries and their checking SQL, collected from the query modules."""

from __future__ import annotations

from wardgrid.plans import (
    evaluation_queries, profile_queries, roundtrip_queries, scoring_queries, source_queries, stream_queries,
    timeline_queries,
)

MODULES = [timeline_queries, profile_queries, scoring_queries, source_queries, evaluation_queries,
           stream_queries, roundtrip_queries]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def reports() -> dict:
    """Queries whose results SQL cannot foresee; tests check them."""
    return dict(evaluation_queries.REPORTS)


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
