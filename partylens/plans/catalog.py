"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from partylens.plans import analytics_queries, artifact_queries, policy_queries, process_queries, scan_queries, screening_queries, stream_queries, validator_queries  # noqa: F401
from partylens.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
