"""All registered queries."""

from __future__ import annotations

from probita.plans.catalog import QUERIES, SQL, Query
from probita.plans import (  # noqa: F401  (importing registers)
    audit_queries,
    graph_queries,
    ingest_queries,
    match_queries,
    risk_queries,
    text_queries,
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
