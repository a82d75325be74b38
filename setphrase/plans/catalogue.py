"""The named queries of the library and their SQL counterparts."""

from __future__ import annotations

from setphrase.plans import context_queries, core_queries, variant_queries
from setphrase.plans.core_queries import flagship
from setphrase.plans.registry import QUERIES, SQL

__all__ = ["context_queries", "core_queries", "flagship", "oracle_sql", "queries", "variant_queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
