"""Runs every layer on an ordinary star schema (regions, nations, orders, documents ...)."""

from estatescope.star import (  # noqa: F401
    function_queries, operator_queries, plan_queries, source_queries,
)
from estatescope.star.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
