"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkweave.plans import event_queries, idea_queries, more_queries, problem_sql, problems, record_queries, store_queries, text_queries

_ALL = idea_queries.QUERIES | event_queries.QUERIES | text_queries.QUERIES | record_queries.QUERIES | store_queries.QUERIES | more_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {name: query for name, (query, _) in _ALL.items()} | problems.queries()


def oracle_sql() -> dict[str, str]:
    """By the query's name; a query that SQL can't express has none and is tested against brute force."""
    return {name: sql.strip() for name, (_, sql) in _ALL.items() if sql} | problem_sql.SQL
