"""All registered queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans import archive_oracle, archive_queries, table_oracle, table_queries

_QUERIES = (archive_queries, table_queries)
_ORACLES = (archive_oracle, table_oracle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _QUERIES for name, run in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _ORACLES for name, sql in module.oracle_sql().items()}
