"""All queries of the library's own operators by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evolution_queries, field_queries, gap_queries, propagation_queries, record_queries, regression_queries, series_queries

_MODULES = (series_queries, propagation_queries, evolution_queries, record_queries, gap_queries, regression_queries, field_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
