"""All named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetmill.plans import data_problems, response_queries, table_queries, text_queries

MODULES = (data_problems, text_queries, table_queries, response_queries)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return table_queries.reconcile(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.oracle_sql().items()}
