"""Collects the registered queries of all areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from .bridge import duckdb_with, spark_table

Query = Callable[[SparkSession, str], DataFrame]


class Area:
    """Queries of one area, registered by decorator with their SQL text."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, *tables: str, sql: str | None = None, steps: dict[str, str] | None = None):
        def register(build):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                prepare(spark)
                return build(*[spark_table(spark, sf_dir, t) for t in tables])

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = duckdb_with(sql, steps)
            return build

        return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import apply_plans, collection_plans, device_plans, function_plans, lifecycle_plans, metrics_plans, read_plans, search_plans, views

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (views, function_plans, read_plans, search_plans, apply_plans, device_plans, lifecycle_plans, collection_plans, metrics_plans):
        queries |= module.AREA.queries
        sql |= module.AREA.sql
    return queries, sql
