"""Registered queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The input tables by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``plan(tables)`` under a name with its SQL counterpart."""
    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return plan
    return register
