"""How a module collects its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Reads tables by name: t.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def registry():
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle:
                sql[name] = oracle
            return f

        return add

    return queries, sql, query
