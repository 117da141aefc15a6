"""Collects queries with their SQL counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Registers a function of Tables under its name."""

        def keep(make: Callable[[Tables], DataFrame]):
            key = name or make.__name__
            self.queries[key] = lambda spark, folder: make(Tables(spark, folder))
            if sql:
                self.oracles[key] = sql
            return make

        return keep
