"""The registered queries and, where one exists, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelake.session import SPREAD_TEXT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


TEXT_TABLES = {"documents", "conversations", "pages"}


class Tables:
    """The given tables, read on first use as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        rows = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        # A local session with one small file per table asks for its text to be spread; elsewhere
        # the splits of the files are the partitions.
        spread = self._spark.conf.get(SPREAD_TEXT, None)
        return rows.repartition(int(spread)) if spread and name in TEXT_TABLES else rows


def query(name: str, sql: str | None = None):
    """Register `build(tables) -> DataFrame` under a name."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return add
