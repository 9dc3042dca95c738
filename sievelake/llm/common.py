"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.session import cut, shared_folder

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared storage, for output that is read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], number: str | None = None) -> DataFrame:
    """`rows` with exclusive running sums (`sums`: name to value) in the total order `order`,
    and with the 0-based position as column `number` if one is named.

    Rows are dealt by range, summed inside their range and shifted by the totals of the ranges
    before it: one row per range is all that meets in one place. The order should end in a
    unique column, else a large group of ties stays in one range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = fresh("part", rows)
    given = {name: fresh(f"v_{name}", rows) for name in sums} | ({number: fresh("one", rows)} if number else {})
    values = {given[k]: v for k, v in sums.items()} | ({given[number]: F.lit(1).cast("long")} if number else {})
    dealt = cut(rows.withColumns(values).repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*[F.sum(v).alias(v) for v in given.values()])
    offsets = totals.select(part, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_b") for v in given.values()])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), part)
    out = out.withColumns({k: F.col(f"{v}_b") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in given.items()})
    return out.drop(part, *given.values(), *[f"{v}_b" for v in given.values()])
