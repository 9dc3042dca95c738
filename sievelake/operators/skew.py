"""Joins and scans that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 0.001
HOT_ROWS = 200_000
SPREAD = 64


def spread_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
                salt_by: str | None = None, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Join facts to a table with one row per key; hot keys are spread over many tasks.

    A key is hot when it holds both `hot_rows` rows and one thousandth of all rows, so
    there are fewer than a thousand hot keys whatever the data: that list, and nothing
    else, is broadcast. Facts of a hot key get one of `SPREAD` salts and its single
    dimension row is repeated once per salt. Rows with a NULL key match nothing and are
    salted too, so they do not pile up in one task. `sizes` has the keys with their number of
    rows in `_rows`, if the caller knows them.
    """
    salt_source = F.col(salt_by) if salt_by else F.monotonically_increasing_id()
    salt = F.pmod(F.xxhash64(salt_source), F.lit(SPREAD)).cast("int")
    sizes = facts.groupBy(*on).agg(F.count("*").alias("_rows")) if sizes is None else sizes
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("t"))
    hot = F.broadcast(
        sizes.where((F.col("_rows") >= hot_rows) & (F.col("_rows") > total.scalar() * F.lit(HOT_SHARE)))
        .select(*on, F.lit(True).alias("_hot"))
    )
    blank = F.lit(False)
    for key in on:
        blank = blank | F.col(key).isNull()
    salted = (
        facts.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot") | blank, salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    repeated = dim.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: Column, columns: list[str],
                  last: bool = False) -> DataFrame:
    """The first (or last) row per key, as a mergeable aggregate rather than a window."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(pick(row, order).alias("_row")).select(*keys, "_row.*")


def global_rank(df: DataFrame, order: str, bucket: Column) -> DataFrame:
    """0-based position of every row in the order of the unique column `order`, as `rank`.

    `bucket` must rise with `order` (a prefix of a hashed id, a number divided by a
    width). Rows are ranked inside their bucket; the bucket sizes give the offsets.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(order)
    return (
        rows.withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, "_bucket")
        .withColumn("rank", F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_place", "_offset")
    )


def record_breaking(df: DataFrame, group: str, order: str, value: str,
                    chunk: int = 100_000) -> DataFrame:
    """Adds `breaks`: the value is greater than every earlier value of its group.

    A group is scanned in chunks of at most `chunk` consecutive order numbers, each its
    own window partition; the maxima of the chunks before it are carried in.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    tops = rows.groupBy(group, "_chunk").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(group, "_chunk", F.max("_top").over(earlier).alias("_carried"))
    inside = (
        Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_seen", F.max(value).over(inside))
        .join(carried, [group, "_chunk"])
        .withColumn(
            "breaks",
            F.coalesce(F.col(value) > F.greatest("_seen", "_carried"), F.lit(True)),
        )
        .drop("_chunk", "_seen", "_carried")
    )
