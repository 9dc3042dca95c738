"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a target number of tokens. Slot i of the mix has the golden-ratio point
frac(i * phi), which is mapped through the sources' cumulative weights to a source; the slot's
rank among the slots of its source names the source's block. The source's documents, shuffled
anew for every epoch, form one stream of tokens that is cut into blocks of equal size, and the
blocks are joined to their slots.

A source may hold most rows, and there may be very many sources: running sums go over ranges
of a total order, ranks over chunks of slots, and nothing is gathered by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import cut, fresh, running

GOLDEN = 0.6180339887498949
#: Slots are ranked in chunks of this many.
CHUNK = 1 << 16
#: Points and bounds of sources meet in buckets of about this many rows.
BUCKET = 50_000


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights=(3, 1, 2)) -> DataFrame:
    """`rank` (0-based, by code point, null last), `weight` and `target` for (source, source_size).

    Sources share `share` times all tokens by weight, the weights repeating in order of rank. A
    target stops at `cap` times its source's size; the excess is reshared by weight until no
    target is above. A source without tokens has the target 0.
    """
    rows = running(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], {}, "rank").drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(rows.withColumn("weight", weight))
    most, own = F.col("source_size") * F.lit(float(cap)), F.col("weight")
    all_tokens, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level, total = 0.0, share * (all_tokens or 0)
    if all_tokens:
        # A source once capped stays capped, as the level only rises; each round is one aggregate.
        after = total / all_weights
        while after > level:
            level = after
            full = most <= own * F.lit(level)
            capped, free = rows.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(own))).first()
            after = (total - capped) / free if free else level
    return rows.withColumn("target", F.least(most, own * F.lit(level)))


def _slots(sources: DataFrame, n: int, n_sources: int) -> DataFrame:
    """(slot, rank, block): `n` slots; the k-th slot of a source names its block k.

    `sources` has (rank, blocks, first): the blocks a source needs and those of the sources
    before it. A source that the points give more slots than it needs loses the last ones; one
    that they give fewer has its remaining blocks appended after the schedule.
    """
    spark = sources.sparkSession
    # frac(i * phi) without losing digits for large i: the halves of i are multiplied apart.
    high, low = F.floor(F.col("slot") / (1 << 20)), F.col("slot") % (1 << 20)
    step = GOLDEN * (1 << 20) % 1.0
    point = high * F.lit(step) + low * F.lit(GOLDEN)
    points = spark.range(n).select((F.col("id") + 1).alias("slot")).withColumn("at", (point - F.floor(point)) * n)
    buckets = 1 + (n + n_sources) // BUCKET
    wide = n / buckets
    bucket = lambda c: F.least(F.floor(c / F.lit(wide)), F.lit(buckets - 1)).cast("long")
    bounds = (
        sources.where("blocks > 0").select("rank", F.col("first").cast("double").alias("a"), (F.col("first") + F.col("blocks")).alias("b"))
        .select("rank", "a", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("b") - 0.5))).alias("bucket"))
        .select("bucket", F.greatest("a", F.col("bucket") * F.lit(wide)).alias("at"), F.lit(0).alias("kind"), "rank", F.lit(None).cast("long").alias("slot"))
    )
    asked = points.select(bucket(F.col("at")).alias("bucket"), "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("rank"), "slot")
    along = Window.partitionBy("bucket").orderBy("at", "kind", "rank").rowsBetween(Window.unboundedPreceding, 0)
    mapped = (
        bounds.unionByName(asked).withColumn("rank", F.last("rank", ignorenulls=True).over(along))
        .where("kind = 1").select("slot", "rank", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    mapped = cut(mapped)
    counts = mapped.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    inside = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot"))
    ranked = mapped.join(counts.drop("n"), ["rank", "chunk"]).select("slot", "rank", (F.col("before") + inside - 1).alias("block"))
    scheduled = ranked.join(sources.select("rank", "blocks"), "rank").where("block < blocks").drop("blocks")
    given = counts.groupBy("rank").agg(F.sum("n").alias("given"))
    late = (
        sources.join(given, "rank", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks")
        .select("rank", "blocks", F.explode(F.sequence("given", F.col("blocks") - 1)).alias("block"))
        .withColumn("place", F.col("block") / F.col("blocks"))
    )
    late = running(late, ["place", "rank"], {}, "order").select((F.col("order") + n + 1).alias("slot"), "rank", "block")
    return scheduled.unionByName(late)


def mixed(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", share: float = 1.5,
          cap: float = 2.0, weights=(3, 1, 2), block: int = 4096, seed: int = 0, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of `docs`, which need (key, source, size); returns three tables.

    Rows: (row, key, source, size, source_size, target), one for each row of `docs`.
    Plan: (slot, row, epoch, start, length), the tokens `[start, start + length)` of a row that a
    slot takes, every slot at most `block` tokens; ordered by (slot, epoch, place) it is the mix.
    Sources: (source, source_size, rank, weight, target).

    A source's tokens taken are its target rounded to a whole number; epochs beyond the first
    repeat its documents in another order. A null or negative size counts as 0; such rows,
    and all rows of an empty table, are listed but never taken. A null source is a source.
    Rows are ordered by a seeded hash of the key, so reruns agree whatever the partitions. `row`
    names a column of unique numbers to know rows by; without it they are numbered here.
    """
    rows = docs.select(*([F.col(row).alias("row")] if row else []), F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
                       F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    rows = cut(rows if row else rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = targets(sizes, share, cap, weights)
    aims = aims.withColumn("take", F.round("target").cast("long"))
    aims = aims.withColumn("blocks", F.ceil(F.col("take") / block)).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.ceil(F.col("take") / F.col("source_size"))).otherwise(0))
    aims = cut(running(aims, ["rank"], {"first": F.col("blocks"), "opened": F.col("epochs") * F.col("source_size")}))
    n, n_sources = aims.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    slots = _slots(aims.select("rank", "blocks", "first"), n, n_sources)
    known = rows.join(aims, rows["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    listed = known.select("row", "key", "source", "size", "source_size", "target")
    # One stream over all sources and epochs; a source's own stream starts at `opened`.
    laid = known.where("size > 0 and epochs > 0").select(
        "rank", "row", "key", "size", "take", "opened", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    laid = laid.withColumn("shuffled", F.xxhash64(F.lit(seed), "epoch", "key"))
    laid = running(laid, ["rank", "epoch", "shuffled", "key", "size", "row"], {"at": F.col("size")})
    laid = laid.withColumn("at", F.col("at") - F.col("opened")).withColumn(
        "until", F.least(F.col("at") + F.col("size"), F.col("take"))).where("until > at")
    cuts = laid.select("rank", "row", "epoch", "at", "until",
                       F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("until") - 1) / block))).alias("block"))
    begin, end = F.greatest("at", F.col("block") * block), F.least("until", (F.col("block") + 1) * block)
    plan = cuts.withColumn("start", begin - F.col("at")).withColumn("length", end - begin).withColumn("place", begin).join(
        slots, ["rank", "block"]).select("slot", "row", "epoch", "place", "start", "length")
    return listed, plan, aims.select("source", "source_size", "rank", "weight", "target")


def taken(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """(key, source, size, source_size, target, taken): tokens that the mix takes of every row."""
    listed, plan, _ = mixed(docs, size, source, key, **options)
    sums = plan.groupBy("row").agg(F.sum("length").alias("taken"))
    return listed.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).drop("row")


def repeated(docs: DataFrame, size: str, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """`docs` as the mix has them, in whole documents: a row comes once for every epoch that
    takes at least half of its tokens. Rows without tokens are in no slot and go."""
    row = fresh("row", docs)
    own = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    listed, plan, _ = mixed(own, size, source, key, row=row, **options)
    epoch = fresh("epoch", docs)
    times = plan.groupBy("row", "epoch").agg(F.sum("length").alias("n")).join(listed.select("row", "size"), "row").where(
        "2 * n >= size").select(F.col("row").alias(row), F.col("epoch").alias(epoch))
    return own.join(times, row).drop(row, epoch)
