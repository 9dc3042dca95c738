"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the bigint edges (a, b): the smallest node it can reach.

    Large-star and small-star steps take turns until nothing changes, in a number of rounds that
    grows with the logarithm of the nodes. Each step is a minimum per node joined back to the
    edges; the neighbours of a node never meet in one row. Loops and repeated edges do no harm.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # Large star: the larger neighbours of every node are tied to its minimum.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are tied to their minimum.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        ties = large.join(low, "a")
        small = ties.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(
            low.select("a", F.col("low").alias("b"))).distinct()
        now = cut(small)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
