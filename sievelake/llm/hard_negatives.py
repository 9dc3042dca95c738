"""Hard negatives by exact integer inner products.

Anchors and candidates are dealt to tiles. A task multiplies one tile after the other by
Strassen's recursion on 64-bit integers; odd sides are padded with zeros. Additions and leaf
products are exact, and sums that leave 64 bits on the way come back, as all is modulo 2**64.

The first round multiplies rows of one label and keeps each anchor's best as its positives; the
second multiplies anchors with all rows and keeps the best of each positive's window. Every tile
hands on one short heap per anchor (and window), and heaps merge by rank before and after they are
dealt by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import cut

#: Rows on a side of a tile at most, and at least unless there are fewer; a side at which recursion ends.
TILE, LEAST, LEAF = 8192, 512, 32
#: Scores fit 64 bits if the squared length of both vectors is below this.
LONGEST = 2.0 ** 61
NONE = np.iinfo(np.int64).min


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """`a @ b` of 64-bit integers, modulo 2**64, with seven products of half size for eight."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        if m and n and k and float(np.abs(a).max()) * float(np.abs(b).max()) * k < 2.0 ** 52:
            return np.rint(a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)  # exact: all sums are whole and below 2**53
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = len(a) // 2, len(b) // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k best columns of every row, one place at a time, as (rows, columns); NONE is no score.
    Of equal scores the first column wins. `scores` is used up."""
    every = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        there = scores[every, at] != NONE
        if not there.any():
            return
        yield every[there], at[there]
        scores[every, at] = NONE


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, short ones padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = \
        column.flatten().to_numpy(zero_copy_only=False)
    return out


CELL = ["part", "i", "j"]
TILED = "anchor long, goal long, score long, id long, row long"


def _tiles(places: int):
    """Rows of tiles, sorted by tile, anchors first and candidates by id, as heaps.

    Without windows an anchor's heap holds candidates of its label, with windows each has one of
    other labels.
    """

    def heaps(cell: pa.Table) -> pa.RecordBatch | None:
        is_anchor = cell["anchor"].to_numpy(zero_copy_only=False).astype(bool)
        a, c = cell.filter(pa.array(is_anchor)), cell.filter(pa.array(~is_anchor))
        if not len(a) or not len(c):
            return None
        vectors = [t["vector"].combine_chunks() for t in (a, c)]
        width = max(1, *(int(v.value_lengths().to_numpy(zero_copy_only=False).max()) for v in vectors))
        (rows, labels), (other, labels_c) = [(t["row"].to_numpy(), t["label"].to_numpy()) for t in (a, c)]
        scores = product(_matrix(vectors[0], width), np.ascontiguousarray(_matrix(vectors[1], width).T))
        out = []
        if a["goals"].null_count:
            wrong = (labels[:, None] != labels_c[None, :]) | (rows[:, None] == other[None, :])
            masked = np.where(wrong, NONE, scores)
            out += [(r, at, np.zeros(len(r), np.int64)) for r, at in best(masked, places)]
        else:
            goals = a["goals"].to_pylist()
            for w in range(max(map(len, goals))):
                has = np.array([len(g) > w for g in goals])
                goal = np.array([g[w] if len(g) > w else 0 for g in goals], np.int64)
                low = np.array([_window(g)[0] for g in goal.tolist()], np.int64)
                high = np.array([_window(g)[1] for g in goal.tolist()], np.int64)
                right = (scores >= low[:, None]) & (scores <= high[:, None]) & has[:, None] & (labels[:, None] != labels_c[None, :])
                some = right.any(axis=1).nonzero()[0]
                if len(some):
                    masked = np.where(right[some], scores[some], NONE)
                    out += [(some[r], at, goal[some[r]]) for r, at in best(masked, places)]
        if not out:
            return None
        r, at, goal = (np.concatenate(x) for x in zip(*out))
        ids = c["id"].combine_chunks().take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(rows[r]), pa.array(goal), pa.array(scores[r, at]), ids, pa.array(other[at])],
                                          ["anchor", "goal", "score", "id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.array([batch.column(i).to_numpy() for i in range(3)])
            starts = [0, *(np.any(keys[:, 1:] != keys[:, :-1], axis=0).nonzero()[0] + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if end == start:
                    continue
                cell = tuple(keys[:, start])
                if cell != now and held:
                    found, held = heaps(pa.Table.from_batches(held)), []
                    if found:
                        yield found
                now = cell
                held.append(batch.slice(start, end - start))
        if held and (found := heaps(pa.Table.from_batches(held))):
            yield found

    return run


def _window(score: int, low: int = 50, high: int = 95) -> tuple[int, int]:
    """The least and the largest score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _tiled(anchors: DataFrame, rows: DataFrame, part: Column, i: int, j: int, places: int) -> DataFrame:
    """The heaps of all tiles: anchors in i blocks, rows in j blocks, `part` what both must share."""
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    one = anchors.select(part.alias("part"), block(i).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(j - 1))).alias("j"),
                         F.lit(True).alias("anchor"), "id", "row", "label", "vector", "goals")
    other = rows.select(part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(i - 1))).alias("i"), block(j).alias("j"),
                        F.lit(False).alias("anchor"), "id", "row", "label", "vector", F.lit(None).cast("array<long>").alias("goals"))
    dealt = one.unionByName(other).repartition(*CELL).sortWithinPartitions(*CELL, F.desc("anchor"), F.col("id").asc_nulls_last(), "row")
    return dealt.mapInArrow(_tiles(places), TILED)


def _first(heaps: DataFrame, places: int) -> DataFrame:
    """The merged heaps with `rank` from 1; partial heaps are cut before they are dealt."""
    order = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, scale: int = 256, tile: int = TILE, least: int = LEAST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` are (id, vector, label); `anchors` is a condition on their columns. A component x counts
    as floor(scale * x); scores are inner products, ties go to the smaller id, a missing id last. An
    anchor's positives are its best other rows of its label; for each, the best rows of other labels
    whose score is 50 to 95 % of the positive's are returned. Rows without a label or vector, or with
    a component that is null or not finite, take no part, nor do those so long (2 ** 30.5 after
    scaling) that scores may not fit 64 bits. Of vectors of different length the shorter is filled
    with zeros. A repeated row is another row; an empty table gives no rows.
    """
    spark = rows.sparkSession
    scaled = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(F.lit(float(scale)) * x.cast("double")) + 1) * (F.abs(F.lit(float(scale)) * x.cast("double")) + 1))
    all_ = cut(rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(sound).where(length < LONGEST).select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), scaled.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")))
    n, m = all_.agg(F.count("*"), F.count_if("anchor")).first()
    # Tiles of the largest size, or smaller ones as long as there are not four for each partition.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    i = max(1, -(-m // tile))
    j = max(1, -(-n // tile), min(parts // i, -(-n // least)))
    no_goals = all_.where("anchor").withColumn("goals", F.lit(None).cast("array<long>"))
    best_ = cut(_first(_tiled(no_goals, all_, F.col("label"), i, j, positives), positives).select(
        "anchor", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"), F.col("row").alias("positive_row")))
    goals = best_.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("goals"))
    aimed = all_.where("anchor").join(goals, "row")
    found = _first(_tiled(aimed, all_, F.lit(0).cast("long"), i, j, negatives), negatives)
    named = all_.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return best_.join(
        found.select("anchor", F.col("goal").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
        ["anchor", "positive_score"],
    ).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
