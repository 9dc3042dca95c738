"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Equal vectors are one node. Nodes are dealt by hash into shards of bounded size; each shard
builds a directed graph: greedy searches from the medoid propose neighbours of every node, and a
relaxed distance rule (a candidate goes if a kept neighbour is `alpha` times closer to it than
the node is) keeps edges that point different ways. The queries are sent to every shard and stream
past its graph, which stays in the task that built it; a beam search answers each, and the best of
all shards are ranked by their exact distances. Graphs use single precision, scores the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import cut

#: Nodes of a shard about, and queries searched together at most.
SHARD_ROWS, QUERY_ROWS = 4096, 1024
DEGREE, BEAM, ALPHA = 32, 64, 1.2


def _scaled(vectors: np.ndarray, size: float) -> np.ndarray:
    return np.clip(vectors / size, -1e15, 1e15).astype(np.float32)


def beam_search(vectors: np.ndarray, edges: np.ndarray, entry: int, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of many points at once: the `beam` nearest nodes found (-1: none), and their
    squared distances. Each step expands every point's nearest node not yet expanded."""
    n = len(points)
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    ids[:, 0] = entry
    gap = vectors[entry] - points
    far[:, 0] = np.einsum("ij,ij->i", gap, gap)
    done = ids < 0
    # Nodes met before, with one place more that stands for no node.
    met = np.zeros((n, len(vectors) + 1), bool)
    met[:, [entry, -1]] = True
    active = np.arange(n)
    while len(active):
        nearest = np.where(done[active], np.inf, far[active]).argmin(axis=1)
        going = ~done[active, nearest]
        active, nearest = active[going], nearest[going]
        done[active, nearest] = True
        near = edges[ids[active, nearest]]
        row, place = np.nonzero(~met[active[:, None], near])
        if not len(row):
            continue
        new = near[row, place]
        met[active[row], new] = True
        gap = vectors[new] - points[active[row]]
        # The new ones of each point move to the front of as many columns as the most of them need.
        begin = np.searchsorted(row, np.arange(len(active)))
        column = np.arange(len(row)) - begin[row]
        width = int(column.max()) + 1
        new_ids = np.full((len(active), width), -1, np.int64)
        new_far = np.full((len(active), width), np.inf, np.float32)
        new_ids[row, column] = new
        new_far[row, column] = np.einsum("ij,ij->i", gap, gap)
        all_ids = np.concatenate([ids[active], new_ids], axis=1)
        all_far = np.concatenate([far[active], new_far], axis=1)
        all_done = np.concatenate([done[active], new_ids < 0], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        rows = np.arange(len(active))[:, None]
        ids[active], far[active], done[active] = all_ids[rows, best], all_far[rows, best], all_done[rows, best]
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def pruned(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` candidates of each node (a row of them; -1: none): the nearest first, without
    those that a kept one stands before."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == nodes[:, None]] = -1
    near = vectors[candidates] - vectors[nodes][:, None, :]
    far = np.where(candidates < 0, np.inf, np.einsum("ijk,ijk->ij", near, near))
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    alive = candidates >= 0
    far = np.where(alive, far, 0)
    # apart[:, i, j]: whether candidate j stays when i is kept.
    apart = alpha * alpha * (far[:, :, None] + far[:, None, :] - 2 * (near @ near.transpose(0, 2, 1))) > far[:, None, :]
    kept = np.full((len(nodes), degree), -1, np.int64)
    count = np.zeros(len(nodes), np.int64)
    for k in range(candidates.shape[1]):
        rows = np.nonzero(alive[:, k] & (count < degree))[0]
        kept[rows, count[rows]] = candidates[rows, k]
        count[rows] += 1
        alive[rows] &= apart[rows, k]
    return kept


def built(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0,
          together: int = 256) -> tuple[np.ndarray, int]:
    """Edges (a row of neighbours per node; -1: none) and the entry node of a shard's graph.

    Edges back are added until a node has a quarter more than `degree`; then it is pruned again.
    """
    n = len(vectors)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree + degree // 4), -1, np.int64)
    if n == 1:
        return edges, entry
    order = np.random.default_rng(seed).permutation(n)

    # Batches double, so that each searches a graph that has the nodes before it.
    at, size = 0, 1
    while at < n:
        batch = order[at:at + size]
        found, _ = beam_search(vectors, edges, entry, vectors[batch], min(beam, max(2, 2 * at)))
        wanted = [found, edges[batch]]
        if len(batch) <= 64:  # the first ones see each other
            wanted.append(np.broadcast_to(batch, (len(batch), len(batch))))
        edges[batch] = -1
        edges[batch, :degree] = pruned(vectors, batch, np.concatenate(wanted, axis=1), degree, alpha)
        at, size = at + size, min(2 * size, together)
        source, place = np.nonzero(edges[batch] >= 0)
        target, source = edges[batch[source], place], batch[source]
        by = np.lexsort((source, target))
        target, source = target[by], source[by]
        others, begin, more = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(others), edges.shape[1] + int(more.max(initial=0))), -1, np.int64)
        back[:, :edges.shape[1]] = edges[others]
        group = np.repeat(np.arange(len(others)), more)
        known = (edges[target] == source[:, None]).any(axis=1)
        back[group, edges.shape[1] + np.arange(len(group)) - begin[group]] = np.where(known, -1, source)
        back = -np.sort(-back, axis=1)
        fits = (back >= 0).sum(axis=1) <= edges.shape[1]
        edges[others[fits]] = back[fits, :edges.shape[1]]
        # A node that very many chose has a wide row: nodes of like width are pruned together.
        full = np.nonzero(~fits)[0]
        full = full[np.argsort(more[full], kind="stable")]
        for part in np.array_split(full, -(-len(full) // 64)) if len(full) else []:
            width = int((back[part] >= 0).sum(axis=1).max())
            edges[others[part]] = -1
            edges[others[part], :degree] = pruned(vectors, others[part], back[part, :width], degree, alpha)
    return edges, entry


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector): rows with an id and a vector that is neither null, empty nor zero and has only
    finite components; equal rows once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value: equal vectors then have equal hashes.
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("vector")).where(
        F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()


def nearest(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 10,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, degree: int = DEGREE, beam: int = BEAM,
            alpha: float = ALPHA) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that `is_query` (a
    condition on the column `id`) names, by Euclidean distance, nearest first, ties to the
    smaller id; all other rows are candidates, and none is left out of the index.

    Rows without an id or with a null, zero or non-finite vector take no part. Repeated rows count
    once; an id with several vectors is a query once for each and never its own neighbour.
    Vectors of another length are compared only among themselves. Equal vectors are one node:
    its k + 1 smallest ids are all that can be among k nearest, whatever the number of copies.
    """
    own = usable(rows, key, vector).withColumn("dim", F.size("vector")).withColumn("code", F.sha2(F.to_json("vector").cast("binary"), 256))
    own = cut(own)
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    members = cut(own.select("code", "id").withColumn("place", place).where(F.col("place") <= k + 1).drop("place"))
    first = members.groupBy("code").agg(F.min("id").alias("id"))
    nodes = cut(own.join(first, ["code", "id"]).select("code", "dim", "vector"))
    asked = own.where(is_query).select("id", "code", "dim", "vector")
    # One row per length of vector: no more than the longest vector has components.
    shards = F.broadcast(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards")))
    dealt = nodes.join(shards, "dim").select("dim", F.pmod(F.xxhash64("code"), F.col("shards")).alias("shard"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("id"), "code", "vector")
    sent = asked.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"),
                                            "id", "code", "vector")
    # Building is costly per row: a given number of partitions is not made smaller for few bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.unionByName(sent).repartition(max(parts, 2 * (nodes.count() // shard_rows + 1)), "dim", "shard").sortWithinPartitions(
        "dim", "shard", "asks", "code", "id")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, graph, taken = None, None, []
        for pdf in frames:
            for key, piece in pdf.groupby(["dim", "shard"], sort=False):
                if key != shard:
                    shard, graph, taken = key, None, []
                if not piece["asks"].iloc[0]:
                    taken.append(piece.loc[~piece["asks"], ["code", "vector"]])
                piece = piece[piece["asks"]]
                for at in range(0, len(piece), query_rows):
                    if graph is None:
                        nodes = pd.concat(taken)
                        exact, codes, taken = np.stack(nodes["vector"].to_numpy()), nodes["code"].to_numpy(), []
                        size = np.abs(exact).max()
                        vectors = _scaled(exact, size)
                        graph = built(vectors, degree, beam, alpha)
                    block = piece.iloc[at:at + query_rows]
                    points = np.stack(block["vector"].to_numpy())
                    found, far = beam_search(vectors, *graph, _scaled(points, size), beam)
                    # Ties stay, and so does what single precision may have put behind them.
                    q, c = np.nonzero((found >= 0) & (far <= far[:, min(k, beam - 1)][:, None] * np.float32(1.00001)))
                    hit = found[q, c]
                    yield pd.DataFrame({"query_id": block["id"].to_numpy("int64")[q], "query": block["code"].to_numpy()[q],
                                        "score": np.sqrt(((exact[hit] - points[q]) ** 2).sum(axis=1)), "code": codes[hit]})

    hits = met.mapInPandas(search, "query_id long, query string, score double, code string")
    best = Window.partitionBy("query_id", "query").orderBy("score")
    hits = hits.withColumn("place", F.rank().over(best)).where(F.col("place") <= k + 1).drop("place")
    pairs = hits.join(members, "code").where("id <> query_id")
    # An id with several vectors counts as a neighbour by its nearest one.
    pairs = pairs.groupBy("query_id", "query", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id", "query").orderBy("score", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
