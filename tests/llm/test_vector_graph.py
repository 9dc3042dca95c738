"""Nearest neighbours against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm.vector_graph import nearest

SCHEMA = "vec_id long, embedding array<float>, code string"


def brute(vectors, query, k):
    far = sorted((float(np.sqrt(((vectors[i].astype(float) - vectors[query].astype(float)) ** 2).sum())), i)
                 for i in vectors if i != query and len(vectors[i]) == len(vectors[query]))
    return far[:k]


@pytest.mark.parametrize("copies", [0, 150])
def test_recall_and_exact_scores(spark, copies):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    vectors = {i: (centres[rng.integers(8)] + 0.6 * rng.normal(size=16)).astype(np.float32) for i in range(900)}
    for i in range(copies):  # one very common vector, also among the queries
        vectors[i * 5] = vectors[0]
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()]
    bad = [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [float("nan")] * 16, "x"), (1003, [float("inf")] + [1.0] * 15, "x"),
           (1004, [None] + [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (1005, [], "x"), rows[0], rows[1]]
    got = nearest(spark.createDataFrame(rows + bad, SCHEMA).repartition(5), F.col("id") % 20 == 0, shard_rows=200, query_rows=16, beam=40).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, answer in found.items():
        want = brute(vectors, q, 10)
        answer.sort()
        assert [a[0] for a in answer] == list(range(1, 11))
        assert [(s, i) for _, i, s in answer] == sorted((s, i) for _, i, s in answer)
        for _, i, score in answer:
            assert abs(score - np.sqrt(((vectors[i].astype(float) - vectors[q].astype(float)) ** 2).sum())) < 1e-9
        hits += len({i for _, i, _ in answer} & {i for _, i in want})
        if copies and q % 5 == 0 and q < 5 * copies:
            assert [i for _, i, _ in answer] == [i for _, i in want]
    assert hits >= 0.95 * 10 * len(found)


def test_few_rows_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [1.0], ""), (100, [3.0], ""), (3, [1.0, 0.0], "")]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 0.0), (0, 2, 1, pytest.approx(2 ** 0.5)), (100, 1, 2, 2.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, F.col("id") % 100 == 0).collect() == []
    assert nearest(spark.createDataFrame(rows[:1], SCHEMA), F.col("id") % 100 == 0).collect() == []


def test_doubles_are_kept(spark):
    big = 2 ** 60
    rows = [(big, [1.0, 2.0]), (big + 1, [1.0, 2.0 + 1e-12]), (big + 2, [1.0, 2.0 + 3e-12]), (3, [1e100, -1e100])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == big).orderBy("rank").collect()
    want = sorted((float(np.sqrt(((np.array(v) - [1.0, 2.0]) ** 2).sum())), i) for i, v in rows if i != big)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(big, n, i, s) for n, (s, i) in enumerate(want, 1)]


def test_a_graph_stays_in_its_task(spark):
    """Queries go to shards: no graph passes a shuffle after it is built."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), "") for i in range(300)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, shard_rows=50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "binary" not in plan and "edges" not in plan and got.count() == 300
