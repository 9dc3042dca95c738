"""Hard negatives against plain loops over Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import hard_negatives


def expected(rows, positives=5, negatives=3):
    use = []
    for at, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        use.append((at, i, [math.floor(256 * x) for x in vector], label))
    out = []
    for at, i, a, label in use:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v)), j is None, j or 0, k, other) for k, j, v, other in use if k != at))
        for p in [s for s in scored if s[4] == label][:positives]:
            fit = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(i, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1) for r in rows], "id long, vector array<double>, label int, score int").repartition(4)
    out = hard_negatives.mined(table, F.col("id") % 50 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def made(seed, n, dim=7):
    rng = random.Random(seed)
    label = lambda: rng.choice([0, 0, 0, 1, 2, 3])
    return [(i, [rng.randint(-2, 5) / rng.choice([2, 3]) for _ in range(dim)], label()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"tile": 32, "least": 8}])
def test_same_rows_as_loops(spark, options):
    rows = made(1, 400)
    got = found(spark, rows, **options)
    assert got == expected(rows) and len(got) > 50


def test_odd_rows(spark):
    rows = made(2, 160) + [(None, [1.0] * 7, 0), (None, [1.0] * 7, 1), (50, [1.0] * 7, 0), (50, [1.0] * 7, 0), (200, None, 1), (250, [1.0], 1),
                           (300, [], 0), (350, [0.0] * 7, 2), (400, [float("nan")] * 7, 0), (450, [float("inf")] * 7, 0), (500, [None] * 7, 0),
                           (550, [1.0] * 7, None), (600, [-3.0] * 7, 9), (650, [1e18] * 7, 0), (700, [1e300] * 7, 0), (151, [1.5] * 9, 0), (152, [1.5] * 9, 0)]
    usable = [r for r in rows if not (r[1] and isinstance(r[1][0], float) and 1e17 < r[1][0] < math.inf)]
    assert found(spark, rows, tile=64, least=16) == expected(usable)
    assert found(spark, []) == [] and found(spark, [(0, [1.0], 1)]) == []


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (33, 64, 65), (70, 7, 90), (129, 130, 67)])
def test_product(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    for size in (300, 2 ** 27):
        a, b = rng.integers(-size, size, (m, k)), rng.integers(-size, size, (k, n))
        for leaf in (1, 4, 32):
            assert (hard_negatives.product(a, b, leaf) == a @ b).all()


def test_window_is_exact():
    for p in [0, 1, 2, 19, 20, 21, 99, 100, 101, 2 ** 61 + 1]:
        low, high = hard_negatives._window(p)
        for s in {low - 1, low, high, high + 1}:
            assert (low <= s <= high) == (50 * p <= 100 * s <= 95 * p)
