"""Mixing against targets computed source by source."""

import random

from pyspark.sql import functions as F

from sievelake.llm.mixing import mixed, repeated, taken


def expected_targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if weight[s] * level > cap * sizes[s]]
        if not above:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= set(above)


def rows_of(seed, n=800):
    rng = random.Random(seed)
    names = ["big"] * 8 + [None, "a", "é", "Z", "tiny", ""]
    return [(i % (n - 20), rng.choice(names), rng.choice([0, 1, 5, 300, 4000, None])) for i in range(n)] + [(9999, "none", 0)]


def test_targets_and_words_taken(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, size long, row int").repartition(5)
    got = taken(docs, block=256).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want, sums = expected_targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
    assert all(abs(sums[s] - want[s]) <= 0.5 for s in want)
    again = taken(docs.repartition(3), block=256).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_gapless_and_spread(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", 100) for i in range(600)], "doc_id long, source string, size long")
    _, plan, sources = mixed(docs, block=50)
    rank = {r["rank"]: r["target"] for r in sources.collect()}
    blocks = plan.groupBy("slot").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).orderBy("slot").collect()
    assert all(r["n"] <= 50 for r in blocks) and sum(r["n"] for r in blocks) == round(sum(rank.values()))
    assert len({r["slot"] for r in blocks}) == len(blocks)


def test_whole_documents_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", 10, 5), (2, "a", 0, 5), (3, "b", 40, 5)], "doc_id long, source string, size long, epoch int")
    got = sorted(r["doc_id"] for r in repeated(docs, "size").collect())
    assert set(got) <= {1, 3} and repeated(docs, "size").columns == docs.columns
    assert taken(docs.limit(0)).collect() == [] and repeated(docs.limit(0), "size").collect() == []
    zero = taken(docs.where("doc_id = 2")).collect()
    assert [(r["target"], r["taken"]) for r in zero] == [(0.0, 0)]
