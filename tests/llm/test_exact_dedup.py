"""Exact duplicates against a dictionary of normalised texts."""

import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from sievelake.llm import exact_dedup
from sievelake.session import shared_folder


def expected(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for body, members in groups.items():
        best = min(members)
        for _, missing, doc, i in members:
            out.append((None if missing else doc, None if best[1] else best[2], len(members), i == best[3],
                        hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=6, **options):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, entry string, body int").repartition(parts)
    out = exact_dedup.deduplicated(docs, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", **options)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return [tuple(r) for r in out.collect()]


def odd_rows(seed=3, n=600):
    rng = random.Random(seed)
    words = ["a", "b c", "B", " ", " x", "long " * 900, "", " \t\n", "\x0b\x0c\r", None, "é", "é"]
    texts = [" ".join(w or "" for w in rng.choices(words, k=rng.randint(1, 3))) for _ in range(120)]
    rows = [(i, rng.choice(texts)) for i in range(n)]
    hot = [(n + i, "hot  text" if i % 3 else "hot text") for i in range(n // 2)]
    return rows + hot + [(None, "hot\ttext"), (None, None), (5, None), (5, None), (-1, " "), (7, "퟿🎈 end"), (8, "🎈end")]


@pytest.mark.parametrize("options", [{}, {"bits": 3}, {"capacity": 2000}, {"capacity": 300, "bits": 5, "window": 100}, {"capacity": 100, "window": 0}])
def test_same_groups_as_a_dictionary(spark, options):
    rows = odd_rows()
    got = found(spark, rows, **options)
    # Repeated rows are alike: which of them stays is open, that one does is not.
    assert sorted(got, key=repr) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_directory_doubles_for_full_buckets_only(spark):
    sizes = spark.createDataFrame([(k << 58, 1, 100) for k in range(8)] + [((k << 40), 1, 100) for k in range(1, 30)], "key long, entries long, bytes long")
    cells, base = exact_dedup.directory(sizes, 1000)
    rows = sorted(cells.collect(), key=lambda r: r["bucket"])
    assert sum(r["keys"] for r in rows) == 37 and all(r["bytes"] <= 1000 for r in rows)
    assert len({r["depth"] for r in rows}) > 1 and base == 2
    ends = [r["bucket"] + 2 ** (63 - r["depth"]) for r in rows]
    assert all(a <= b["bucket"] for a, b in zip(ends, rows[1:]))
    one = spark.createDataFrame([(5, 640, 64000)], "key long, entries long, bytes long")
    assert [r["pages"] for r in exact_dedup.directory(one, 1000)[0].collect()] == [40]


def test_a_hot_text_is_one_entry_per_task(spark):
    docs = spark.range(0, 20000, 1, 5).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    index = exact_dedup.Index(f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    exact_dedup.built(docs, index)
    rows = spark.read.parquet(index.rows)
    assert rows.count() == 20000 and rows.where("body = CAST('same' AS binary)").count() == 5
