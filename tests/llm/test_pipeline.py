"""The pipeline stage by stage, and the registered queries against their SQL."""

import numpy as np
import pytest

import corpus_pipeline
from sievelake.llm import QUERIES, SQL, quality_rules
from sievelake.llm.common import cut
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) == []


def test_every_query_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = cut(stage(spark, docs, FOLDER))
        assert docs.columns == COLUMNS and docs.schema == before.schema, name
        assert docs.join(before, COLUMNS, "left_anti").count() == 0
        if name == "quality rules":
            own = quality_rules.judged(before).where("quality.kept").select("doc_id")
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in own.collect())
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    last = corpus_pipeline.packed(spark, docs, FOLDER).toPandas()
    assert sorted(last[last["piece"] == 0]["doc_id"]) == ids
    assert last.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_on_odd_rows(spark):
    good = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (2, good.upper().lower(), "en", None, 9), (None, good + " end", None, "a", 1),
            (3, None, None, None, None), (4, "", "de", "", 0), (5, "%%% " * 100, "en", "a", 1), (6, "der die das und " * 3, "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "None"]
    spoken = corpus_pipeline.languages(spark, kept, "")
    assert spoken.count() == 4
    one = corpus_pipeline.near_duplicates(spark, spoken, "")
    assert [r["doc_id"] for r in one.collect()] == [1]
    assert {r["doc_id"] for r in corpus_pipeline.mixture(spark, one, "").collect()} == {1}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []


def test_run_gives_packed_rows(spark):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    got = got.sort_values(["sequence_id", "offset"])
    ends = (got["offset"] + got["length"]).to_numpy()
    same = got["sequence_id"].to_numpy()[1:] == got["sequence_id"].to_numpy()[:-1]
    assert np.array_equal(got["offset"].to_numpy()[1:], np.where(same, ends[:-1], 0))
