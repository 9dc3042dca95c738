"""Language identification: held-out accuracy on the given documents, and its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_scores(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit("kept"))
    learn = docs.where(~language.held_out())
    model = language.fitted(learn, rows=400)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 %%% \n"), (-4, "the " * 30000), (None, "the house of the king")], "doc_id long, text string")
    rows = language.predicted(docs.where(language.held_out()).unionByName(odd, allowMissingColumns=True), model).collect()
    known = [r for r in rows if r["lang"] is not None]
    assert len(known) > 100 and sum(r["language"]["lang"] == r["lang"] for r in known) >= 0.97 * len(known)
    assert all(0 <= r["language"]["score"] <= 1 for r in rows)
    got = {r["doc_id"]: tuple(r["language"]) for r in rows}
    assert got[-1] == got[-2] == got[-3] == ("und", 0.0) and got[-4][0] in model.labels and got[None][0] in model.labels
    assert rows[0]["score"] == "kept"
    # Calibrated: the mean score is about the accuracy.
    assert abs(np.mean([r["language"]["score"] for r in known]) - 0.99) < 0.06
    assert (model.weights == 0).mean() > 0.3  # sparse


def test_repeated_rows_one_label_and_none(spark):
    rows = spark.createDataFrame([(1, "guten tag", "de")] * 50 + [(2, "guten abend", "de"), (3, None, "fr"), (4, "hello", None)], "doc_id long, text string, lang string")
    model = language.fitted(rows)
    assert model.labels == ["de"]
    assert {tuple(r["language"]) for r in language.predicted(rows, model).where("text IS NOT NULL").collect()} == {("de", 1.0)}
    assert language.fitted(rows.limit(0)) is None
    nothing = language.predicted(rows, None).collect()
    assert len(nothing) == 53 and {tuple(r["language"]) for r in nothing} == {("und", 0.0)}


def test_grams_are_counted_over_the_whole_text():
    assert len(language.grams("abc")) == 3 + 4 + 3  # with the spaces around the word
    assert language.grams("A--b").tolist() == language.grams("a b").tolist()
    assert len(language.grams("")) == len(language.grams("12 3")) == 0
    long = language.grams("ab " * 5000 + "xyz")
    assert len(long) == 10003 + 15004 + 15003


@pytest.mark.parametrize("scale", [0.2, 5.0])
def test_temperature_undoes_a_scale(scale):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=language.softmax(x)) for x in logits])
    assert language.temperature(logits * scale, labels) == pytest.approx(scale, rel=0.15)
