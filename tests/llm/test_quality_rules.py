"""Quality rules against counts made word by word."""

import re

import pytest

from sievelake.llm.quality_rules import Rule, judged, measured

TEXTS = [None, "", " \n\t ", "one", "a b c a b c a b c", "same line\nsame line\n\nother\nsame line", "x " * 400,
         "the cat sat on the mat " * 20, "#*$%&|<> é€😀 z\x0bq\x1cr", "word" * 5000, "a b c d a b c e\na b c d a b c e", " the  of "]


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_measures_match_a_count_word_by_word(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, _words string")
    rows = measured(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert tuple(r["quality"])[:5] == expected(TEXTS[r["doc_id"]]), r["doc_id"]
        assert r["_words"] == "extra"


def test_verdicts(spark):
    docs = spark.createDataFrame([(0, None), (1, "x " * 60), (2, " ".join(f"the w{i} of" for i in range(40))),
                                  (3, " ".join(f"w{i} x%%%" for i in range(40)))], "doc_id long, text string")
    got = {r["doc_id"]: r["quality"] for r in judged(docs).collect()}
    assert [got[i]["base_failed"] for i in range(4)] == [True, True, False, False]
    assert [got[i]["kept"] for i in range(4)] == [False, False, True, False]
    assert "symbols" in got[3]["reasons"] and got[2]["reasons"] == []


def test_empty_table_and_own_rules(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, quality int")
    assert judged(docs).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = judged(one, base=(), rules=(Rule("few", "n_words", low=3),)).first()["quality"]
    assert not row["kept"] and not row["base_failed"] and row["reasons"] == ["few"]


@pytest.mark.parametrize("text", ["a b c " * 30000])
def test_very_long_text(spark, text):
    row = measured(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["quality"]
    assert row["n_repeat_words"] == row["n_words"] == 90000
