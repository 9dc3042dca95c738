"""Keyword screening and paged or keyed text: nothing may be lost before the real pattern is tried."""

import random

import pytest
from pyspark.sql import functions as F

from sievelake.functions import screening
from sievelake.functions.text import hits
from sievelake.sources import readers


def generated(rng):
    atom = lambda: rng.choice(["ab", "c", "de", "a", "[ab|]", "[^c]", r"\\|", r"\\w", "(?:a|bc)", "(d)", "(a(b|c)|d)", r"\\Qx|y\\E", " "]) + rng.choice(["", "", "?", "*", "{1,2}", "+"])
    part = lambda: "".join(atom() for _ in range(rng.randint(1, 3)))
    return rng.choice(["", r"\\b"]).replace("\\\\", "\\") + "|".join(part().replace("\\\\", "\\") for _ in range(rng.choice([1, 1, 2, 3])))


def test_pretest_loses_no_hit(spark):
    rng = random.Random(6)
    patterns = sorted({r"\bab(c)|d(e)\b", "ab|c", "(ab)|c", "a[|]b", r"ab\|c", *(generated(rng) for _ in range(70))})
    texts = ["".join(rng.choice(["ab", "c", "de", " ", "a", "|", "x|y", "d"]) for _ in range(rng.randint(0, 7))) for _ in range(200)] + ["xx de yy"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    text = F.col("t")
    wrong = rows.select(*[F.count_if(hits(text, p) != screening.hits_lowered(text, p)).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
    assert [p for p, n in zip(patterns, wrong) if n] == []


def test_alternatives_are_tested_one_by_one(spark):
    """Each has its literal start, also where letters are the same but for their case; the pattern as a whole is not tried."""
    patterns = [r"\bsix\b", r"\bfat(?:ter)?\b|\bsix\b", r"\bidiot\b|six", r"(s)ix\1|fat", "fat|[ab]c"]
    rows = spark.createDataFrame([(t,) for t in ["fatter", "a six", "a \u017fix", "\u0131d\u0131ot", "fa six", "ac", "fats", ""]], "t string")
    text = F.col("t")
    for p in patterns:
        assert rows.where(hits(text, p) != screening.hits_lowered(text, p)).isEmpty(), p
    plan = rows.select(screening.hits_lowered(text, patterns[1]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(t" in plan and r"\b|\b" not in plan


def test_names_of_categories_are_free(spark):
    categories = [("a::b", [r"\bab(c)|d(e)\b"]), ("x\u0001y", ["zz", "yy"])]
    rows = spark.createDataFrame([("xx de yy", "")], "title string, abstract string")
    got = screening.with_keywords(rows, categories).first()
    assert got.kw_categories == ["a::b", "x\u0001y"] and got.kw_keywords == ["a::b::" + categories[0][1][0], "x\u0001y::yy"]
    assert screening.with_filter_verdict(rows, [("n\u0001m", "nothing")]).first().missing == ["n\u0001m"]


@pytest.mark.parametrize("mark", ["\u0001", "\u0002", "\u0001@", "\u00012\u0002"])
def test_control_characters_stay_in_texts(spark, mark):
    files = spark.createDataFrame([("r", f"[p.1]\nabc{mark}def\n[p.2]\nx"), ("s", "no page")], "record_id string, value string")
    got = {(r.record_id, r.page): r.text for r in readers.pages_of(files).collect()}
    assert got == {("r", 1): f"\nabc{mark}def\n", ("r", 2): "\nx"}
    entries = spark.createDataFrame([("f.bib", f"junk\n@a{{k1,\n t = {{u{mark}v @a{{x}}}}\n}}\n\n @b{{k2, y}}@c{{k3,z}}\n")], "file string, value string")
    rows = sorted(readers.bibtex_entries(entries).collect(), key=lambda r: r.place)
    assert [(r.kind, r.entry_key) for r in rows] == [("a", "k1"), ("b", "k2"), ("c", "k3")]
    assert f"u{mark}v @a{{x}}" in rows[0].body and rows[1].body == "@b{k2, y}\n"
