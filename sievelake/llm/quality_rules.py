"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the whole text, so the verdict is made where the
row is read: no shuffle, no user function. The measures of one text (all words are runs of
characters other than the six ASCII white-space characters):

    n_words          words
    word_chars       code points in words
    n_symbols        characters of `#*$%&|<>`
    n_dup_lines      lines with a word that equal an earlier line
    n_repeat_words   words inside 3-word windows that the text has twice or more
    n_stop_words     words of a stop-word list, case ignored
    n_lines          lines with a word
    n_bullet_lines   of these, lines that start with a list mark
    n_open_lines     of these, lines that end in an ellipsis
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import WORD, fresh

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
            "n_bullet_lines", "n_open_lines")

#: Function words of four languages.
STOP_WORDS = (
    "the of and to in is that for it as with was on be by this are from or an at not which have "
    "der die das und ist nicht mit den von zu ein eine auf im des sich dem auch als für "
    "le la les et des est dans pour que qui une du pas sur avec ce par au plus de "
    "el los las y del que en por con para su una al lo como más no es se"
).split()


@dataclass(frozen=True)
class Rule:
    """`low <= scale * measure / base <= high`; a missing bound does not bind, a base of 0 passes.

    Both sides are compared as whole numbers times the base, never as rounded quotients.
    """

    name: str
    measure: str
    low: int | None = None
    high: int | None = None
    base: str | None = None
    scale: int = 1

    def broken(self, value) -> Column:
        left = value(self.measure) * self.scale
        unit = value(self.base) if self.base else F.lit(1)
        tests = [left < self.low * unit] if self.low is not None else []
        tests += [left > self.high * unit] if self.high is not None else []
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out


#: What makes a text unusable whatever else it has.
BASE_RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_words", "n_repeat_words", high=50, base="n_words", scale=100),
)
#: The method's own table.
METHOD_RULES = (
    Rule("word_length", "word_chars", low=2, high=12, base="n_words"),
    Rule("symbols", "n_symbols", high=10, base="n_words", scale=100),
    Rule("stop_words", "n_stop_words", low=2, base="n_words", scale=100),
    Rule("repeated_lines", "n_dup_lines", high=50, base="n_lines", scale=100),
    Rule("bullet_lines", "n_bullet_lines", high=90, base="n_lines", scale=100),
    Rule("open_lines", "n_open_lines", high=30, base="n_lines", scale=100),
)


def measured(docs: DataFrame, text: str = "text", out: str = "quality", stop_words=STOP_WORDS) -> DataFrame:
    """`docs` with a struct column `out` of `MEASURES` (bigint each).

    A null or empty text, or one of white space only, has 0 everywhere. Windows of words are
    compared by 64-bit hashes within one text. A column named `out` is replaced; all others,
    and repeated rows, come through as they are.
    """
    t, w, h, s, p, ln = (fresh(x, docs) for x in ("text", "words", "hashes", "sorted", "places", "lines"))
    spoken = [x.lower() for x in stop_words]
    window = lambda i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)).otherwise(
        F.array().cast("array<bigint>"))
    # Most texts repeat no window: only the others have their windows sorted with their places.
    pairs = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    twin = lambda x, k: x["h"].eqNullSafe(F.get(F.col(s), k)["h"])
    places = F.sort_array(F.transform(F.filter(s, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        F.col(p),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    no_symbols = F.regexp_replace(t, r"[#*$%&|<>]+", "")
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(t) - F.length(no_symbols),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": covered,
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(spoken))),
        "n_lines": F.size(ln),
        "n_bullet_lines": F.size(F.filter(ln, lambda x: x.rlike(r"^[\x20\x09-\x0D]*(?:[-*•‣◦])[\x20\x09]"))),
        "n_open_lines": F.size(F.filter(ln, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    return (
        docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
        .withColumns({w: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
                      ln: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
        .withColumn(h, hashes).withColumn(s, pairs).withColumn(p, places)
        # One struct in an array, taken out again: conditions on measures stay above it, where they
        # are cheap, and are not pushed down as copies of what is measured.
        .withColumn(out, F.explode(F.array(F.struct(*[values[m].cast("bigint").alias(m) for m in MEASURES]))))
        .drop(t, w, h, s, p, ln)
    )


def judged(docs: DataFrame, text: str = "text", out: str = "quality", base=BASE_RULES, rules=METHOD_RULES,
           stop_words=STOP_WORDS) -> DataFrame:
    """`measured` with `base_failed`, `kept` and `reasons` (names of broken rules) in the struct.

    `kept` is false if a base rule is broken, else whether no rule of the method is. An empty
    or null text has no words, so it breaks the first base rule.
    """
    rows = measured(docs, text, out, stop_words)
    value = lambda m: F.col(out)[m]
    any_of = lambda table: F.coalesce(*[F.when(r.broken(value), F.lit(True)) for r in table], F.lit(False))
    names = F.array_compact(F.array(*[F.when(r.broken(value), F.lit(r.name)) for r in (*base, *rules)]))
    return rows.withColumn(out, F.struct(
        *[value(m).alias(m) for m in MEASURES], any_of(base).alias("base_failed"),
        (~any_of((*base, *rules))).alias("kept"), names.alias("reasons")))
