"""String similarity: edit distance natively, Ratcliff/Obershelp and NFKC in Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions import fixed_values as fixed


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; the order of the arguments matters."""
    matcher = difflib.SequenceMatcher(None)
    scores, last = [], None
    for x, y in zip(a, b):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        scores.append(matcher.ratio())
    return pd.Series(scores, dtype="float64")


def raw_similarity(a: Column, b: Column) -> Column:
    return ratio(F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit(""))))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def canonical_text(c: Column) -> Column:
    """NFKC, soft hyphens dropped, straight quotes, lower case."""
    straight = F.translate(nfkc(F.coalesce(c, F.lit(""))), "’‘“”­", "''\"\"")
    return F.lower(straight)


def no_space(canonical: Column) -> Column:
    return F.regexp_replace(canonical, r"(?U)[\s\x1c-\x1f]+", "")


def no_space_or_hyphen(canonical: Column) -> Column:
    return F.replace(no_space(canonical), F.lit("-"), F.lit(""))


def longest(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def allowed_edits(length: Column, floor: float) -> Column:
    """Edits a string pair of this longest length may need; in doubles, truncated."""
    return F.floor(length * F.lit(1 - floor)).cast("int")


def levenshtein_similarity(a: Column, b: Column, floor: float = fixed.FUZZY_TITLE) -> Column:
    """1 - distance / longest length; NULL below the floor and for two empty strings.

    The test is on the truncated number of edits, so a pair may sit exactly on the floor.
    """
    size = longest(a, b)
    if floor <= 0:
        distance = F.levenshtein(a, b)
        return F.when(size > 0, 1 - distance / size)
    distance = F.levenshtein(a, b)
    return F.when((size > 0) & (distance <= allowed_edits(size, floor)), 1 - distance / size)


def edit_similarity(a: Column, b: Column) -> Column:
    """As above without a floor; two empty strings are equal."""
    size = longest(a, b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / size)
