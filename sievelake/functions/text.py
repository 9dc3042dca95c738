"""Text helpers shared by all column functions.

Regular expressions use Unicode classes, so `\\b`, `\\w` and `\\s` treat accented
letters as letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"
IGNORE_CASE = "(?iU)"


#: What `(?U)[\s\x1c-\x1f]` matches.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (`trim` only removes spaces). The text between is not looked at."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White-space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def hits(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, ignoring case."""
    return c.rlike(IGNORE_CASE + pattern)


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank, stripped; '' when all are blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))


def ordered_label(*rules: tuple[Column, str | Column], otherwise: str | Column) -> Column:
    """The label of the first rule that holds."""
    chain = None
    for condition, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def split_multi(c: Column) -> Column:
    """Values of a `;`-separated cell (also the full-width semicolon), blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;；]"), strip)
    return F.filter(parts, lambda p: p != "")


def strip_markup(c: Column) -> Column:
    """Drop tags, squeeze, drop a leading "abstract"."""
    plain = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))
    return strip(F.regexp_replace(plain, r"(?i)^\s*abstract\s*", ""))


def try_number(c: Column, kind: str = "double") -> Column:
    """A number, or NULL where the text is not one."""
    return strip(c).try_cast(kind)
