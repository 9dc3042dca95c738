"""Concept groups, exclusion keywords and their audit columns, as one pass over the text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions.text import hits, strip

MARK = "\u0001"
Groups = list[tuple[str, str]]
Categories = list[tuple[str, list[str]]]


def joined_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def listed(*names: Column) -> Column:
    """The non-NULL names as an array, in order; `concat_ws` keeps it in generated code."""
    joined = F.concat_ws(MARK, *names)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, MARK))


def missing_groups(text: Column, groups: Groups = fixed.CONCEPT_GROUPS) -> Column:
    """Names of the concept groups the text does not hit, in order."""
    places = listed(*[F.when(~hits(text, p), F.lit(str(i))) for i, (_, p) in enumerate(groups)])
    return _at(places, [name for name, _ in groups])


def with_filter_verdict(rows: DataFrame, groups: Groups = fixed.CONCEPT_GROUPS) -> DataFrame:
    """Adds `verdict`, `reason` and `missing` from title and abstract.

    hold without an abstract, pass when all groups hit, else fail. The text is put
    together once, in a step of its own.
    """
    body = F.col("_body")
    staged = rows.withColumn("_body", strip(F.col("abstract"))).withColumn(
        "_text", joined_text(F.col("title"), body)).withColumn("missing", missing_groups(F.col("_text"), groups))
    complete = F.size("missing") == 0
    verdict = F.when(body == "", "hold").when(complete, "pass").otherwise("fail")
    reason = (
        F.when(body == "", fixed.HOLD_REASON).when(complete, "")
        .otherwise(F.concat(F.lit(fixed.FAIL_PREFIX), F.array_join("missing", " / ")))
    )
    return staged.withColumn("verdict", verdict).withColumn("reason", reason).drop("_body", "_text")


def group_flags(title: Column, abstract: Column, groups: Groups = fixed.CONCEPT_GROUPS) -> list[Column]:
    """One boolean column per group: kw_g1, kw_g2, ..."""
    text = joined_text(title, abstract)
    return [hits(text, p).alias(f"kw_g{i}") for i, (_, p) in enumerate(groups, 1)]


def group_count(title: Column, abstract: Column, groups: Groups = fixed.CONCEPT_GROUPS) -> Column:
    """How many groups hit; used for reading order, never as a filter."""
    text = joined_text(title, abstract)
    return sum((hits(text, p).cast("int") for _, p in groups), F.lit(0))


def _alternatives(pattern: str) -> list[str]:
    """The pattern, cut at every `|` that stands outside all groups, classes, quotations and escapes."""
    depth, at, in_class, cuts = 0, 0, 0, [-1]
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern.startswith("\\Q", at):
                end = pattern.find("\\E", at)
                at = len(pattern) if end < 0 else end
            at += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif not in_class:
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 0:
                cuts.append(at)
        at += 1
    return [pattern[i + 1:j] for i, j in zip(cuts, [*cuts[1:], len(pattern)])]


def required_start(pattern: str) -> str:
    """The literal text every match of a pattern starts with, '' when there is none."""
    body = pattern.removeprefix(r"\b")
    if len(_alternatives(body)) > 1:
        return ""
    literal = re.match(r"[a-z0-9 ]*", body).group()
    following = body[len(literal):len(literal) + 1]
    return literal[:-1] if following and following in "?*{" else literal


def hits_lowered(text: Column, pattern: str) -> Column:
    """As `hits`, for lower-case text: the regular expression runs only on texts that
    contain the literal start of the pattern, a much cheaper test, and tries its word
    boundary only where that start stands. Alternatives that all have such a start are
    tested one by one, unless the pattern refers back to a group or sets flags on its way."""
    parts = _alternatives(pattern)
    if len(parts) > 1 and all(map(required_start, parts)) and not re.search(r"\\[1-9k]|\(\?[a-zA-Z-]+\)", pattern):
        return reduce(lambda a, b: a | b, [hits_lowered(text, part) for part in parts])
    start = required_start(pattern)
    if not start:
        return hits(text, pattern)
    # Lower-case letters that are the same as an ASCII one when case is ignored.
    found = reduce(lambda a, b: a | b, [text.contains(x) for x in (start, *[c for c, same in (("\u017f", "s"), ("\u0131", "i")) if same in start])])
    return found & hits(text, f"(?={start}){pattern}")


def _places(text: Column, categories: Categories) -> Column:
    """Places (as text) of the patterns that hit, in the order of the list."""
    patterns = [p for _, ps in categories for p in ps]
    return listed(*[F.when(hits_lowered(text, p), F.lit(str(i))) for i, p in enumerate(patterns)])


def _at(places: Column, values: list[str]) -> Column:
    """The values that stand at those places."""
    known = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    return F.transform(places, lambda i: F.get(known, i.cast("int")))


def keyword_hits(text: Column, categories: Categories = fixed.EXCLUSION_CATEGORIES) -> Column:
    """Every `category::pattern` that hits a lower-case text, in list order."""
    return _at(_places(text, categories), [f"{name}::{p}" for name, ps in categories for p in ps])


def with_keywords(rows: DataFrame, categories: Categories = fixed.EXCLUSION_CATEGORIES) -> DataFrame:
    """Adds the arrays `kw_keywords` and `kw_categories`; both empty for a record that stays."""
    lowered = F.lower(joined_text(F.col("title"), F.col("abstract")))
    staged = rows.withColumn("_text", lowered).withColumn("_places", _places(F.col("_text"), categories))
    keywords = _at(F.col("_places"), [f"{name}::{p}" for name, ps in categories for p in ps])
    names = F.array_distinct(_at(F.col("_places"), [name for name, ps in categories for _ in ps]))
    return staged.withColumn("kw_keywords", keywords).withColumn("kw_categories", names).drop("_text", "_places")


def term_matches(text: Column, pattern: str = fixed.SHAPE_TERMS) -> Column:
    """Distinct lower-cased matches of a pattern, sorted, `;` joined."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?iU)" + pattern), 0)
    return F.array_join(F.array_sort(F.array_distinct(found)), ";")


def recent_or_kept(metric: Column, year: Column, threshold: float, recent_from: int = 2023) -> Column:
    """Dropped by a metric threshold, unless recent. An unknown year is not recent."""
    return (F.coalesce(metric, F.lit(0)) < threshold) & ~F.coalesce(year >= recent_from, F.lit(False))


def below_and_old(metric: Column, year: Column, threshold: float, recent_from: int = 2023) -> Column:
    """The cross-table's variant: an unknown year is never dropped."""
    return (F.coalesce(metric, F.lit(0)) < threshold) & F.coalesce(year < recent_from, F.lit(False))


def boolean_query(groups: list[list[str]], one) -> str:
    """All groups, of each any term; `one` writes the forms of a term."""
    return " AND ".join(f"({' OR '.join(form for term in terms for form in one(term))})" for terms in groups)


def fielded_query(terms: list[list[str]] = fixed.CONCEPT_TERMS,
                  fields: tuple[str, ...] = ("Document Title", "Abstract")) -> str:
    """The concept groups as a query that names the field of every term."""
    return boolean_query(terms, lambda t: [f'"{name}":"{t}"' for name in fields])


def scoped_query(terms: list[list[str]] = fixed.CONCEPT_TERMS, scope: str = "TITLE-ABS") -> str:
    """The concept groups as one scoped query."""
    return f"{scope}({boolean_query(terms, lambda t: [chr(34) + t + chr(34)])})"


def term_predicate(text: Column, terms: list[list[str]] = fixed.CONCEPT_TERMS) -> Column:
    """The same groups as a predicate: whole words, a trailing `*` for any ending."""
    test = F.lit(True)
    for group in terms:
        words = [
            _quote(t[:-1]) + r"\w*" if t.endswith("*") else _quote(t)
            for t in group
        ]
        test = test & hits(text, r"\b(?:" + "|".join(words) + r")\b")
    return test


def _quote(term: str) -> str:
    return r"\Q" + term + r"\E"
