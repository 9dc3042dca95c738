"""Venue names: normal form, type marker, keys, and the checks that guard a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions.text import UNICODE, hits, squeeze, strip


def normalize_venue(
    name: Column, stop_phrases: list[str] = fixed.VENUE_STOP_PHRASES, early: bool = False
) -> Column:
    """Key form of a venue name. The early form keeps years, ordinals and parentheses' text."""
    lowered = F.lower(F.coalesce(name, F.lit("")))
    noise = [r"[^\w\s]"] if early else [
        r"\b\d{4}\b", r"\b\d+(?:st|nd|rd|th)\b", r"\([^)]*\)", r"[^\w\s]",
    ]
    gap = "" if early else " "
    steps = [(p, " ") for p in noise] + [(rf"\b{p}\b", gap) for p in stop_phrases]
    return squeeze(reduce(lambda c, s: F.regexp_replace(c, UNICODE + s[0], s[1]), steps, lowered))


def type_marker(name: Column) -> Column:
    """'J' for a journal, 'C' for a conference, '' when unclear."""
    text = F.coalesce(name, F.lit(""))
    journal = hits(text, rf"\b({'|'.join(fixed.JOURNAL_WORDS)})\b")
    conference = hits(text, rf"\b({'|'.join(fixed.CONFERENCE_WORDS)})\b")
    return F.when(journal & ~conference, "J").when(conference & ~journal, "C").otherwise("")


def typed_key(marker: Column, norm: Column) -> Column:
    return F.concat(marker, F.lit(":"), norm)


def typed_keys(name: Column, norm: Column) -> Column:
    """Keys to try, in order: the one of the known type, else journal then conference."""
    marker = type_marker(name)
    return (
        F.when(norm == "", F.array().cast("array<string>"))
        .when(marker != "", F.array(typed_key(marker, norm)))
        .otherwise(F.array(typed_key(F.lit("J"), norm), typed_key(F.lit("C"), norm)))
    )


def token_count(norm: Column) -> Column:
    return F.size(F.filter(F.split(norm, r"(?U)\s+"), lambda t: t != ""))


def is_short_key(norm: Column, limit: int = fixed.SHORT_KEY_TOKENS) -> Column:
    return token_count(norm) <= limit


def content_tokens(c: Column) -> Column:
    """Distinct words without fillers, numbers and ordinals."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(
        words, lambda w: ~w.isin(*fixed.VENUE_FILLERS) & ~w.rlike(r"^\d+(?:st|nd|rd|th)?\z")
    )
    return F.array_distinct(kept)


def containment(inner: Column, outer: Column) -> Column:
    """Share of the words of `inner` (parentheses' text left out) that `outer` has."""
    wanted = content_tokens(F.regexp_replace(F.coalesce(inner, F.lit("")), r"\([^)]*\)", " "))
    shared = F.size(F.array_intersect(wanted, content_tokens(outer)))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(shared / F.size(wanted))


def trailing_acronym(name: Column) -> Column:
    """Text of the closing parentheses when it looks like an acronym, else ''."""
    inside = strip(F.regexp_extract(strip(name), r"\(([^)]+)\)\s*\z", 1))
    return F.when(inside.rlike(r"^[A-Za-z][A-Za-z0-9 \-]{0,20}\z"), inside).otherwise("")


def adopted(source: Column, rank: Column) -> Column:
    """High enough: A*/A on list A (CORE), Q1 on list B (SJR)."""
    return F.coalesce(
        ((source == "CORE") & rank.isin(*fixed.HIGH_RANKS)) | ((source == "SJR") & (rank == "Q1")),
        F.lit(False),
    )


def rank_label(ranking_source: Column, core_rank: Column, quartile: Column, origin: Column) -> Column:
    source = F.coalesce(ranking_source, F.lit(""))
    return (
        F.when(source.startswith("CORE"), strip(F.concat(F.lit("CORE "), F.coalesce(core_rank, F.lit("")))))
        .when(source.startswith("SJR"), strip(F.concat(F.lit("SJR "), F.coalesce(quartile, F.lit("")))))
        .when(origin == "snowballing", "—(引用探索)")
        .otherwise(source)
    )
