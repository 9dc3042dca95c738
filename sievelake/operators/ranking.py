"""Ranking lists and the alias list as key tables, and what a rank means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import venues
from sievelake.functions.text import strip
from sievelake.session import spread_work


def _last(df: DataFrame, key: str) -> DataFrame:
    """The entry written last under each key, and where the key was first written."""
    return df.groupBy(key).agg(
        F.max_by("entry", "place").alias("entry"), F.min("place").alias("first_place")
    )


def _first(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by("entry", "place").alias("entry"))


def _typed(entries: DataFrame, default: str) -> DataFrame:
    marker = venues.type_marker(F.col("title"))
    key = venues.typed_key(F.when(marker == "", default).otherwise(marker), F.col("norm"))
    return _first(entries.select(key.alias("key"), "entry", "place"), "key")


def list_a(rows: DataFrame) -> dict[str, DataFrame]:
    """Key tables of list A from (ord, title, acronym, rank); rows without a title are left out.

    `keys` holds normalised titles and lower-case acronyms in one namespace, the last
    writer wins; `typed` holds marker:title keys, the first wins.
    """
    entries = (
        spread_work(rows, "ord").select("ord", *[strip(F.col(c)).alias(c) for c in ("title", "acronym", "rank")])
        .where("title <> ''")
        .withColumn("norm", venues.normalize_venue(F.col("title")))
        .withColumn("entry", F.struct("title", "acronym", "rank"))
        .withColumn("place", F.col("ord") * 2)
    )
    named = F.array(
        F.struct(F.col("norm").alias("key"), F.col("place").alias("place")),
        F.struct(F.lower("acronym").alias("key"), (F.col("place") + 1).alias("place")),
    )
    keys = F.when(F.col("acronym") == "", F.slice(named, 1, 1)).otherwise(named)
    spread = entries.select("entry", F.explode(keys).alias("k")).select("k.key", "k.place", "entry")
    return {"keys": _last(spread, "key"), "typed": _typed(entries, "C")}


def list_b(rows: DataFrame) -> dict[str, DataFrame]:
    """Key tables of list B from (ord, title, rank, issn).

    `keys` holds normalised and lower-case titles (last wins), `typed` marker:title keys
    (first wins), `issn` one row per ISSN without hyphens (last wins).
    """
    entries = (
        spread_work(rows, "ord").select("ord", *[F.regexp_replace(strip(F.col(c)), '^"+|"+$', "").alias(c)
                             for c in ("title", "rank", "issn")])
        .where("title <> ''")
        .withColumn("norm", venues.normalize_venue(F.col("title")))
        .withColumn("entry", F.struct("title", F.lit("").alias("acronym"), "rank"))
        .withColumn("place", F.col("ord") * 2)
    )
    both = F.array(
        F.struct(F.col("norm").alias("key"), F.col("place").alias("place")),
        F.struct(F.lower("title").alias("key"), (F.col("place") + 1).alias("place")),
    )
    keys = entries.select("entry", F.explode(both).alias("k")).select("k.key", "k.place", "entry")
    numbers = entries.select("entry", "place", F.explode(issn_list(F.col("issn"))).alias("key"))
    return {
        "keys": _last(keys, "key"),
        "typed": _typed(entries, "J"),
        "issn": _last(numbers, "key"),
    }


def issn_list(cell: Column) -> Column:
    """ISSNs of a cell, split on commas and white space, hyphens removed."""
    parts = F.split(F.coalesce(cell, F.lit("")), r"(?U)[,\s]+")
    return F.filter(F.transform(parts, lambda p: F.replace(p, F.lit("-"), F.lit(""))), lambda p: p != "")


def alias_lists(rows: DataFrame) -> dict[str, DataFrame]:
    """Alias tables from (ord, raw, canonical, rank).

    Rows without a name or a usable rank ("CORE A*", "SJR Q2") are dropped. `exact` is by
    lower-case name, last wins. `norm` is by normalised name: the canonical name written
    first keeps the key, with its own latest entry; other canonical names are `conflicts`.
    """
    cleaned = rows.select("ord", *[strip(F.col(c)).alias(c) for c in ("raw", "canonical", "rank")])
    parts = F.split("rank", r"(?U)\s+", 2)
    entries = cleaned.select("ord", "raw", "canonical", "rank", parts.alias("p")).where(
        (F.col("raw") != "") & ~F.upper("rank").startswith("MANUAL") & (F.size("p") == 2)
        & F.get("p", F.lit(0)).isin("CORE", "SJR")
    ).select(
        F.col("ord").alias("place"), "raw", "canonical",
        F.struct("canonical", F.get("p", F.lit(0)).alias("source"),
                 strip(F.get("p", F.lit(1))).alias("rank")).alias("entry"),
        venues.normalize_venue(F.col("raw")).alias("norm"),
    )
    exact = _last(entries.select(F.lower("raw").alias("key"), "entry", "place"), "key")
    per_name = entries.groupBy("norm", "canonical").agg(
        F.min("place").alias("first_place"), F.max_by("entry", "place").alias("entry")
    )
    norm = per_name.groupBy(F.col("norm").alias("key")).agg(
        F.min_by("entry", "first_place").alias("entry"),
        F.min_by("canonical", "first_place").alias("kept"),
        F.count("*").alias("names"),
    )
    return {
        "exact": exact.select("key", "entry"),
        "norm": norm.select("key", "entry"),
        "conflicts": norm.where("names > 1").select("key", "kept", "names"),
    }


def alias_lookup(venues_df: DataFrame, aliases: dict[str, DataFrame]) -> DataFrame:
    """Adds `alias` (canonical, source, rank) or NULL: exact name first, then normalised."""
    low = F.lower(strip(F.col("venue")))
    looked = (
        venues_df.withColumn("_low", low)
        .withColumn("_norm", venues.normalize_venue(F.col("venue")))
        .join(aliases["exact"].select(F.col("key").alias("_low"), F.col("entry").alias("_exact")), "_low", "left")
        .join(aliases["norm"].select(F.col("key").alias("_norm"), F.col("entry").alias("_by_norm")), "_norm", "left")
    )
    return looked.withColumn("alias", F.coalesce("_exact", "_by_norm")).drop(
        "_low", "_norm", "_exact", "_by_norm"
    )


def adoption_bucket(source: Column, rank: Column) -> Column:
    """include / review / exclude, where the second quartile goes to review."""
    return (
        F.when(venues.adopted(source, rank), "include")
        .when((source == "SJR") & (rank == "Q2"), "review")
        .otherwise("exclude")
    )


def rank_note(rows: DataFrame, a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Adds `venue_rank_note`: rank on list A, else on list B, else unmatched; '' without a venue."""
    norm = venues.normalize_venue(F.col("venue"))
    joined = (
        rows.withColumn("_norm", norm)
        .join(a["keys"].select(F.col("key").alias("_norm"), F.col("entry.rank").alias("_a")), "_norm", "left")
        .join(b["keys"].select(F.col("key").alias("_norm"), F.col("entry.rank").alias("_b")), "_norm", "left")
    )
    note = (
        F.when(F.coalesce(F.col("venue"), F.lit("")) == "", "")
        .when(F.col("_a").isNotNull(), F.concat(F.lit("CORE "), "_a"))
        .when(F.col("_b").isNotNull(), F.concat(F.lit("SJR "), "_b"))
        .otherwise("未照合")
    )
    return joined.withColumn("venue_rank_note", note).drop("_norm", "_a", "_b")
