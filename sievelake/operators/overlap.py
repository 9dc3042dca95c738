"""How sources overlap, what is new, and how complete their exports are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions.text import strip
from sievelake.operators.skew import spread_join


def flag_known(found: DataFrame, corpus: DataFrame, key: str = "record_key") -> DataFrame:
    """Adds `in_corpus`: 'Y' when the record's key is in the corpus."""
    known = corpus.select(key).distinct().withColumn("_known", F.lit(True))
    return spread_join(found, known, [key], "left").withColumn(
        "in_corpus", F.when(F.col("_known"), "Y").otherwise("N")).drop("_known")


def only_in(records: DataFrame, group: str, value: str, key: str = "record_key") -> DataFrame:
    """Records of one source whose key no other source has.

    Keys are reduced to one row with a flag first, so no key is compared row by row.
    """
    seen = records.groupBy(key).agg(F.bool_or(F.col(group) != value).alias("_elsewhere"))
    return records.where(F.col(group) == value).join(seen.where("NOT _elsewhere").select(key), key, "left_semi")


def pairwise_overlap(records: DataFrame, group: str, key: str = "record_key") -> DataFrame:
    """(a, b, common): keys that two sources share, for every pair that shares one.

    Each key is first reduced to its set of sources and equal sets are counted; pairs are
    formed from the distinct sets only. A set is at most as long as the list of sources.
    """
    sets = records.groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("sources")).where(F.size("sources") > 1)
    counted = sets.groupBy("sources").agg(F.count("*").alias("n"))
    firsts = counted.select("sources", "n", F.posexplode("sources").alias("i", "a"))
    pairs = firsts.select("n", "a", F.explode(F.slice("sources", F.col("i") + 2, F.size("sources"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("common"))


def export_completeness(records: DataFrame, expected: DataFrame | None = None,
                        suspicious: list[int] = fixed.SUSPICIOUS_COUNTS,
                        recent_since: int = fixed.RECENT_SINCE) -> DataFrame:
    """One row per file: counts, filled fields, recent share, and whether it looks cut off.

    `records` has (file, record_key, doi, abstract, year), `expected` (file, expected).
    """
    filled = lambda c: strip(F.col(c)) != ""
    year = strip(F.col("year"))
    recent = F.when(year.rlike(r"^\d+$"), year.try_cast("bigint") >= recent_since).otherwise(False)
    per_key = records.groupBy("file", "record_key").agg(
        F.count("*").alias("n"), F.count_if(filled("doi")).alias("doi"), F.count_if(filled("abstract")).alias("abs"),
        F.count_if(recent).alias("recent"))
    per_file = per_key.groupBy("file").agg(
        F.sum("n").alias("records"), F.count("*").alias("unique_keys"), F.sum("doi").alias("doi_filled"),
        F.sum("abs").alias("abstract_filled"), F.sum("recent").alias("recent"))
    rows = per_file.select(
        "file", "records", "unique_keys", (F.col("records") - F.col("unique_keys")).alias("dup_in_file"),
        "doi_filled", "abstract_filled", F.round(F.col("recent") * 100 / F.col("records"), 1).alias("recent_pct"),
        F.when(F.col("records").isin(*suspicious), "Y").otherwise("N").alias("truncation_suspected"))
    if expected is None:
        return rows
    gap = F.col("records") - F.col("expected")
    return rows.join(expected, "file", "left").withColumn("difference", gap).drop("expected")


def source_dates(records: DataFrame) -> DataFrame:
    """Per source: records, and a `date: n, ...` breakdown by the first ten characters.

    Counting comes first; a source has at most one entry per day.
    """
    days = records.groupBy("source", F.substring("added", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("source").agg(
        F.sum("n").alias("records"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))),
                                 lambda e: F.concat(e["day"], F.lit(": "), e["n"].cast("string"))), ", ").alias("dates"))


def key_agreement(raw: DataFrame, merged: DataFrame, key: str = "key") -> DataFrame:
    """One row: distinct keys, keys in several collections, and the keys missing on either side."""
    left = raw.where(strip(F.col(key)) != "").groupBy(strip(F.col(key)).alias(key)).agg(F.count("*").alias("n"))
    right = merged.where(strip(F.col(key)) != "").select(strip(F.col(key)).alias(key)).distinct().withColumn("m", F.lit(1))
    return left.join(right, key, "full").agg(
        F.count_if(F.col("n").isNotNull()).alias("raw_keys"), F.count_if(F.col("n") > 1).alias("several"),
        F.count_if(F.col("m").isNull()).alias("missing_in_merged"), F.count_if(F.col("n").isNull()).alias("only_in_merged"))


def expected_received(expected: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Ids missing from, or foreign to, what was asked for; both directions in one full join."""
    left = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    right = received.select(*keys).distinct().withColumn("_r", F.lit(1))
    return left.join(right, keys, "full").where("_e IS NULL OR _r IS NULL").select(
        *keys, F.when(F.col("_r").isNull(), "missing").otherwise("foreign").alias("problem"))


def fill_blank(found: DataFrame, lookup: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fills blank fields from the lookup row of the same key; rows without a key stay as they are."""
    given = lookup.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    keyed = found.withColumn(key, F.nullif(F.col(key), F.lit("")))
    joined = spread_join(keyed, given, [key], "left")
    blank = F.lit("")
    return joined.select(*[
        F.coalesce(F.nullif(F.col(c), blank), F.col(f"_{c}"), blank).alias(c) if c in fields
        else F.coalesce(F.col(c), blank).alias(c) if c == key else F.col(c)
        for c in found.columns])


def enrich_abstracts(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds cached abstracts where the record has none, and `abstract_source`.

    Only for people to read: enriched texts must not be screened again.
    """
    ready = cache.where((strip(F.col("abstract")) != "") & (F.col("doi") != "")).groupBy("doi").agg(
        F.max_by(strip(F.col("abstract")), "ord").alias("_cached"))
    keyed = records.withColumn("_own", strip(F.col("abstract"))).withColumn("doi", F.nullif(F.col("doi"), F.lit("")))
    joined = spread_join(keyed, ready, ["doi"], "left")
    source = F.when(F.col("_own") != "", "database").when(F.col("_cached").isNotNull(), "enriched").otherwise("none")
    return joined.withColumn("abstract", F.coalesce(F.nullif("_own", F.lit("")), "_cached", F.lit(""))).withColumn(
        "abstract_source", source).withColumn("doi", F.coalesce("doi", F.lit(""))).drop("_own", "_cached")


def enrichment_queue(records: DataFrame, cache: DataFrame, retry_not_found: bool = False) -> DataFrame:
    """DOIs to look up: no abstract, and not settled in the cache.

    A rate-limited answer is always asked for again, a not-found one only on request.
    """
    open_rows = records.where((F.col("doi") != "") & (strip(F.col("abstract")) == "")).select("ord", "doi")
    retried = ["ratelimited"] + (["notfound"] if retry_not_found else [])
    settled = cache.where(~F.col("status").isin(*retried)).select("doi").distinct()
    return open_rows.join(settled, "doi", "left_anti")


def translation_queue(texts: DataFrame, cache: DataFrame, scope: Column | None = None) -> DataFrame:
    """Texts not translated yet, or changed since: the hash of the source decides."""
    rows = texts.where(strip(F.col("abstract")) != "")
    rows = rows if scope is None else rows.where(scope)
    hashed = rows.withColumn("src_sha1", F.sha1(strip(F.col("abstract"))))
    return hashed.join(cache.select("record_id", "src_sha1"), ["record_id", "src_sha1"], "left_anti").select(
        "record_id", F.length(strip(F.col("abstract"))).cast("bigint").alias("chars"))


def attach_translation(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds the translation where the text is still the one that was translated."""
    hashed = texts.withColumn("src_sha1", F.sha1(strip(F.col("abstract"))))
    return hashed.join(cache.select("record_id", "src_sha1", "ja"), ["record_id", "src_sha1"], "left").withColumn(
        "ja", F.coalesce("ja", F.lit(""))).drop("src_sha1")


def override_flag(rows: DataFrame, truth: DataFrame, flag: str = "calibration", key: str = "record_id") -> DataFrame:
    """The flag of the table of record wins; `drifted` marks rows that it changed."""
    given = truth.select(key, F.col(flag).alias("_flag"))
    joined = rows.join(given, key, "left")
    wanted = F.coalesce("_flag", flag)
    return joined.withColumn("drifted", wanted != F.col(flag)).withColumn(flag, wanted).drop("_flag")


def metadata_fallback(rows: DataFrame, by_doi: DataFrame, by_title: DataFrame, by_id: DataFrame) -> DataFrame:
    """(venue, year) by DOI, else by title key, else by record id; the first source row of a key counts.

    The lookups have (key, ord, venue, year); those by id skip blank venues.
    """
    pair = F.struct("venue", "year")
    first = lambda d, name: d.groupBy("key").agg(F.min_by(pair, "ord").alias(f"_{name}"))
    keyed = rows.withColumn("_doi", F.nullif(F.lower("doi"), F.lit("")))
    joined = (
        spread_join(keyed.withColumnRenamed("_doi", "key"), first(by_doi.where("key <> ''"), "d"), ["key"], "left").drop("key")
        .withColumn("key", F.col("title_key")))
    joined = spread_join(joined, first(by_title, "t"), ["key"], "left").drop("key").withColumn("key", F.col("record_id"))
    joined = joined.join(first(by_id.where("venue <> ''"), "i"), "key", "left").drop("key")
    best = F.coalesce("_d", "_t", "_i")
    return joined.withColumn("venue", F.coalesce(best["venue"], F.lit(""))).withColumn(
        "year", F.coalesce(best["year"], F.lit(""))).drop("_d", "_t", "_i")


def first_filled_file(rows: DataFrame, key: str) -> DataFrame:
    """(key, venue, year) from the first file in name order that gives a venue."""
    place = F.struct("file", "ord")
    return rows.where((F.col(key) != "") & (F.col("venue") != "")).groupBy(key).agg(
        F.min_by(F.struct("venue", "year"), place).alias("m")).select(key, "m.venue", "m.year")
