"""Counting reports: distributions, sweeps, cross tables, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import screening
from sievelake.operators.skew import spread_join


def unpivot(row: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """A one-row table of counts as one row per column."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {pairs}) AS ({name}, {value})")


def keyword_report(rows: DataFrame, categories) -> DataFrame:
    """(category, pattern, hits) for every pattern, those without a hit included.

    Equal sets of hits are counted before they are taken apart, so what is exploded does
    not grow with the texts; the pattern list is joined to the counts.
    """
    names = [(c, p) for c, patterns in categories for p in patterns]
    sets = screening.with_keywords(rows, categories).groupBy("kw_keywords").agg(F.count("*").alias("n"))
    counted = sets.select("n", F.explode("kw_keywords").alias("hit")).groupBy("hit").agg(F.sum("n").alias("hits"))
    lines = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"), F.lit(f"{c}::{p}").alias("hit")) for c, p in names])
    listed = rows.sparkSession.range(1).select(F.inline(lines))
    return listed.join(counted, "hit", "left").select(
        "category", "pattern", F.coalesce("hits", F.lit(0)).alias("hits"))


def category_overlap(categories: Column, rows: DataFrame, names: list[str]) -> DataFrame:
    """Members per category, records in several, and excluded records: the identity
    members - surplus = excluded holds."""
    cats = rows.select(categories.alias("cats")).where(F.size("cats") > 0)
    row = cats.agg(
        *[F.count_if(F.array_contains("cats", n)).alias(n) for n in names],
        F.count_if(F.size("cats") > 1).alias("in several"),
        F.coalesce(F.sum(F.size("cats") - 1), F.lit(0)).alias("surplus"), F.count("*").alias("excluded"))
    return unpivot(row, [*names, "in several", "surplus", "excluded"], "figure", "n")


def top_values(rows: DataFrame, column: str, top: int) -> DataFrame:
    """(value, n, covered): the most frequent values and the share of rows they cover together."""
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("t"))
    best = counted.orderBy(F.desc("n"), "value").limit(top)
    covered = best.agg(F.sum("n").alias("c"))
    return best.withColumn("covered", F.round(covered.scalar() / total.scalar(), 6))


def vocabulary_distribution(values: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(value, place, n, percent, listed): counts in vocabulary order, others after it."""
    counted = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("t"))
    place = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.col("value"))
    return counted.select(
        "value", F.when(place == 0, 999).otherwise(place).cast("bigint").alias("place"), "n",
        F.round(F.col("n") * 100 / total.scalar(), 1).alias("percent"), (place > 0).alias("listed"))


def threshold_sweep(rows: DataFrame, metric: Column, year: Column, thresholds: list[int],
                    recent_from: int) -> DataFrame:
    """(threshold, dropped, kept, rescued) for all thresholds in one pass."""
    recent = F.coalesce(year >= recent_from, F.lit(False))
    low = lambda v: F.coalesce(metric, F.lit(0)) < v
    cells = F.array(*[F.struct(
        F.lit(v).cast("bigint").alias("threshold"),
        screening.recent_or_kept(metric, year, v, recent_from).alias("dropped"), (low(v) & recent).alias("rescued"))
        for v in thresholds])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.threshold").agg(
        F.count_if("c.dropped").alias("dropped"), F.count_if(~F.col("c.dropped")).alias("kept"),
        F.count_if("c.rescued").alias("rescued"))


def score_columns(text: Column, categories) -> list[Column]:
    """One 0/1 column per category; patterns are tried as alternatives on lower-case text."""
    return [F.lower(text).rlike("(?U)" + "|".join(patterns)).cast("int").alias(name) for name, patterns in categories]


def score_distribution(rows: DataFrame, text: Column, categories=fixed.SCORE_CATEGORIES) -> DataFrame:
    """(figure, n): hits per category, records per score, records below the cut-offs."""
    names = [name for name, _ in categories]
    scored = rows.select(*score_columns(text, categories))
    score = sum((F.col(f"`{n}`") for n in names), F.lit(0))
    row = scored.agg(
        *[F.coalesce(F.sum(F.col(f"`{n}`")), F.lit(0)).alias(f"hits {n}") for n in names],
        *[F.count_if(score == s).alias(f"score {s}") for s in range(len(names) + 1)],
        *[F.count_if(score < c).alias(f"below {c}") for c in range(1, len(names))])
    return unpivot(row, row.columns, "figure", "n")


def verdict_cross_table(rows: DataFrame, verdict: Column, score: Column, scores: list[int]) -> DataFrame:
    """Rows by verdict, columns by score, with totals."""
    return rows.groupBy(verdict.alias("verdict")).agg(
        *[F.count_if(score == s).alias(f"score_{s}") for s in scores], F.count("*").alias("total"))


def year_histogram(rows: DataFrame, year: str, group: str) -> DataFrame:
    """(year, group, n) for every year between the first and the last, gaps filled with 0."""
    counted = rows.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("year"), F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    low, high = counted.agg(F.min("year").alias("y")), counted.agg(F.max("year").alias("y"))
    frame = counted.select("grp").distinct().select("grp", F.sequence(low.scalar(), high.scalar()).alias("years")).select(
        "grp", F.explode("years").alias("year"))
    return frame.join(counted, ["year", "grp"], "left").select(
        "year", F.col("grp").alias(group), F.coalesce("n", F.lit(0)).alias("n"))


def reconcile(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """(label, got, expected, state): figures against their expected values."""
    return expected.join(metrics, "label", "left").select(
        "label", "got", "expected", F.when(F.col("got") == F.col("expected"), "OK").otherwise("FAIL").alias("state"))


def status_report(rows: DataFrame, status: Column, text: Column) -> DataFrame:
    """(status, n, chars) per status."""
    return rows.groupBy(status.alias("status")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("chars"))


def grouped_list(rows: DataFrame, group: Column) -> DataFrame:
    """Rows with their group's size, for a list that shows the largest group first."""
    named = rows.withColumn("grp", group)
    sizes = named.groupBy("grp").agg(F.count("*").alias("group_size"))
    return spread_join(named, sizes, ["grp"], "inner")


def first_sample(rows: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """A repeatable sample: the rows with the smallest seeded hashes."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key))), key).limit(size)
