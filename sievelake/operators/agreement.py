"""Agreement between reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import labels


def reviewer_pairs(sheet: DataFrame, reviewers: list[str] = fixed.REVIEWERS) -> DataFrame:
    """(record_id, rater_a, rater_b, a, b) for every two reviewers with a valid decision.

    One row per record holds the reviewers' decisions (as many columns as reviewers), so
    pairs are formed within the row, not by a self join.
    """
    canon = labels.canonical_decision(F.col("decision"))
    wide = sheet.groupBy("record_id").agg(*[
        F.max(F.when((F.col("reviewer") == r) & (canon != ""), canon)).alias(r) for r in reviewers])
    pairs = F.array(*[
        F.struct(F.lit(p).alias("rater_a"), F.lit(q).alias("rater_b"), F.col(p).alias("a"), F.col(q).alias("b"))
        for i, p in enumerate(reviewers) for q in reviewers[i + 1:]])
    return wide.select("record_id", F.explode(pairs).alias("p")).where(
        "p.a IS NOT NULL AND p.b IS NOT NULL").select("record_id", "p.*")


def cohen_kappa(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, po, pe, kappa) from rows (keys, a, b); NaN when chance agreement is 1.

    All rows are first counted into a contingency table, whose size depends on the
    categories only.
    """
    table = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    totals = table.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side_a = table.groupBy(*keys, F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    side_b = table.groupBy(*keys, F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    product = side_a.join(side_b, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    joined = totals.join(product, keys, "left").na.fill(0, ["cross"])
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, F.col("cross") / (n * n)
    kappa = F.when(F.abs(1 - pe) < 1e-12, F.lit(float("nan"))).otherwise((po - pe) / (1 - pe))
    return joined.select(*keys, "n", po.alias("po"), pe.alias("pe"), kappa.alias("kappa"))


def mean_kappa(kappas: DataFrame) -> DataFrame:
    """One row: mean over the defined kappas, how many pairs are low, label and action."""
    defined = F.when(~F.isnan("kappa"), F.col("kappa"))
    row = kappas.agg(F.avg(defined).alias("mean_kappa"), F.count_if(defined < 0.41).alias("low_pairs"),
                     F.count(defined).alias("pairs"))
    return row.withColumn("label", labels.agreement_label(F.col("mean_kappa"))).withColumn(
        "action", labels.agreement_action(F.col("mean_kappa"), F.col("low_pairs")))


def two_categories(pairs: DataFrame) -> DataFrame:
    """Unsure counted as Include."""
    fold = lambda c: F.when(F.col(c) == "Unsure", "Include").otherwise(F.col(c)).alias(c)
    return pairs.select(*[fold(c) if c in ("a", "b") else F.col(c) for c in pairs.columns])


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Full-text pairs (pair, a_decision, b_decision): kappa on Include/Exclude, Unsure apart."""
    binary = F.col("a_decision").isin("Include", "Exclude") & F.col("b_decision").isin("Include", "Exclude")
    kappas = cohen_kappa(
        pairs.where(binary).select("pair", F.col("a_decision").alias("a"), F.col("b_decision").alias("b")), ["pair"])
    counts = pairs.groupBy("pair").agg(
        F.count("*").alias("records"),
        F.count_if((F.col("a_decision") == "Unsure") | (F.col("b_decision") == "Unsure")).alias("unsure"),
        F.count_if(binary & (F.col("a_decision") != F.col("b_decision"))).alias("disagree"))
    return counts.join(kappas, "pair", "left")


def criterion_summary(pairs: DataFrame, criteria: list[str] = fixed.CRITERIA) -> DataFrame:
    """Per pair and criterion: both answered Y or N, agreements, disagreements, any '?'.

    `pairs` has columns a_<criterion> and b_<criterion>; all counts come from one pass.
    """
    def yes_no(k: str) -> Column:
        return F.col(f"a_{k}").isin("Y", "N") & F.col(f"b_{k}").isin("Y", "N")

    cells = F.array(*[F.struct(
        F.lit(k).alias("criterion"), yes_no(k).alias("yn"), (F.col(f"a_{k}") == F.col(f"b_{k}")).alias("same"),
        ((F.col(f"a_{k}") == "?") | (F.col(f"b_{k}") == "?")).alias("q")) for k in criteria])
    return pairs.select("pair", F.explode(cells).alias("c")).groupBy("pair", "c.criterion").agg(
        F.count_if("c.yn").alias("n"), F.count_if(F.col("c.yn") & F.col("c.same")).alias("agree"),
        F.count_if(F.col("c.yn") & ~F.col("c.same")).alias("disagree"), F.count_if("c.q").alias("unsure"))


def vote_summary(sheet: DataFrame, reviewers: list[str] = fixed.REVIEWERS) -> DataFrame:
    """(record_id, vote, distinct_votes): `Exclude×2 / Unsure×1`, most votes first, then the
    order of the reviewers. One row per reviewer and record, so the lists are short."""
    canon = labels.canonical_decision(F.col("decision"))
    place = F.array_position(F.array(*[F.lit(r) for r in reviewers]), F.col("reviewer"))
    counted = sheet.where(canon != "").groupBy("record_id", canon.alias("d")).agg(
        F.count("*").alias("n"), F.min(place).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "d", "n")))
    return counted.groupBy("record_id").agg(
        F.array_join(F.transform(ordered, lambda e: F.concat(e["d"], F.lit("×"), e["n"].cast("string"))), " / ").alias("vote"),
        F.count("*").alias("distinct_votes"))
