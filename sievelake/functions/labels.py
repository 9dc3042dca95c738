"""Labels derived from other columns: decisions, reasons, agreement, drop causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions.text import ordered_label, squeeze, strip


def canonical_decision(c: Column) -> Column:
    """Include / Exclude / Unsure in canonical case, '' for anything else."""
    given = F.lower(strip(c))
    return ordered_label(*[(given == d.lower(), d) for d in fixed.DECISIONS], otherwise="")


def expected_decision(answers: list[Column]) -> Column:
    """Any N excludes; a blank leaves it open; any ? is unsure; all Y include."""
    values = F.array(*[strip(a) for a in answers])
    return (
        F.when(F.array_contains(values, "N"), "Exclude")
        .when(F.array_contains(values, ""), "")
        .when(F.array_contains(values, "?"), "Unsure")
        .otherwise("Include")
    )


def auto_reason(answers: dict[str, Column]) -> Column:
    """Reason of the highest-priority criterion answered N, '' when there is none."""
    picks = [F.when(strip(answers[k]) == "N", F.lit(r)) for k, r in fixed.REASON_OF_CRITERION]
    return F.coalesce(*picks, F.lit(""))


def agreement_label(kappa: Column) -> Column:
    unclear = kappa.isNull() | F.isnan(kappa)
    return ordered_label(
        (unclear, fixed.AGREEMENT_UNDEFINED),
        *[(kappa < bound, label) for bound, label in fixed.AGREEMENT_LABELS],
        otherwise=fixed.AGREEMENT_TOP,
    )


def agreement_action(mean_kappa: Column, low_pairs: Column) -> Column:
    """The action agreed on beforehand for a mean kappa and the number of low pairs."""
    band = ordered_label(
        (mean_kappa.isNull() | F.isnan(mean_kappa), "undefined"),
        (mean_kappa >= 0.61, "continue"),
        (mean_kappa >= 0.41, "discuss and inspect reasons"),
        otherwise="widen stage 2",
    )
    extra = F.when((mean_kappa >= 0.41) & (low_pairs > 0), "; low pairs: lower band applies").otherwise("")
    return F.concat(band, extra)


def rank_drop_reason(reason: Column, venue: Column, matched: Column, core_rank: Column,
                     quartile: Column) -> Column:
    """Why the ranking stage dropped a record, as a sentence."""
    why = strip(reason)
    name = F.when(strip(venue) == "", "(空欄)").otherwise(strip(venue))
    q = F.when(quartile.isNull(), "?").otherwise(strip(quartile))
    r = F.when(core_rank.isNull(), "?").otherwise(strip(core_rank))
    target = strip(matched)
    return (
        F.when(why.startswith("Venue not found"),
               F.format_string("Venue名 '%s' が CORE/SJR いずれにも未照合", name))
        .when(why.startswith("SJR"),
              F.format_string("SJR '%s' のため除外 (venue: '%s' → 照合先: '%s')", q, name, target))
        .when(why.startswith("CORE"),
              F.format_string("CORE Rank '%s' (< A) のため除外 (venue: '%s' → 照合先: '%s')", r, name, target))
        .when(why == "", "理由不明(除外CSVに理由列なし)")
        .otherwise(why)
    )


def keyword_drop_reason(categories: Column, keywords: Column) -> Column:
    return F.format_string("除外キーワード命中: [%s] %s", strip(categories), strip(keywords))


def drop_category(reason: Column) -> Column:
    """struct(category, action) for a drop reason."""
    r = F.coalesce(reason, F.lit(""))
    any_of = lambda *parts: sum((r.contains(p).cast("int") for p in parts), F.lit(0)) > 0
    rules = [
        (any_of("SJR 'Q2'", "SJR 'Q3'", "SJR 'Q4'"), "criterion",
         "keep excluded; report in Threats to Validity"),
        (any_of("未照合"), "unmatched", "check alias/normalization; if truly unlisted -> snowballing"),
        (any_of("CORE Rank 'C'", "CORE Rank 'B'", "CORE Rank 'D'"), "below_rank",
         "keep excluded (quality criterion); recover cited-by via snowballing"),
    ]
    category = ordered_label(*[(c, n) for c, n, _ in rules], otherwise="other")
    action = ordered_label(*[(c, a) for c, _, a in rules], otherwise="manual review")
    return F.struct(category.alias("category"), action.alias("action"))


def safe_file_base(title: Column, fallback: Column, limit: int = 90) -> Column:
    """A file name base without characters that file systems or links refuse."""
    clean = squeeze(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|#%\[\]\x00-\x1f]+', " "))
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+\z", "")
    cut = F.regexp_replace(F.substring(clean, 1, limit), r"[ .]+\z", "")
    return F.when(cut == "", fallback).otherwise(cut)
