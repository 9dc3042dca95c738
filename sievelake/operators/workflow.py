"""Assignment, sheets and validated decisions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions import fixed_values as fixed
from sievelake.functions import identifiers as ids
from sievelake.functions import labels, screening
from sievelake.functions.text import strip, try_number
from sievelake.operators.overlap import enrich_abstracts
from sievelake.operators.skew import first_per_key, global_rank


def unique_file_names(titles: DataFrame, limit: int = 90) -> DataFrame:
    """(record_id, file_name): the title, or title and id where a title came before.

    Names are compared without case; the lowest record id keeps the plain name.
    """
    based = titles.select("record_id", labels.safe_file_base(F.col("title"), F.col("record_id"), limit).alias("base"))
    owners = based.groupBy(F.lower("base").alias("low")).agg(F.min("record_id").alias("owner"))
    shorter = F.regexp_replace(F.substring("base", 1, limit - 13), r"[ .]+\z", "")
    joined = based.withColumn("low", F.lower("base")).join(owners, "low")
    name = F.when(F.col("owner") == F.col("record_id"), F.concat("base", F.lit(".pdf"))).otherwise(
        F.concat(shorter, F.lit(" ("), "record_id", F.lit(").pdf")))
    return joined.select("record_id", name.alias("file_name"))


# --- who reads what ----------------------------------------------------------------------------

def assign_pairs(records: DataFrame, bucket: Column, pairs=fixed.REVIEWER_PAIRS) -> DataFrame:
    """Adds pair, reviewers and extractor: ids in order go round the pairs, and inside a pair
    the two reviewers take turns as extractor. Group sizes differ by at most one and the
    order of the input does not matter. `bucket` must rise with the id (see global_rank).
    """
    ranked = global_rank(records, "record_id", bucket)
    n = len(pairs)
    options = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    pair = F.get(options, (F.col("rank") % n).cast("int"))
    turn = F.floor(F.col("rank") / n) % 2
    return ranked.withColumn("reviewer_a", pair["a"]).withColumn("reviewer_b", pair["b"]).withColumn(
        "pair", F.concat("reviewer_a", F.lit("×"), "reviewer_b")).withColumn(
        "extractor", F.when(turn == 0, F.col("reviewer_a")).otherwise(F.col("reviewer_b"))).drop("rank")


def build_assignment(records: DataFrame, cache: DataFrame, groups) -> DataFrame:
    """One row per record key with everything a screening sheet shows.

    `records` has (ord, source, title, abstract, doi, venue, year, rank); the first row of
    a key counts. Abstracts missing from the record come from the cache.
    """
    keyed = records.withColumn("key", ids.record_key(F.col("doi"), F.col("title")))
    columns = ["ord", "source", "title", "abstract", "doi", "venue", "year", "rank"]
    firsts = first_per_key(keyed, ["key"], F.col("ord"), columns).withColumn("doi", ids.norm_doi(F.col("doi")))
    enriched = enrich_abstracts(firsts, cache)
    key = F.col("key")
    calibration = ids.is_calibration(key)
    return enriched.select(
        ids.record_id(key).alias("record_id"), (ids.block_of(key) + 1).alias("block"),
        F.when(calibration, "Y").otherwise("N").alias("calibration"),
        F.lit(fixed.LEAD_REVIEWER).alias("reviewer_a"),
        F.when(calibration, "all").otherwise(ids.second_reviewer(key)).alias("reviewer_b"),
        "key", strip(F.col("title")).alias("title"), "abstract", "abstract_source", "doi", "source", "venue", "year", "rank",
        screening.group_count(F.col("title"), F.col("abstract"), groups).cast("bigint").alias("kw_groups"),
        F.when(F.col("abstract") != "", "Y").otherwise("N").alias("has_abstract"),
    )


def first_sheets(assignment: DataFrame) -> DataFrame:
    """Adds `reviewer`: the lead reads everything, the others the calibration set."""
    everyone = F.array(*[F.lit(r) for r in fixed.REVIEWERS])
    readers = F.when(F.col("calibration") == "Y", everyone).otherwise(F.array(F.lit(fixed.LEAD_REVIEWER)))
    return assignment.withColumn("reviewer", F.explode(readers))


def reading_order(sheet: DataFrame) -> DataFrame:
    """Most concept groups first, then the newest, then by id."""
    year = F.coalesce(try_number(F.col("year"), "int"), F.lit(0))
    return sheet.orderBy("reviewer", F.desc("kw_groups"), F.desc(year), "record_id")


def second_sheets(assignment: DataFrame, lead: DataFrame) -> DataFrame:
    """(reviewer, record_id, ...) for what the lead excluded or left unsure outside calibration.

    While the lead has blanks the sheet stays empty. The lead's decisions are not shown.
    """
    decision = F.lower(strip(F.col("decision")))
    blanks = lead.agg(F.count_if(decision == "").alias("n"))
    judged = lead.select("record_id", decision.alias("d"))
    rows = assignment.where("calibration <> 'Y'").join(judged, "record_id").where("d <> 'include'")
    return rows.where(blanks.scalar() == 0).withColumn("reviewer", ids.second_reviewer(F.col("key"))).drop("d")


def calibration_supplement(assignment: DataFrame, delivered: DataFrame, sheet: DataFrame | None = None,
                           reviewers: list[str] = fixed.SECOND_REVIEWERS) -> DataFrame:
    """(reviewer, record_id): calibration records that a reviewer's sheet does not have yet.

    With `sheet`, the full sheet (record_id, ...), the rows are taken from it; the job fails when
    it lacks a wanted record, rather than hand out an incomplete supplement.
    """
    wanted = assignment.where("calibration = 'Y'").withColumn(
        "reviewer", F.explode(F.array(*[F.lit(r) for r in reviewers])))
    added = wanted.join(delivered.select("reviewer", "record_id"), ["reviewer", "record_id"], "left_anti")
    if sheet is None:
        return added
    rows = sheet.select("record_id", F.struct(*[F.col(c) for c in sheet.columns if c != "record_id"], F.lit(True).alias("there")).alias("row"))
    missing = F.raise_error(F.concat(F.lit("not in the full sheet: "), F.col("record_id"))).cast("string")
    found = added.select("reviewer", "record_id").join(rows, "record_id", "left").withColumn(
        "record_id", F.when(F.col("row").isNotNull(), F.col("record_id")).otherwise(missing))
    return found.select("reviewer", "record_id", "row.*").drop("there")


def consensus_order(votes: DataFrame) -> DataFrame:
    """(record_id, n_distinct, place): records by how many different votes they got, most first,
    then by id. `votes` has (record_id, decision), a bounded number of votes a record."""
    counted = votes.groupBy("record_id").agg(F.count_distinct("decision").alias("n_distinct"))
    keyed = counted.withColumn("_order", F.concat(F.lpad((999 - F.col("n_distinct")).cast("string"), 3, "0"), "record_id"))
    ranked = global_rank(keyed, "_order", F.substring("_order", 1, 6))
    return ranked.select("record_id", "n_distinct", (F.col("rank") + 1).alias("place"))


def workload(assignment: DataFrame, by: list[str]) -> DataFrame:
    """Records per reviewer and other columns; a record counts for each of its reviewers."""
    readers = F.array("reviewer_a", "reviewer_b")
    return assignment.withColumn("reviewer", F.explode(readers)).groupBy("reviewer", *by).agg(F.count("*").alias("n"))


def fingerprints(sheet: DataFrame, group: list[str], order: str) -> DataFrame:
    """`count:hash` of a sheet's ids in order, the hash being seven characters of SHA-1.

    The ids of a sheet, one a line, are read as a sorted stream and digested on the way: nothing
    is collected, so a sheet may have any number of ids.
    """
    rows = sheet.select(*group, F.col(order).alias("_order"), F.col("record_id").cast("string").alias("_id"))
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "_order", "_id").drop("_order")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n, begun, kinds = None, None, 0, False, None
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [*group, "fingerprint"])

        for batch in batches:
            kinds = [*[batch.schema.field(k).type for k in range(len(group))], pa.string()]
            for *key, one in zip(*(c.to_pylist() for c in batch.columns)):
                if sha is None or key != now:
                    if sha is not None:
                        out.append((*now, f"{n}:{sha.hexdigest()[:7]}"))
                    now, sha, n, begun = key, hashlib.sha1(), 0, False
                n += 1
                if one is not None:
                    sha.update((("\n" if begun else "") + one).encode("utf-8"))
                    begun = True
            if len(out) >= 1000:
                yield batch_of()
        if sha is not None:
            out.append((*now, f"{n}:{sha.hexdigest()[:7]}"))
            yield batch_of()

    shape = T.StructType([sheet.schema[g] for g in group] + [T.StructField("fingerprint", T.StringType())])
    return ordered.mapInArrow(digest, shape)


def contamination(examples: DataFrame, targets: DataFrame, key: str = "record_id") -> DataFrame:
    """Example records that are also targets; must be empty."""
    return examples.join(targets.select(key).distinct(), key, "left_semi")


def union_branches(database: DataFrame, citation: DataFrame) -> DataFrame:
    """Both branches under one schema; columns one lacks are blank there."""
    both = database.withColumn("branch", F.lit("database")).unionByName(
        citation.withColumn("branch", F.lit("snowballing")), allowMissingColumns=True)
    return both.na.fill("")


def stage_attribution(records: DataFrame, memberships: list[tuple[DataFrame, Column, str]]) -> DataFrame:
    """Adds `stage` and `note`: the first membership table that has the record names its stage.

    A membership is (table keyed by ord, note column, stage name).
    """
    rows, stages, notes = records, [], []
    for place, (table, note, name) in enumerate(memberships):
        flagged = table.select("ord", note.alias(f"_n{place}"), F.lit(True).alias(f"_m{place}"))
        rows = rows.join(flagged, "ord", "left")
        stages.append(F.when(F.col(f"_m{place}"), F.lit(name)))
        notes.append(F.when(F.col(f"_m{place}"), F.coalesce(F.col(f"_n{place}"), F.lit(""))))
    marks = [f"_{k}{i}" for i in range(len(memberships)) for k in "mn"]
    return rows.withColumn("stage", F.coalesce(*stages, F.lit("?"))).withColumn(
        "note", F.coalesce(*notes, F.lit(""))).drop(*marks)
