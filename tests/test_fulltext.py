"""Full-text progress: what is written into a sheet, and what is refused."""

import json

from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.operators import decisions

YES = {k: "Y" for k in fixed.CRITERIA}
FIELDS = [*fixed.CRITERIA, "reason", "evidence", "memo", *fixed.EXTRACTION]
ENTRIES = {
    "R1": {"c": YES, "reason": "", "evidence": "", "memo": "", "ext": {
        "n_total": "24", "population": "students", "scale_target": ["身体全体", "IPD"], "main_finding": "x", "action_contingent": "N"}},
    "R2": {"c": {**YES, "O": "N"}, "reason": "", "evidence": 'p.4 "no measure"', "memo": "", "ext": {}},
    "R3": {"c": {**YES, "S": "N"}, "reason": "S: 原著論文でない", "evidence": "p.1 review", "memo": "", "ext": {}},
    "R4": {"c": {**YES, "C": "N"}, "reason": fixed.REASON_OTHER, "evidence": "p.2", "memo": "", "ext": {}},
}


def progress(entries, **other):
    return json.dumps({"format": "phase4-progress", "version": 1, "sheet": "r1", "entries": entries} | other)


def run(spark, text, old=None, force=False):
    sheet = spark.createDataFrame([(r, *[(old or {}).get((r, f), "") for f in FIELDS]) for r in ENTRIES], ["record_id", *FIELDS])
    cells, errors = decisions.parse_fulltext(spark.createDataFrame([("f", text)], "file string, json string"), F.lit("r1"))
    table, findings = decisions.upsert_cells(sheet, cells, errors, force)
    rows = {r.record_id: r for r in table.collect()}
    return rows, sorted(r.rule for r in errors.collect()), sorted(tuple(r) for r in findings.collect())


def test_cells_are_written(spark):
    rows, errors, findings = run(spark, progress(ENTRIES))
    assert errors == [] and findings == []
    assert rows["R1"].n_total == "24" and rows["R1"].scale_target == "身体全体; IPD" and rows["R1"].action_contingent == "N"
    assert rows["R2"].evidence == 'p.4 "no measure"' and rows["R2"].reason == ""
    assert rows["R3"].reason == "S: 原著論文でない"
    assert rows["R4"].reason == "", "the automatic reason is not a value"


def test_refusals(spark):
    untouched = {r: [""] * len(FIELDS) for r in ENTRIES}
    for text, wanted in (
        (progress(ENTRIES, sheet="r2"), ["owner"]), (progress(ENTRIES, format="x"), ["format"]), (progress(ENTRIES, version=2), ["version"]),
        (progress({"R1": {"c": {"P": "X"}, "ext": {}}}), ["answer"]), (progress({"R1": {"c": YES, "reason": "because"}}), ["unknown reason"]),
        (progress({"R1": {"c": YES, "ext": {"n_total": "few"}}}), ["not a number"]), (progress({"R1": {"c": YES, "ext": {"colour": "red"}}}), ["unknown column"]),
        (progress({"R1": {"c": YES, "ext": {"scale_target": "IPD; moon", "social_context": "crowd"}}}), ["not in vocabulary"] * 2),
    ):
        rows, errors, _ = run(spark, text)
        assert errors == wanted, text
        assert {k: list(r)[1:] for k, r in rows.items()} == untouched, text
    rows, errors, findings = run(spark, progress({**ENTRIES, "R9": {"c": YES}}))
    assert errors == [] and findings == [("error", "R9", "", "foreign record")] and rows["R1"].n_total == ""


def test_conflicts_need_force(spark):
    old = {("R1", "P"): "N", ("R2", "evidence"): ' p.4 "no measure" ', ("R2", "reason"): "重複(同一研究の別報告)", ("R3", "memo"): "kept?"}
    conflicts = [("conflict", "R1", "P", "other value there"), ("conflict", "R3", "memo", "other value there"), ("warning", "R2", "reason", "reason kept")]
    rows, errors, findings = run(spark, progress(ENTRIES), old)
    assert errors == [] and findings == conflicts and rows["R1"].P == "N" and rows["R1"].n_total == ""
    rows, _, findings = run(spark, progress(ENTRIES), old, force=True)
    assert findings == conflicts and rows["R1"].P == "Y" and rows["R1"].n_total == "24" and rows["R3"].memo == ""
    assert rows["R2"].reason == "重複(同一研究の別報告)"


def test_reviewers_rows_are_joined_in_all_partitions(spark):
    """Answers pack to almost nothing; tasks are not sized by their bytes (F11, F12, F13, F15)."""
    ids = spark.range(2000).select(F.concat(F.lit("R"), "id").alias("record_id"))
    assignment = ids.select("record_id", F.lit("r1").alias("reviewer_a"), F.lit("r2").alias("reviewer_b"), F.lit("p").alias("pair"),
                            F.lit("Y").alias("distributed"))
    sheet = ids.select("record_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("reviewer"), F.lit("Include").alias("decision"),
                       F.lit("").alias("reason"))
    worklist = ids.limit(0).select("record_id", *[F.lit("").alias(c) for c in ("final_decision", "final_reason", "consensus_note")])
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = decisions.paired_rows(assignment, sheet, ["decision", "reason"])
    final = decisions.fulltext_final(assignment, sheet, worklist)
    assert pairs.count() == 2000 and pairs.rdd.getNumPartitions() == wanted
    assert final.where("final_decision = 'Include'").count() == 2000 and final.rdd.getNumPartitions() == wanted


def test_reviewers_rows_are_not_broadcast(spark):
    """By their packed bytes millions of answers look small; none of these joins unpacks them in the driver (F2)."""
    ids = spark.range(500).select(F.concat(F.lit("R"), "id").alias("record_id"))
    assignment = ids.select("record_id", F.lit("r1").alias("reviewer_a"), F.lit("r2").alias("reviewer_b"), F.lit("p").alias("pair"),
                            F.lit("Y").alias("distributed"), F.lit("r1").alias("extractor"), F.lit("t").alias("title"))
    sheet = ids.select("record_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("reviewer"), F.lit("Include").alias("decision"),
                       F.lit("").alias("reason"), *[F.lit("").alias(c) for c in fixed.EXTRACTION])
    worklist = ids.limit(0).select("record_id", *[F.lit("").alias(c) for c in ("final_decision", "final_reason", "consensus_note")])
    final = decisions.fulltext_final(assignment, sheet, worklist)
    table = decisions.extraction_table(final, assignment, sheet)
    assert table.count() == 500
    for rows in (final, table):
        rows.collect()
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
