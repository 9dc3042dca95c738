"""Reviewers' decisions: merging sheets, checking, reconciling, and updating tables.

A sheet is a long table with a `reviewer` column; checks are tables of violations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import identifiers as ids
from sievelake.functions import labels
from sievelake.functions.text import split_multi, strip
from sievelake.session import cut, not_broadcast, spread_work

VOCABULARY_KINDS = ("vocab", "multi", "ynq")


def merge_sheets(sheets: DataFrame, keys: list[str] = ["reviewer", "record_id"]) -> DataFrame:
    """One row per reviewer and record; the lowest `priority` wins, `copies` counts all."""
    others = [c for c in sheets.columns if c not in [*keys, "priority"]]
    merged = sheets.groupBy(*keys).agg(
        F.min_by(F.struct(*others), "priority").alias("r"), F.count("*").alias("copies"))
    return merged.select(*keys, "r.*", "copies")


def expected_rows(assignment: DataFrame) -> DataFrame:
    """(reviewer, record_id) that stage one asks for."""
    everyone = F.array(*[F.lit(r) for r in fixed.REVIEWERS])
    who = F.when(F.col("calibration") == "Y", everyone).otherwise(F.array(F.lit(fixed.LEAD_REVIEWER)))
    return assignment.select(F.explode(who).alias("reviewer"), "record_id")


def check_decisions(assignment: DataFrame, sheet: DataFrame, reasons: list[str] = fixed.EXCLUDE_REASONS,
                    other: str = fixed.REASON_OTHER) -> DataFrame:
    """(rule, reviewer, record_id) for every row that breaks a rule of the first stage."""
    wanted = expected_rows(assignment)
    keys = ["reviewer", "record_id"]
    given, raw = labels.canonical_decision(F.col("decision")), strip(F.col("decision"))
    reason, note = strip(F.col("reason")), strip(F.col("note"))
    excluded = given == "Exclude"
    rules = F.array_compact(F.array(
        F.when((raw != "") & (given == ""), F.lit("bad decision")),
        F.when(excluded & (reason == ""), F.lit("no reason")),
        F.when(excluded & (reason != "") & ~reason.isin(*reasons), F.lit("unknown reason")),
        F.when(excluded & (reason == other) & (note == ""), F.lit("other without note")),
    ))
    content = sheet.select("reviewer", "record_id", F.explode(rules).alias("rule"))
    foreign = sheet.select(*keys).join(wanted, keys, "left_anti").withColumn("rule", F.lit("foreign record"))
    missing = wanted.join(sheet.select(*keys), keys, "left_anti").withColumn("rule", F.lit("missing record"))
    return content.unionByName(foreign).unionByName(missing).select("rule", *keys)


def progress(assignment: DataFrame, sheet: DataFrame) -> DataFrame:
    """(reviewer, expected, done, blank, percent); a missing row is not done."""
    keys = ["reviewer", "record_id"]
    wanted = expected_rows(assignment).withColumn("_w", F.lit(True))
    valid = labels.canonical_decision(F.col("decision")) != ""
    rows = sheet.select(*keys, valid.alias("valid"), (strip(F.col("decision")) == "").alias("blank"))
    joined = wanted.join(rows, keys, "full").join(
        assignment.select("record_id", F.lit(True).alias("_a")), "record_id", "left")
    done = F.count_if(F.col("valid") & F.col("_a"))
    return joined.groupBy("reviewer").agg(
        F.count_if("_w").alias("expected"), done.alias("done"), F.count_if("blank").alias("blank")
    ).withColumn("percent", F.round(F.col("done") * 100 / F.nullif("expected", F.lit(0)), 1))


def consensus_list(assignment: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of decisions with `status` agreed or open.

    Outside calibration an Include of the lead passes alone. Otherwise the lead is compared
    with the second reviewer of the record's hash: on calibration rows by the first sheets,
    elsewhere by the second ones. Equal decisions other than Unsure are agreed.
    """
    calibration = F.col("calibration") == "Y"
    base = assignment.withColumn("second", ids.second_reviewer(F.col("key")))
    pick = lambda d, who, tag: d.select(
        F.col("reviewer").alias(who), "record_id",
        labels.canonical_decision(F.col("decision")).alias(f"{tag}_decision"),
        F.coalesce("reason", F.lit("")).alias(f"{tag}_reason"))
    lead = pick(first.where(F.col("reviewer") == fixed.LEAD_REVIEWER), "lead", "a").drop("lead")
    joined = (
        base.join(lead, "record_id")
        .join(pick(first, "second", "s1"), ["second", "record_id"], "left")
        .join(pick(second, "second", "s2"), ["second", "record_id"], "left")
        .withColumn("b_decision", F.coalesce(F.when(calibration, F.col("s1_decision")).otherwise(F.col("s2_decision")), F.lit("")))
        .withColumn("b_reason", F.when(calibration, F.col("s1_reason")).otherwise(F.col("s2_reason")))
    )
    alone = ~calibration & (F.col("a_decision") == "Include")
    both = (F.col("a_decision") != "") & (F.col("b_decision") != "")
    agreed = alone | (both & (F.col("a_decision") == F.col("b_decision")) & (F.col("a_decision") != "Unsure"))
    dash = F.lit("—")
    return joined.where(alone | both).select(
        "record_id", "block", "title", "doi", F.lit(fixed.LEAD_REVIEWER).alias("reviewer_a"),
        F.col("a_decision").alias("decision_a"), F.col("a_reason").alias("reason_a"),
        F.when(alone, dash).otherwise(F.col("second")).alias("reviewer_b"),
        F.when(alone, dash).otherwise(F.col("b_decision")).alias("decision_b"),
        F.when(alone, "").otherwise(F.coalesce("b_reason", F.lit(""))).alias("reason_b"),
        F.when(agreed, F.col("a_decision")).otherwise("").alias("final_decision"),
        F.when(alone, "liberal accelerated: 1名の Include で通過").when(agreed, "両者一致(協議不要)").otherwise("").alias("consensus_note"),
        F.when(agreed, "agreed").otherwise("open").alias("status"),
    )


def carry_forward(worklist: DataFrame, previous: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """Keeps what was already entered when a worklist is rebuilt: if any of the fields was
    filled in before, all of them are taken over."""
    old = previous.select(key, *[strip(F.col(f)).alias(f"_{f}") for f in fields])
    filled = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_{f}") != "", F.lit(False)) for f in fields])
    joined = worklist.join(old, key, "left").withColumn("_filled", filled)
    return joined.select(*[
        F.when(F.col("_filled"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in worklist.columns])


def final_decisions(worklist: DataFrame) -> DataFrame:
    """All decisions in canonical case, or no row at all while one is unresolved."""
    final = labels.canonical_decision(F.col("final_decision"))
    unresolved = worklist.agg(F.count_if(final == "").alias("n"))
    return worklist.where(unresolved.scalar() == 0).withColumn("final_decision", final)


# --- full text ---------------------------------------------------------------------------------

def with_decision(sheet: DataFrame) -> DataFrame:
    """Adds `decision` from the six criteria, and the automatic reason where none was given."""
    answers = {k: F.coalesce(F.col(k), F.lit("")) for k in fixed.CRITERIA}
    decided = sheet.withColumn("decision", labels.expected_decision(list(answers.values())))
    reason = F.coalesce("reason", F.lit(""))
    return decided.withColumn("reason", F.when(
        (F.col("decision") == "Exclude") & (reason == ""), labels.auto_reason(answers)).otherwise(reason))


def check_fulltext(sheet: DataFrame, assignment: DataFrame, extraction=fixed.EXTRACTION,
                   reasons: list[str] = fixed.EXCLUDE_REASONS, other: str = fixed.REASON_OTHER) -> DataFrame:
    """(severity, rule, field, reviewer, record_id): errors break a value, warnings miss one.

    `sheet` has the criteria, decision, reason, evidence, memo and the extraction columns.
    """
    rows = sheet.join(assignment.select("record_id", F.col("extractor").alias("_extractor")), "record_id", "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = F.col("_extractor").isNotNull()
    d, reason = F.col("decision"), value("reason")

    def issue(condition: Column, severity: str, rule: str, field: str = "") -> Column:
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(field).alias("field")))

    checks = [issue(~known, "error", "foreign record")]
    checks += [issue(known & (value(k) != "") & ~value(k).isin(*fixed.CRITERION_ANSWERS), "error", "answer", k) for k in fixed.CRITERIA]
    decided = known & (d != "")
    checks += [
        issue(known & (reason != "") & ~reason.isin(*reasons), "error", "unknown reason"),
        issue(known & (d == ""), "warning", "criteria left blank"),
        issue(decided & (d == "Exclude") & (reason == ""), "error", "no reason"),
        issue(decided & (d == "Exclude") & (value("evidence") == ""), "error", "no evidence"),
        issue(decided & (d != "Exclude") & (reason != ""), "warning", "reason without exclusion"),
        issue(decided & (reason == other) & (value("C") != "N") & (value("memo") == ""), "error", "other without memo"),
    ]
    mine = decided & (F.col("_extractor") == F.col("reviewer")) & d.isin("Include", "Unsure")
    for name, (required, kind, allowed) in extraction.items():
        if required:
            checks.append(issue(mine & (value(name) == ""), "warning", "extraction left blank", name))
        if name == "n_total":
            number = F.replace(value(name), F.lit(".0"), F.lit("")).rlike(r"^\d+\z")
            checks.append(issue(mine & (value(name) != "") & ~number & ~value(name).isin(*fixed.MISSING_TOKENS), "error", "not a number", name))
        if kind in VOCABULARY_KINDS:
            tokens = split_multi(F.col(name)) if kind == "multi" else F.array(value(name))
            known_tokens = F.array(*[F.lit(v) for v in allowed])
            bad = F.size(F.array_except(tokens, known_tokens)) > 0
            checks.append(issue(mine & (value(name) != "") & bad, "error", "not in vocabulary", name))
    filled = reduce(lambda a, b: a | b, [value(n) != "" for n in extraction])
    checks.append(issue(decided & (F.col("_extractor") != F.col("reviewer")) & filled, "warning", "extraction by the other reviewer"))
    found = rows.select("reviewer", "record_id", F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return found.select("i.severity", "i.rule", "i.field", "reviewer", "record_id")


def paired_rows(assignment: DataFrame, sheet: DataFrame, fields: list[str]) -> DataFrame:
    """Assignment rows with both reviewers' fields as a_<field> and b_<field>; only decided ones."""
    side = lambda tag: sheet.where("decision <> ''").select(
        F.col("reviewer").alias(f"reviewer_{tag}"), "record_id",
        *[F.coalesce(F.col(f), F.lit("")).alias(f"{tag}_{f}") for f in fields])
    return beside(beside(assignment, side("a"), "a"), side("b"), "b")


def beside(rows: DataFrame, side: DataFrame, tag: str, how: str = "inner") -> DataFrame:
    """Rows joined to one reviewer's fields, in as many tasks as the session has partitions.

    Sheets repeat the same few answers and pack to almost nothing, so partitions sized by
    their bytes would be few tasks with very many rows, or broadcast. Records are dealt by their
    id alone, and the reviewer is compared in two halves, so that this is the join's only key.
    """
    key = f"reviewer_{tag}"
    own = side.withColumnRenamed("record_id", "_of").withColumnRenamed(key, "_by")
    same = (F.col("record_id") == F.col("_of")) & (F.col(key) >= F.col("_by")) & (F.col(key) <= F.col("_by"))
    joined = spread_work(rows, "record_id").join(not_broadcast(own), same, how)
    return joined.select(key, "record_id", *[c for c in joined.columns if c not in (key, "record_id", "_of", "_by")])


def fulltext_worklist(pairs: DataFrame) -> DataFrame:
    """Rows to discuss, with the causes and the criteria that differ."""
    differs = F.col("a_decision") != F.col("b_decision")
    unsure = (F.col("a_decision") == "Unsure") | (F.col("b_decision") == "Unsure")
    open_criteria = F.array_compact(F.array(*[
        F.when((F.col(f"a_{k}") == "?") | (F.col(f"b_{k}") == "?"), F.lit(k)) for k in fixed.CRITERIA]))
    other_criteria = F.array_compact(F.array(*[
        F.when(F.col(f"a_{k}").isin("Y", "N") & F.col(f"b_{k}").isin("Y", "N") & (F.col(f"a_{k}") != F.col(f"b_{k}")), F.lit(k))
        for k in fixed.CRITERIA]))
    why = F.array_compact(F.array(
        F.when(differs, F.lit("判定が不一致")), F.when(unsure, F.lit("Unsure")),
        F.when(F.size(open_criteria) > 0, F.concat(F.lit("基準が ?: "), F.array_join(open_criteria, ",")))))
    answers = lambda tag: F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(f"{tag}_{k}")) for k in fixed.CRITERIA])
    return pairs.withColumn("_why", why).where(F.size("_why") > 0).select(
        "record_id", "pair", F.array_join("_why", " / ").alias("why"),
        F.array_join(other_criteria, ",").alias("criteria_disagree"), "title",
        *[c for tag in ("a", "b") for c in (
            F.col(f"reviewer_{tag}").alias(f"{tag}_reviewer"), F.col(f"{tag}_decision"), answers(tag).alias(f"{tag}_criteria"),
            F.col(f"{tag}_reason"), F.col(f"{tag}_evidence"), F.col(f"{tag}_memo"))],
        *[F.lit("").alias(c) for c in ("final_decision", "final_reason", "consensus_note", "third_reviewer_vote")])


def fulltext_final(assignment: DataFrame, sheet: DataFrame, worklist: DataFrame,
                   priority: list[str] = fixed.REASON_PRIORITY) -> DataFrame:
    """Final decisions and, in `problem`, why a record has none or lacks a reason.

    Agreed decisions stand unless the worklist says otherwise. When reasons differ the one
    higher in the priority list is kept.
    """
    side = lambda tag: sheet.select(
        F.col("reviewer").alias(f"reviewer_{tag}"), "record_id", F.col("decision").alias(f"{tag}_decision"),
        F.col("reason").alias(f"{tag}_reason"))
    agreed_list = worklist.select("record_id", strip(F.col("final_decision")).alias("w_decision"),
                                  strip(F.col("final_reason")).alias("w_reason"), F.col("consensus_note").alias("w_note"))
    rows = beside(beside(assignment, side("a"), "a", "left"), side("b"), "b", "left")
    rows = spread_work(rows, "record_id").join(not_broadcast(agreed_list), "record_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    da, db, w = text("a_decision"), text("b_decision"), text("w_decision")
    agreed = (da == db) & da.isin("Include", "Exclude") & (w == "")
    final = F.when(agreed, da).otherwise(w)
    places = F.array(*[F.lit(r) for r in priority])
    ranks = F.array_sort(F.filter(F.array(F.array_position(places, text("a_reason")), F.array_position(places, text("b_reason"))),
                                  lambda p: p > 0))
    own = F.coalesce(F.when(F.size(ranks) > 0, F.get(places, (F.get(ranks, F.lit(0)) - 1).cast("int"))), F.lit(""))
    reason = F.when(final == "Exclude", F.when(text("w_reason") != "", text("w_reason")).otherwise(own)).otherwise("")
    split = (final == "Exclude") & (text("w_reason") == "") & (F.size(F.array_distinct(ranks)) > 1)
    problem = (
        F.when(F.col("distributed") != "Y", "not distributed")
        .when((da == "") | (db == ""), "decisions incomplete")
        .when(~final.isin("Include", "Exclude"), "no consensus decision")
        .when((final == "Exclude") & (reason == ""), "no reason").otherwise("")
    )
    decided = problem.isin("", "no reason")
    return rows.select(
        "record_id", "pair", F.when(decided, F.when(agreed, "一致").otherwise("協議")).alias("decided_by"),
        F.when(decided, final).alias("final_decision"), F.when(decided, reason).alias("final_reason"),
        F.when(decided, F.when(split, "(理由が割れたので優先順位で採用)").otherwise("")).alias("reason_note"),
        F.col("a_decision"), F.col("b_decision"), F.when(decided, text("w_note")).alias("consensus_note"), problem.alias("problem"))


def extraction_table(final: DataFrame, assignment: DataFrame, sheet: DataFrame, extraction=fixed.EXTRACTION) -> DataFrame:
    """Included records with the assigned extractor's columns, and how many required ones are blank."""
    kept = final.where("final_decision = 'Include'").select("record_id")
    rows = spread_work(assignment, "record_id").join(not_broadcast(kept), "record_id", "left_semi").select("record_id", "extractor", "title")
    rows = spread_work(rows, "extractor", "record_id").join(
        not_broadcast(sheet.select(F.col("reviewer").alias("extractor"), "record_id", *extraction)), ["extractor", "record_id"], "left")
    filled = rows.select("record_id", "extractor", "title", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in extraction])
    required = [c for c, (need, _, _) in extraction.items() if need]
    blank = sum(((F.col(c) == "").cast("int") for c in required), F.lit(0))
    return filled.withColumn("blank_required", blank.cast("bigint"))


def boundary_examples(worklist: DataFrame, reason: str) -> DataFrame:
    """Discussed rows in which either reviewer gave the reason."""
    return worklist.where((strip(F.col("reason_a")) == reason) | (strip(F.col("reason_b")) == reason))


def rescreen_targets(traced: DataFrame, sheet: DataFrame, final: DataFrame, second: DataFrame) -> DataFrame:
    """Earlier exclusions with term hits, and what was decided about them before."""
    rows = traced.where(F.col("stage").startswith("P3b")).select("record_id", "terms")
    told = F.concat(F.lit("最終 "), "final_decision", F.lit("(協議リスト: "), "reviewer_a", F.lit("="), "decision_a", F.lit(" "),
                    "reason_a", F.lit(" / "), "reviewer_b", F.lit("="), "decision_b", F.lit(" "), "reason_b", F.lit(")"))
    before = final.select("record_id", told.alias("told"))
    other = second.select("record_id", F.col("reviewer").alias("stage2_reviewer"), F.col("decision").alias("stage2_decision"),
                          F.col("reason").alias("stage2_reason"))
    joined = rows.join(sheet.select("record_id", "title", "doi"), "record_id").join(before, "record_id", "left").join(
        other, "record_id", "left")
    outside = "協議リスト外(stage 1 の著者と stage 2 の第 2 評価者がともに Exclude)"
    return joined.withColumn("p3b_previous", F.coalesce("told", F.lit(outside))).drop("told").na.fill(
        "", ["stage2_reviewer", "stage2_decision", "stage2_reason"])


def provisional_status(assignment: DataFrame, final: DataFrame, topics: DataFrame, open_topics: list[str]) -> DataFrame:
    """(record_id, status): the decision, `hold: <topic>` while a topic is open, or not distributed."""
    tagged = topics.where(F.col("topic").isin(*open_topics)).groupBy("record_id").agg(F.min("topic").alias("topic"))
    joined = assignment.join(final.select("record_id", "final_decision"), "record_id", "left").join(tagged, "record_id", "left")
    status = (
        F.when(F.col("distributed") != "Y", "not distributed")
        .when(F.col("topic").isNotNull(), F.concat(F.lit("hold: "), "topic"))
        .when(F.col("final_decision").isNotNull(), F.col("final_decision")).otherwise("open")
    )
    return joined.select("record_id", status.alias("status"))


# --- importing progress and updating tables -----------------------------------------------------

PROGRESS_SCHEMA = (
    "format string, version int, sheet string, saved_at string, fingerprint string, "
    "counts struct<done: int>, "
    "decisions map<string, struct<decision: string, reason: string, note: string>>"
)


def parse_progress(files: DataFrame, sheet_id: Column, kind: str = "phase3b-progress",
                   newest_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of progress files (file, json).

    A file of another format, version or owner gives a violation and no rows; a count that
    differs from the number of decisions is a warning only.
    """
    parsed = cut(files.withColumn("sheet_id", sheet_id).withColumn("p", F.from_json("json", PROGRESS_SCHEMA)))
    p = F.col("p")
    rules = F.array_compact(F.array(
        F.when(F.coalesce(p["format"], F.lit("")) != kind, F.lit("error: format")),
        F.when(F.coalesce(p["version"], F.lit(0)) > newest_version, F.lit("error: version")),
        F.when(F.coalesce(p["sheet"], F.lit("")) != F.col("sheet_id"), F.lit("error: owner")),
        F.when(p["decisions"].isNull(), F.lit("error: no decisions")),
        F.when(p["counts"]["done"] != F.size(p["decisions"]), F.lit("warning: count")),
    ))
    judged = parsed.withColumn("rules", rules)
    violations = judged.select("file", F.explode("rules").alias("rule"))
    clean = judged.where(~F.exists("rules", lambda r: r.startswith("error")))
    rows = clean.select("file", F.col("p.sheet").alias("reviewer"), F.explode("p.decisions").alias("record_id", "d"))
    blank = lambda f: F.coalesce(F.col(f"d.{f}"), F.lit("")).alias(f)
    return rows.select("file", "reviewer", "record_id", blank("decision"), blank("reason"), blank("note")), violations


def upsert(current: DataFrame, incoming: DataFrame, force: bool = False,
           reasons: list[str] = fixed.EXCLUDE_REASONS, other: str = fixed.REASON_OTHER) -> tuple[DataFrame, DataFrame]:
    """(table, violations): all incoming decisions are taken over, or none.

    Incoming rows must name known records and valid values; changing a decision that is
    already there needs `force`. With any violation the table comes back unchanged.
    """
    given = incoming.select("record_id", labels.canonical_decision(F.col("decision")).alias("n_decision"),
                            strip(F.col("reason")).alias("n_reason"), strip(F.col("note")).alias("n_note"), F.lit(True).alias("_in"))
    joined = cut(current.withColumn("_cur", F.lit(True)).join(given, "record_id", "full"))
    new, reason, note = F.col("n_decision"), F.col("n_reason"), F.col("n_note")
    excluded = F.col("_in") & (new == "Exclude")
    old = strip(F.col("decision"))
    rules = F.array_compact(F.array(
        F.when(F.col("_cur").isNull(), F.lit("foreign record")),
        F.when(F.col("_in") & (new == ""), F.lit("bad decision")),
        F.when(excluded & (reason == ""), F.lit("no reason")),
        F.when(excluded & (reason != "") & ~reason.isin(*reasons), F.lit("unknown reason")),
        F.when(excluded & (reason == other) & (note == ""), F.lit("other without note")),
        F.when(F.lit(not force) & F.col("_in") & (old != "") & (new != "") & (old != new), F.lit("conflict")),
    ))
    violations = joined.select("record_id", F.explode(rules).alias("rule"))
    clean = violations.agg(F.count("*").alias("n")).scalar() == 0
    take = F.coalesce(F.col("_in"), F.lit(False)) & clean
    table = joined.where("_cur").select(*[
        F.when(take, new).otherwise(F.col("decision")).alias("decision") if c == "decision"
        else F.when(take, F.when(new == "Exclude", reason).otherwise("")).otherwise(F.col("reason")).alias("reason") if c == "reason"
        else F.when(take & (note != ""), note).otherwise(F.col("note")).alias("note") if c == "note"
        else F.col(c) for c in current.columns])
    return table, violations


FULLTEXT_SCHEMA = (
    "format string, version int, sheet string, saved_at string, fingerprint string, "
    "entries map<string, struct<c: map<string, string>, reason: string, evidence: string, memo: string, ext: map<string, string>>>"
)
CELLS = "array<struct<field: string, value: string, rule: string>>"


def _extraction_cell(name: Column, given: Column, extraction: dict) -> Column:
    """(field, value, rule) of one extraction answer; a list, or text with `;`, for columns of several values."""
    kinds = F.create_map(*[F.lit(x) for k, (_, kind, _) in extraction.items() for x in (k, kind)])
    allowed = F.create_map(*[x for k, (_, _, values) in extraction.items() if values for x in (F.lit(k), F.array(*[F.lit(v) for v in values]))])
    kind, vocabulary, text = kinds[name], allowed[name], strip(given)
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ";"))
    tokens = F.filter(F.transform(parts, strip), lambda x: x != "")
    number = text.rlike(r"^[0-9]+\z") | (text == fixed.MISSING_TOKENS[0])
    rule = (
        F.when(kind.isNull(), "unknown column")
        .when(kind == "multi", F.when(F.size(F.array_except(tokens, vocabulary)) > 0, "not in vocabulary"))
        .when(text == "", F.lit(None))
        .when(kind.isin("vocab", "ynq") & ~F.array_contains(vocabulary, text), "not in vocabulary")
        .when((kind == "int") & ~number, "not a number")
    )
    value = F.when(kind == "multi", F.array_join(tokens, "; ")).otherwise(text)
    return F.struct(name.alias("field"), value.alias("value"), rule.alias("rule"))


def parse_fulltext(files: DataFrame, sheet_id: Column, kind: str = "phase4-progress", newest_version: int = 1,
                   extraction: dict = fixed.EXTRACTION, reasons: list[str] = fixed.EXCLUDE_REASONS) -> tuple[DataFrame, DataFrame]:
    """(cells, violations) of full-text progress files (file, json).

    An entry has the six criteria, a reason, evidence, a memo and extraction answers; each becomes a
    cell (file, reviewer, record_id, field, value). A reason counts only where the criteria exclude
    the record and it is not the one that follows from them; otherwise its cell is blank. A file
    of another format, version or owner gives one violation (file, record_id, field, rule) and no cells.
    """
    parsed = cut(files.withColumn("sheet_id", sheet_id).withColumn("p", F.from_json("json", FULLTEXT_SCHEMA)))
    p = F.col("p")
    refused = (
        F.when(F.coalesce(p["format"], F.lit("")) != kind, "format")
        .when(F.coalesce(p["version"], F.lit(0)) > newest_version, "version")
        .when(F.coalesce(p["sheet"], F.lit("")) != F.col("sheet_id"), "owner")
    )
    judged = parsed.withColumn("refused", refused)
    entries = judged.where("refused IS NULL AND p.entries IS NOT NULL").select("file", F.col("p.sheet").alias("reviewer"), F.explode("p.entries").alias("record_id", "e"))
    blank = lambda c: strip(F.coalesce(c, F.lit("")))
    answers = {k: blank(F.col("e.c")[k]) for k in fixed.CRITERIA}
    reason = blank(F.col("e.reason"))
    own = (labels.expected_decision(list(answers.values())) == "Exclude") & (reason != labels.auto_reason(answers))
    none = F.lit(None).cast("string")
    cell = lambda field, value, rule=none: F.struct(F.lit(field).alias("field"), value.alias("value"), rule.alias("rule"))
    fixed_cells = [cell(k, v, F.when((v != "") & ~v.isin(*fixed.CRITERION_ANSWERS), "answer")) for k, v in answers.items()]
    fixed_cells += [cell("reason", F.when(own, reason).otherwise(""), F.when((reason != "") & ~reason.isin(*reasons), "unknown reason")),
                    cell("evidence", blank(F.col("e.evidence"))), cell("memo", blank(F.col("e.memo")))]
    given = F.coalesce(F.map_entries("e.ext"), F.array().cast("array<struct<key: string, value: string>>"))
    more = F.transform(given, lambda x: _extraction_cell(x["key"], F.coalesce(x["value"], F.lit("")), extraction))
    rows = cut(entries.select("file", "reviewer", "record_id", F.explode(F.concat(F.array(*fixed_cells).cast(CELLS), more.cast(CELLS))).alias("x")).select(
        "file", "reviewer", "record_id", "x.*"))
    violations = judged.where("refused IS NOT NULL").select("file", F.lit("").alias("record_id"), F.lit("").alias("field"), F.col("refused").alias("rule"))
    return rows.where("rule IS NULL").drop("rule"), violations.unionByName(rows.where("rule IS NOT NULL").select("file", "record_id", "field", "rule"))


def upsert_cells(sheet: DataFrame, cells: DataFrame, errors: DataFrame | None = None, force: bool = False,
                 key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(sheet, findings): the cells (record_id, field, value) written into a reviewer's sheet, all or none.

    Findings (severity, record_id, field, rule): a record or column that the sheet does not have is
    an error; a value that differs from one already there is a conflict, which `force` allows.
    With an error, with rows in `errors`, or with a conflict and no force, the sheet comes back
    unchanged. A blank reason leaves the sheet's own alone (a warning), as do blanks for blanks.
    """
    fields = [c for c in sheet.columns if c != key]
    there = sheet.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields])
    now = there.unpivot(key, fields, "field", "old").withColumn("old", strip(F.col("old")))
    joined = cut(cells.select(key, "field", "value").join(now, [key, "field"], "left"))
    known = joined.where("old IS NULL").select(key, "field").join(sheet.select(key, F.lit(True).alias("there")), key, "left")
    strange = known.select(F.lit("error").alias("severity"), key, F.when(F.col("there"), F.col("field")).otherwise("").alias("field"),
                           F.when(F.col("there"), "unknown column").otherwise("foreign record").alias("rule")).distinct()
    kept = (F.col("field") == "reason") & (F.col("value") == "")
    severity = (
        F.when(kept, F.when(F.col("old") != "", "warning"))
        .when((F.col("old") != "") & (F.col("old") != F.col("value")), "conflict")
    )
    rule = F.when(kept, "reason kept").otherwise("other value there")
    differing = joined.where("old IS NOT NULL").select(severity.alias("severity"), key, "field", rule.alias("rule")).where("severity IS NOT NULL")
    findings = cut(strange.unionByName(differing))
    stops = findings.agg(F.count_if((F.col("severity") == "error") | ((F.col("severity") == "conflict") & F.lit(not force))).alias("n")).scalar()
    clean = stops == 0
    if errors is not None:
        clean = clean & (errors.agg(F.count("*").alias("n")).scalar() == 0)
    written = joined.where(F.col("old").isNotNull() & ~kept & ((F.col("value") != "") | (F.col("old") != ""))).where(clean)
    by_record = written.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"))
    table = sheet.join(by_record, key, "left").select(
        *[F.coalesce(F.col("_new")[c], F.col(c).cast("string")).alias(c) if c in fields else F.col(c) for c in sheet.columns])
    return table, findings


def append_marked(table: DataFrame, additions: DataFrame, marker: str) -> DataFrame:
    """Appends rows whose marker the table does not have yet; doing it twice changes nothing."""
    return table.unionByName(additions.join(table.select(marker).distinct(), marker, "left_anti"), allowMissingColumns=True)
