"""Decisions: checking, reconciling, importing; and the text formats records come in."""

from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import identifiers as ids
from sievelake.operators import agreement, decisions, workflow
from sievelake.plans.records import KEYED_SQL, RECORDS_SQL, TOPIC_TERMS, keyed_records, md5_modulo_sql, records, string_sql
from sievelake.plans.registry import query
from sievelake.plans.report_queries import kappa_sql, rounded
from sievelake.plans.text_queries import ANSWERS_SQL, part_answers
from sievelake.sources import readers, sinks
from sievelake.functions import screening
from sievelake.session import cut, not_broadcast, spread_work

P_REASON, OTHER = fixed.EXCLUDE_REASONS[0], fixed.REASON_OTHER
REASON_LIST = ", ".join(string_sql(r) for r in fixed.EXCLUDE_REASONS)

# Stage one: documents are the assignment, labels and text lengths the decisions.
STAGE1_SQL = f"""asg AS (SELECT record_id, any_value(record_key) AS key, min(ord) AS ord FROM keyed GROUP BY record_id),
  assignment AS (SELECT a.record_id, a.key, a.ord, r.title, r.doi, r.n_chars, r.lang, {md5_modulo_sql('a.key', 3)} + 1 AS block,
    CASE WHEN {md5_modulo_sql("'cal:' || a.key", 100)} < 20 THEN 'Y' ELSE 'N' END AS calibration,
    CASE {md5_modulo_sql("'2nd:' || a.key", 2)} WHEN 0 THEN 'r2' ELSE 'r3' END AS second FROM asg a JOIN records r ON r.ord = a.ord),
  first_sheet AS (
    SELECT reviewer, a.record_id, CASE reviewer WHEN 'r1' THEN CASE WHEN n_chars < 700 THEN 'exclude' WHEN n_chars > 5000 THEN 'UNSURE' WHEN n_chars % 50 = 0 THEN 'perhaps' ELSE 'Include' END
        WHEN 'r2' THEN CASE WHEN n_chars < 900 THEN 'Exclude' WHEN lang = 'es' THEN '' ELSE 'include' END
        ELSE CASE WHEN n_chars < 500 THEN 'Exclude' ELSE 'Include' END END AS decision,
      CASE WHEN n_chars % 5 = 0 THEN '' WHEN n_chars % 5 = 1 THEN {string_sql(OTHER)} WHEN n_chars % 5 = 2 THEN 'free text' ELSE {string_sql(P_REASON)} END AS reason,
      CASE WHEN n_chars % 2 = 0 THEN 'a note' ELSE '' END AS note
    FROM assignment a CROSS JOIN (VALUES ('r1'), ('r2'), ('r3')) v(reviewer)
    WHERE reviewer = 'r1' AND n_chars % 40 <> 0 OR reviewer <> 'r1' AND (calibration = 'Y' OR n_chars % 60 = 0)),
  second_sheet AS (SELECT second AS reviewer, record_id, CASE WHEN n_chars < 650 THEN 'Exclude' WHEN n_chars < 680 THEN '' ELSE 'Unsure' END AS decision,
      {string_sql(P_REASON)} AS reason FROM assignment WHERE calibration = 'N'),
  canon AS (SELECT *, CASE WHEN lower(trim(decision)) IN ('include', 'exclude', 'unsure') THEN upper(substr(trim(decision), 1, 1)) || lower(substr(trim(decision), 2)) ELSE '' END AS d FROM first_sheet),
  canon2 AS (SELECT *, trim(decision) AS d FROM second_sheet),
  wanted AS (SELECT 'r1' AS reviewer, record_id FROM assignment UNION ALL SELECT unnest(['r2', 'r3']), record_id FROM assignment WHERE calibration = 'Y')"""
STAGE1 = f"WITH {RECORDS_SQL}, {KEYED_SQL}, {STAGE1_SQL}"


def stage_one(t):
    """(assignment, first sheets, second sheets)."""
    rows = keyed_records(t).groupBy("record_id").agg(
        F.min_by(F.struct("ord", F.col("record_key").alias("key"), "title", "doi", "n_chars", "lang"), "ord").alias("r")
    ).select("record_id", "r.*")
    key, n = F.col("key"), F.col("n_chars")
    assignment = cut(rows.withColumn("block", ids.block_of(key) + 1).withColumn(
        "calibration", F.when(ids.is_calibration(key), "Y").otherwise("N")))
    reviewer = F.col("reviewer")
    one = F.when(n < 700, "exclude").when(n > 5000, "UNSURE").when(n % 50 == 0, "perhaps").otherwise("Include")
    two = F.when(n < 900, "Exclude").when(F.col("lang") == "es", "").otherwise("include")
    three = F.when(n < 500, "Exclude").otherwise("Include")
    spread = assignment.withColumn("reviewer", F.explode(F.array(*[F.lit(r) for r in fixed.REVIEWERS])))
    first = spread.where(
        ((reviewer == "r1") & (n % 40 != 0)) | ((reviewer != "r1") & ((F.col("calibration") == "Y") | (n % 60 == 0)))
    ).select(
        "reviewer", "record_id", F.when(reviewer == "r1", one).when(reviewer == "r2", two).otherwise(three).alias("decision"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, OTHER).when(n % 5 == 2, "free text").otherwise(P_REASON).alias("reason"),
        F.when(n % 2 == 0, "a note").otherwise("").alias("note"))
    second = assignment.where("calibration = 'N'").select(
        ids.second_reviewer(key).alias("reviewer"), "record_id",
        F.when(n < 650, "Exclude").when(n < 680, "").otherwise("Unsure").alias("decision"), F.lit(P_REASON).alias("reason"))
    return assignment, cut(first), cut(second)


@query("decision_violations", f"""{STAGE1}
  SELECT 'bad decision' AS rule, reviewer, record_id FROM canon WHERE trim(decision) <> '' AND d = ''
  UNION ALL SELECT 'no reason', reviewer, record_id FROM canon WHERE d = 'Exclude' AND reason = ''
  UNION ALL SELECT 'unknown reason', reviewer, record_id FROM canon WHERE d = 'Exclude' AND reason <> '' AND reason NOT IN ({REASON_LIST})
  UNION ALL SELECT 'other without note', reviewer, record_id FROM canon WHERE d = 'Exclude' AND reason = {string_sql(OTHER)} AND note = ''
  UNION ALL SELECT 'foreign record', reviewer, record_id FROM canon c WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.reviewer = c.reviewer AND w.record_id = c.record_id)
  UNION ALL SELECT 'missing record', reviewer, record_id FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE w.reviewer = c.reviewer AND w.record_id = c.record_id)""")
def _(t):
    assignment, first, _ = stage_one(t)
    return decisions.check_decisions(assignment, first)


@query("reviewer_progress", f"""{STAGE1}, w AS (SELECT reviewer, count(*) AS expected FROM wanted GROUP BY 1),
  c AS (SELECT reviewer, count(*) FILTER (WHERE d <> '') AS done, count(*) FILTER (WHERE trim(decision) = '') AS blank FROM canon GROUP BY 1)
  SELECT reviewer, expected, done, blank, round(done * 100 / expected, 1) AS percent FROM w JOIN c USING (reviewer)""")
def _(t):
    assignment, first, _ = stage_one(t)
    return decisions.progress(assignment, first)


CONSENSUS_SQL = """lead AS (SELECT record_id, d, reason FROM canon WHERE reviewer = 'r1'),
  j AS (SELECT a.*, l.d AS da, l.reason AS ra, CASE a.calibration WHEN 'Y' THEN coalesce(s1.d, '') ELSE coalesce(s2.d, '') END AS db,
      coalesce(CASE a.calibration WHEN 'Y' THEN s1.reason ELSE s2.reason END, '') AS rb
    FROM assignment a JOIN lead l USING (record_id) LEFT JOIN canon s1 ON s1.record_id = a.record_id AND s1.reviewer = a.second
      LEFT JOIN canon2 s2 ON s2.record_id = a.record_id AND s2.reviewer = a.second),
  f AS (SELECT *, calibration <> 'Y' AND da = 'Include' AS alone, da <> '' AND db <> '' AS both_given FROM j),
  consensus AS (SELECT record_id, block, doi, da AS decision_a, ra AS reason_a, CASE WHEN alone THEN '—' ELSE second END AS reviewer_b,
    CASE WHEN alone THEN '—' ELSE db END AS decision_b, CASE WHEN alone THEN '' ELSE rb END AS reason_b,
    CASE WHEN alone OR (da = db AND da <> 'Unsure') THEN da ELSE '' END AS final_decision,
    CASE WHEN alone OR (da = db AND da <> 'Unsure') THEN 'agreed' ELSE 'open' END AS status FROM f WHERE alone OR both_given)"""


@query("consensus_list", f"{STAGE1}, {CONSENSUS_SQL} SELECT * FROM consensus")
def _(t):
    return decisions.consensus_list(*stage_one(t)).drop("title", "reviewer_a", "consensus_note")


@query("consensus_carried", f"""{STAGE1}, {CONSENSUS_SQL},
  prev AS (SELECT 'R' || substr(md5(record_key), 1, 9) AS record_id, CASE WHEN lang = 'en' THEN 'Include' ELSE '' END AS d, CASE WHEN lang = 'de' THEN 'kept note' ELSE '' END AS n
    FROM (SELECT record_key, min(lang) AS lang FROM keyed GROUP BY record_key))
  SELECT c.record_id, CASE WHEN p.d <> '' OR p.n <> '' THEN p.d ELSE c.final_decision END AS final_decision,
    CASE WHEN p.d <> '' OR p.n <> '' THEN p.n ELSE '' END AS consensus_note FROM consensus c LEFT JOIN prev p USING (record_id) WHERE status = 'open'""")
def _(t):
    worklist = decisions.consensus_list(*stage_one(t)).where("status = 'open'")
    previous = keyed_records(t).groupBy("record_id").agg(F.min("lang").alias("lang")).select(
        "record_id", F.when(F.col("lang") == "en", "Include").otherwise("").alias("final_decision"),
        F.when(F.col("lang") == "de", "kept note").otherwise("").alias("consensus_note"))
    return decisions.carry_forward(worklist, previous, ["final_decision", "consensus_note"]).select(
        "record_id", "final_decision", "consensus_note")


@query("final_decisions", f"""{STAGE1}, {CONSENSUS_SQL} SELECT record_id, CASE WHEN status = 'open' THEN 'Include' ELSE final_decision END AS final_decision, 'all settled' AS round FROM consensus
  UNION ALL SELECT record_id, final_decision, 'one open' FROM consensus WHERE (SELECT count(*) FROM consensus WHERE final_decision = '') = 0""")
def _(t):
    """Once with every open row settled as Include, once as it stands (all or nothing)."""
    worklist = cut(decisions.consensus_list(*stage_one(t)))
    settled = worklist.withColumn("final_decision", F.when(F.col("status") == "open", "include").otherwise(F.col("final_decision")))
    done = decisions.final_decisions(settled).select("record_id", "final_decision", F.lit("all settled").alias("round"))
    return done.unionByName(decisions.final_decisions(worklist).select("record_id", "final_decision", F.lit("one open").alias("round")))


@query("second_sheets", f"""{STAGE1}, full_lead AS (SELECT record_id, CASE WHEN n_chars < 700 THEN 'exclude' WHEN n_chars > 5000 THEN 'unsure' ELSE 'include' END AS d FROM assignment)
  SELECT a.second AS reviewer, a.record_id FROM assignment a JOIN full_lead l USING (record_id) WHERE a.calibration = 'N' AND l.d <> 'include'""")
def _(t):
    assignment, _, _ = stage_one(t)
    n = F.col("n_chars")
    lead = assignment.select("record_id", F.when(n < 700, "Exclude").when(n > 5000, "unsure").otherwise("Include").alias("decision"))
    return workflow.second_sheets(assignment, lead).select("reviewer", "record_id")


@query("boundary_examples", f"{STAGE1}, {CONSENSUS_SQL} SELECT record_id FROM consensus WHERE reason_a = {string_sql(P_REASON)} OR reason_b = {string_sql(P_REASON)}")
def _(t):
    return decisions.boundary_examples(decisions.consensus_list(*stage_one(t)), P_REASON).select("record_id")


@query("merged_sheets", """WITH s AS (
    SELECT 'r1' AS reviewer, doc_id AS record_id, CASE quality WHEN 1 THEN 'Include' ELSE 'Exclude' END AS decision, 1 AS priority FROM labels
    UNION ALL SELECT 'r1', doc_id, 'Unsure', 2 FROM documents WHERE lang = 'en')
  SELECT reviewer, record_id, arg_min(decision, priority) AS decision, count(*) AS copies FROM s GROUP BY ALL""")
def _(t):
    main = t.labels.select(F.lit("r1").alias("reviewer"), F.col("doc_id").alias("record_id"),
                           F.when(F.col("quality") == 1, "Include").otherwise("Exclude").alias("decision"), F.lit(1).alias("priority"))
    more = t.documents.where("lang = 'en'").select(F.lit("r1").alias("reviewer"), F.col("doc_id").alias("record_id"),
                                                   F.lit("Unsure").alias("decision"), F.lit(2).alias("priority"))
    return decisions.merge_sheets(main.unionByName(more))


@query("stages_attributed", """SELECT doc_id AS ord, CASE WHEN toxic = 1 THEN 'P1.5 filter' WHEN quality = 0 THEN 'P2 venue' WHEN quality = 1 THEN 'P3b' ELSE '?' END AS stage,
    CASE WHEN toxic = 1 THEN lang WHEN quality = 0 THEN source ELSE '' END AS note FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    base = t.documents.select(F.col("doc_id").alias("ord"), "lang", "source")
    marked = t.labels.select(F.col("doc_id").alias("ord"), "quality", "toxic").join(base, "ord")
    return workflow.stage_attribution(base.select("ord"), [
        (marked.where("toxic = 1"), F.col("lang"), "P1.5 filter"),
        (marked.where("quality = 0"), F.col("source"), "P2 venue"),
        (marked, F.lit(""), "P3b")])


@query("rescreen_targets", f"""{STAGE1}, {CONSENSUS_SQL}, w AS (SELECT ord, unnest(regexp_extract_all(lower(title || ' ' || abstract), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM records),
  terms AS (SELECT ord, string_agg(DISTINCT word, ';' ORDER BY word) AS terms FROM w WHERE regexp_full_match(word, '(fat(?:ter|ness)?|thin(?:ner|ness)?|ther[\\p{{L}}\\p{{N}}_]*|clown)') GROUP BY ord)
  SELECT a.record_id, t.terms, CASE WHEN c.record_id IS NULL THEN '協議リスト外(stage 1 の著者と stage 2 の第 2 評価者がともに Exclude)'
    ELSE '最終 ' || c.final_decision || '(協議リスト: r1=' || c.decision_a || ' ' || c.reason_a || ' / ' || c.reviewer_b || '=' || c.decision_b || ' ' || c.reason_b || ')' END AS p3b_previous,
    coalesce(s.reviewer, '') AS stage2_reviewer, coalesce(s.decision, '') AS stage2_decision
  FROM assignment a JOIN terms t ON t.ord = a.ord LEFT JOIN consensus c ON c.record_id = a.record_id LEFT JOIN second_sheet s ON s.record_id = a.record_id""")
def _(t):
    assignment, first, second = stage_one(t)
    texts = records(t).select("ord", screening.term_matches(screening.joined_text(F.col("title"), F.col("abstract")), TOPIC_TERMS).alias("terms"))
    traced = assignment.join(texts.where("terms <> ''"), "ord").withColumn("stage", F.lit("P3b final"))
    final = decisions.consensus_list(assignment, first, second)
    return decisions.rescreen_targets(traced, assignment, final, second).drop("title", "doi", "stage2_reason")


# --- full text: parts are the records, two rounds of criteria the sheets --------------------------------

FULL_SQL = f"""{ANSWERS_SQL}, fa AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'r1' WHEN 1 THEN 'r1' ELSE 'r2' END AS ra, CASE p_partkey % 3 WHEN 0 THEN 'r2' ELSE 'r3' END AS rb,
      CASE WHEN p_size = 50 THEN 'N' ELSE 'Y' END AS distributed, p_name, p_size, p_retailprice FROM part),
  sheet AS (
    SELECT fa.ra AS reviewer, a.*, 'a' AS side, '' AS reason, CASE WHEN p_size % 2 = 0 THEN 'p.1' ELSE '' END AS evidence, CASE WHEN p_size < 30 THEN '12' ELSE 'many' END AS n_total,
      CASE WHEN p_size < 20 THEN 'IPD; 環境' WHEN p_size < 35 THEN 'IPD；other' ELSE '' END AS scale_target FROM fa JOIN answers a USING (p_partkey)
    UNION ALL SELECT fa.rb, a.p_partkey, a."P", CASE WHEN p_size > 45 THEN 'N' ELSE a."I_hmd" END, 'Y', a."C", a."O", CASE WHEN p_retailprice > 1500 THEN 'x' ELSE a."S" END, 'b',
      CASE WHEN p_size = 7 THEN 'free text' ELSE '' END, '', '', '' FROM fa JOIN answers a USING (p_partkey)),
  decided AS (SELECT *, CASE WHEN 'N' IN ("P","I_hmd","I_scale","C","O","S") THEN 'Exclude' WHEN '' IN ("P","I_hmd","I_scale","C","O","S") THEN ''
      WHEN '?' IN ("P","I_hmd","I_scale","C","O","S") THEN 'Unsure' ELSE 'Include' END AS d0 FROM sheet),
  sheets AS (SELECT * REPLACE (CASE WHEN d0 = 'Exclude' AND reason = '' THEN CASE {' '.join(f'''WHEN "{k}" = 'N' THEN {string_sql(r)}''' for k, r in fixed.REASON_OF_CRITERION)} ELSE '' END ELSE reason END AS reason), d0 AS decision FROM decided)"""


def full_text(t):
    """(assignment, sheets with decision)."""
    k = F.col("p_partkey")
    size, price = F.col("p_size"), F.col("p_retailprice")
    assignment = t.part.select(
        k.alias("record_id"), F.when(k % 3 < 2, "r1").otherwise("r2").alias("reviewer_a"), F.when(k % 3 == 0, "r2").otherwise("r3").alias("reviewer_b"),
        F.when(size == 50, "N").otherwise("Y").alias("distributed"), F.col("p_name").alias("title"),
        "p_size", "p_retailprice",
    ).withColumn("pair", F.concat("reviewer_a", F.lit("×"), "reviewer_b")).withColumn("extractor", F.col("reviewer_a"))
    base = spread_work(assignment, "record_id").join(not_broadcast(part_answers(t).withColumnRenamed("p_partkey", "record_id")), "record_id")
    blank = [n for n in fixed.EXTRACTION if n not in ("n_total", "scale_target")]
    empty = [F.lit("").alias(n) for n in blank]
    a = base.select(
        F.col("reviewer_a").alias("reviewer"), "record_id", *fixed.CRITERIA, F.lit("").alias("reason"),
        F.when(size % 2 == 0, "p.1").otherwise("").alias("evidence"), F.lit("").alias("memo"),
        F.when(size < 30, "12").otherwise("many").alias("n_total"),
        F.when(size < 20, "IPD; 環境").when(size < 35, "IPD；other").otherwise("").alias("scale_target"), *empty)
    b = base.select(
        F.col("reviewer_b").alias("reviewer"), "record_id", "P", F.when(size > 45, "N").otherwise(F.col("I_hmd")).alias("I_hmd"), F.lit("Y").alias("I_scale"),
        "C", "O", F.when(price > 1500, "x").otherwise(F.col("S")).alias("S"), F.when(size == 7, "free text").otherwise("").alias("reason"),
        F.lit("").alias("evidence"), F.lit("").alias("memo"), F.lit("").alias("n_total"), F.lit("").alias("scale_target"), *empty)
    return assignment.drop("p_size", "p_retailprice"), cut(decisions.with_decision(a.unionByName(b)))


REQUIRED_BLANK = [n for n, (need, _, _) in fixed.EXTRACTION.items() if need and n not in ("n_total", "scale_target")]


@query("fulltext_violations", f"""WITH {FULL_SQL}, c AS (SELECT s.*, fa.ra AS extractor FROM sheets s JOIN fa USING (p_partkey))
  SELECT 'error' AS severity, 'answer' AS rule, 'S' AS field, reviewer, p_partkey AS record_id FROM c WHERE "S" NOT IN ('Y', 'N', '?', '')
  UNION ALL SELECT 'error', 'unknown reason', '', reviewer, p_partkey FROM c WHERE reason <> '' AND reason NOT IN ({REASON_LIST})
  UNION ALL SELECT 'warning', 'criteria left blank', '', reviewer, p_partkey FROM c WHERE decision = ''
  UNION ALL SELECT 'error', 'no reason', '', reviewer, p_partkey FROM c WHERE decision = 'Exclude' AND reason = ''
  UNION ALL SELECT 'error', 'no evidence', '', reviewer, p_partkey FROM c WHERE decision = 'Exclude' AND evidence = ''
  UNION ALL SELECT 'warning', 'reason without exclusion', '', reviewer, p_partkey FROM c WHERE decision IN ('Include', 'Unsure') AND reason <> ''
  UNION ALL SELECT 'error', 'other without memo', '', reviewer, p_partkey FROM c WHERE decision <> '' AND reason = {string_sql(OTHER)} AND "C" <> 'N'
  UNION ALL SELECT 'warning', 'extraction left blank', unnest([{', '.join(string_sql(n) for n in REQUIRED_BLANK)}]), reviewer, p_partkey FROM c WHERE decision IN ('Include', 'Unsure') AND reviewer = extractor
  UNION ALL SELECT 'warning', 'extraction left blank', 'scale_target', reviewer, p_partkey FROM c WHERE decision IN ('Include', 'Unsure') AND reviewer = extractor AND scale_target = ''
  UNION ALL SELECT 'error', 'not a number', 'n_total', reviewer, p_partkey FROM c WHERE decision IN ('Include', 'Unsure') AND reviewer = extractor AND n_total = 'many'
  UNION ALL SELECT 'error', 'not in vocabulary', 'scale_target', reviewer, p_partkey FROM c WHERE decision IN ('Include', 'Unsure') AND reviewer = extractor AND contains(scale_target, 'other')""")
def _(t):
    assignment, sheet = full_text(t)
    return decisions.check_fulltext(sheet, assignment)


PAIRED_SQL = """paired AS (SELECT fa.p_partkey AS record_id, fa.ra || '×' || fa.rb AS pair, a.decision AS da, b.decision AS db, a.reason AS reason_a, b.reason AS reason_b,
    a."P" AS "a_P", b."P" AS "b_P", a."I_hmd" AS "a_I_hmd", b."I_hmd" AS "b_I_hmd", a."I_scale" AS "a_I_scale", b."I_scale" AS "b_I_scale", a."C" AS "a_C", b."C" AS "b_C",
    a."O" AS "a_O", b."O" AS "b_O", a."S" AS "a_S", b."S" AS "b_S", fa.distributed
  FROM fa JOIN sheets a ON a.p_partkey = fa.p_partkey AND a.side = 'a' JOIN sheets b ON b.p_partkey = fa.p_partkey AND b.side = 'b')"""
CRITERIA_SQL = ", ".join(string_sql(k) for k in fixed.CRITERIA)


def cells_sql(test: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test.format(k=k)} THEN '{k}' END" for k in fixed.CRITERIA) + "], lambda x: x IS NOT NULL)"


@query("fulltext_worklist", f"""WITH {FULL_SQL}, {PAIRED_SQL}, p AS (SELECT *, {cells_sql('''"a_{k}" = '?' OR "b_{k}" = '?' ''')} AS q,
    {cells_sql('''"a_{k}" IN ('Y', 'N') AND "b_{k}" IN ('Y', 'N') AND "a_{k}" <> "b_{k}"''')} AS diff FROM paired WHERE da <> '' AND db <> ''),
  w AS (SELECT *, list_filter([CASE WHEN da <> db THEN '判定が不一致' END, CASE WHEN da = 'Unsure' OR db = 'Unsure' THEN 'Unsure' END,
    CASE WHEN len(q) > 0 THEN '基準が ?: ' || array_to_string(q, ',') END], lambda x: x IS NOT NULL) AS why FROM p)
  SELECT record_id, pair, array_to_string(why, ' / ') AS why, array_to_string(diff, ',') AS criteria_disagree, da AS a_decision, db AS b_decision FROM w WHERE len(why) > 0""")
def _(t):
    assignment, sheet = full_text(t)
    pairs = decisions.paired_rows(assignment, sheet, [*fixed.CRITERIA, "decision", "reason", "evidence", "memo"])
    return decisions.fulltext_worklist(pairs).select("record_id", "pair", "why", "criteria_disagree", "a_decision", "b_decision")


@query("fulltext_pair_kappa", f"""WITH {FULL_SQL}, {PAIRED_SQL}, v AS (SELECT pair, da AS a, db AS b FROM paired WHERE da IN ('Include', 'Exclude') AND db IN ('Include', 'Exclude')), {kappa_sql('v', ['pair'])}
  SELECT pair, n, round(po, 9) AS po, round(pe, 9) AS pe, round(kappa, 9) AS kappa FROM kappas""")
def _(t):
    assignment, sheet = full_text(t)
    pairs = decisions.paired_rows(assignment, sheet, ["decision"])
    return rounded(agreement.pair_summary(pairs).select("pair", "n", "po", "pe", "kappa"))


@query("criterion_agreement", f"""WITH {FULL_SQL}, {PAIRED_SQL}
  {' UNION ALL '.join(f'''SELECT pair, '{k}' AS criterion, count(*) FILTER (WHERE "a_{k}" IN ('Y', 'N') AND "b_{k}" IN ('Y', 'N')) AS n,
    count(*) FILTER (WHERE "a_{k}" IN ('Y', 'N') AND "b_{k}" IN ('Y', 'N') AND "a_{k}" = "b_{k}") AS agree,
    count(*) FILTER (WHERE "a_{k}" IN ('Y', 'N') AND "b_{k}" IN ('Y', 'N') AND "a_{k}" <> "b_{k}") AS disagree,
    count(*) FILTER (WHERE "a_{k}" = '?' OR "b_{k}" = '?') AS unsure FROM paired WHERE da <> '' AND db <> '' GROUP BY pair''' for k in fixed.CRITERIA)}""")
def _(t):
    assignment, sheet = full_text(t)
    return agreement.criterion_summary(decisions.paired_rows(assignment, sheet, [*fixed.CRITERIA, "decision"]))


PRIORITY_SQL = "[" + ", ".join(string_sql(r) for r in fixed.REASON_PRIORITY) + "]"


@query("fulltext_final", f"""WITH {FULL_SQL}, {PAIRED_SQL},
  wl AS (SELECT p_partkey AS record_id, CASE WHEN p_size % 3 = 0 THEN 'Include' WHEN p_size % 3 = 1 THEN 'Exclude' ELSE '' END AS wd,
      CASE WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN {string_sql(fixed.EXCLUDE_REASONS[5])} ELSE '' END AS wr FROM part
    WHERE p_partkey IN (SELECT record_id FROM paired WHERE da <> db)),
  r AS (SELECT p.*, coalesce(wl.wd, '') AS wd, coalesce(wl.wr, '') AS wr, list_sort(list_filter([list_position({PRIORITY_SQL}, reason_a), list_position({PRIORITY_SQL}, reason_b)], lambda x: x > 0)) AS ranks
    FROM paired p LEFT JOIN wl USING (record_id)),
  f AS (SELECT *, da = db AND da IN ('Include', 'Exclude') AND wd = '' AS agreed, CASE WHEN da = db AND da IN ('Include', 'Exclude') AND wd = '' THEN da ELSE wd END AS fd FROM r),
  g AS (SELECT *, CASE WHEN fd = 'Exclude' THEN CASE WHEN wr <> '' THEN wr WHEN len(ranks) > 0 THEN {PRIORITY_SQL}[ranks[1]] ELSE '' END ELSE '' END AS fr,
    fd = 'Exclude' AND wr = '' AND len(list_distinct(ranks)) > 1 AS split FROM f),
  h AS (SELECT *, CASE WHEN distributed <> 'Y' THEN 'not distributed' WHEN da = '' OR db = '' THEN 'decisions incomplete' WHEN fd NOT IN ('Include', 'Exclude') THEN 'no consensus decision'
    WHEN fd = 'Exclude' AND fr = '' THEN 'no reason' ELSE '' END AS problem FROM g)
  SELECT record_id, problem, CASE WHEN problem IN ('', 'no reason') THEN CASE WHEN agreed THEN '一致' ELSE '協議' END END AS decided_by,
    CASE WHEN problem IN ('', 'no reason') THEN fd END AS final_decision, CASE WHEN problem IN ('', 'no reason') THEN fr END AS final_reason,
    CASE WHEN problem IN ('', 'no reason') THEN CASE WHEN split THEN '(理由が割れたので優先順位で採用)' ELSE '' END END AS reason_note FROM h""")
def _(t):
    return full_final(t)[0].select("record_id", "problem", "decided_by", "final_decision", "final_reason", "reason_note")


def full_final(t):
    assignment, sheet = full_text(t)
    size = F.col("p_size")
    given = lambda tag: sheet.select("record_id", F.col("reviewer").alias(f"reviewer_{tag}"), F.col("decision").alias(f"d{tag}"))
    both = decisions.beside(decisions.beside(assignment, given("a"), "a"), given("b"), "b")
    entered = t.part.join(not_broadcast(both.where("da <> db").select(F.col("record_id").alias("p_partkey"))), "p_partkey", "left_semi")
    worklist = entered.select(
        F.col("p_partkey").alias("record_id"), F.when(size % 3 == 0, "Include").when(size % 3 == 1, "Exclude").otherwise("").alias("final_decision"),
        F.when((size % 3 == 1) & (size % 2 == 0), fixed.EXCLUDE_REASONS[5]).otherwise("").alias("final_reason"), F.lit("").alias("consensus_note"))
    return decisions.fulltext_final(assignment, sheet, worklist), assignment, sheet


@query("extraction_table", f"""WITH {FULL_SQL}, {PAIRED_SQL}, k AS (SELECT record_id FROM paired WHERE distributed = 'Y' AND da = 'Include' AND db = 'Include'
    UNION SELECT p.record_id FROM paired p JOIN part ON p_partkey = p.record_id WHERE distributed = 'Y' AND da <> db AND da <> '' AND db <> '' AND p_size % 3 = 0)
  SELECT k.record_id, s.reviewer AS extractor, s.n_total, s.scale_target, ({len(REQUIRED_BLANK)} + (s.n_total = '')::INT + (s.scale_target = '')::INT)::BIGINT AS blank_required
  FROM k JOIN sheets s ON s.p_partkey = k.record_id AND s.side = 'a'""")
def _(t):
    final, assignment, sheet = full_final(t)
    return decisions.extraction_table(final, assignment, sheet).select("record_id", "extractor", "n_total", "scale_target", "blank_required")


@query("provisional_status", """WITH d AS (SELECT doc_id AS record_id, CASE WHEN n_chars > 4000 THEN 'N' ELSE 'Y' END AS distributed, lang, quality FROM documents LEFT JOIN labels USING (doc_id))
  SELECT record_id, CASE WHEN distributed <> 'Y' THEN 'not distributed' WHEN lang IN ('de', 'fr') THEN 'hold: ' || lang WHEN quality = 1 THEN 'Include' WHEN quality = 0 THEN 'Exclude' ELSE 'open' END AS status FROM d""")
def _(t):
    assignment = t.documents.select(F.col("doc_id").alias("record_id"), F.when(F.col("n_chars") > 4000, "N").otherwise("Y").alias("distributed"))
    final = t.labels.select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "Include").otherwise("Exclude").alias("final_decision"))
    topics = t.documents.select(F.col("doc_id").alias("record_id"), F.col("lang").alias("topic"))
    return decisions.provisional_status(assignment, final, topics, ["de", "fr"])


# --- progress files and updates ---------------------------------------------------------------------------

@query("progress_import", """SELECT 'rows' AS part, doc_id::VARCHAR AS file, 'R' || doc_id AS record_id, CASE quality WHEN 1 THEN 'Include' ELSE 'Exclude' END AS detail FROM labels
    WHERE NOT (toxic = 1 AND quality = 0) AND NOT (toxic = 1 AND quality = 1)
  UNION ALL SELECT 'violations', doc_id::VARCHAR, '', 'error: owner' FROM labels WHERE toxic = 1 AND quality = 0
  UNION ALL SELECT 'violations', doc_id::VARCHAR, '', 'error: format' FROM labels WHERE toxic = 1 AND quality = 1
  UNION ALL SELECT 'violations', doc_id::VARCHAR, '', 'warning: count' FROM labels WHERE quality = 0 AND doc_id % 2 = 0""")
def _(t):
    q, x, d = F.col("quality"), F.col("toxic"), F.col("doc_id").cast("string")
    entry = F.create_map(F.concat(F.lit("R"), d), F.struct(F.when(q == 1, "Include").otherwise("Exclude").alias("decision"), F.lit("").alias("reason")))
    text = F.to_json(F.struct(
        F.when((x == 1) & (q == 1), "other").otherwise("phase3b-progress").alias("format"), F.lit(1).alias("version"),
        F.when((x == 1) & (q == 0), "r2").otherwise("r1").alias("sheet"),
        F.struct(F.when((q == 0) & (F.col("doc_id") % 2 == 0), 5).otherwise(1).alias("done")).alias("counts"), entry.alias("decisions")))
    rows, violations = decisions.parse_progress(t.labels.select(d.alias("file"), text.alias("json")), F.lit("r1"))
    return rows.select(F.lit("rows").alias("part"), "file", "record_id", F.col("decision").alias("detail")).unionByName(
        violations.select(F.lit("violations").alias("part"), "file", F.lit("").alias("record_id"), F.col("rule").alias("detail")))


@query("decision_upsert", f"""WITH cur AS (SELECT doc_id AS record_id, CASE WHEN n_chars < 800 THEN 'Exclude' ELSE '' END AS decision FROM documents),
  inc AS (SELECT doc_id AS record_id, CASE quality WHEN 1 THEN 'Include' ELSE 'Exclude' END AS d FROM labels),
  v AS (SELECT record_id FROM cur JOIN inc USING (record_id) WHERE decision <> '' AND decision <> d)
  SELECT 'conflict' AS part, record_id, 'conflict' AS decision FROM v
  UNION ALL SELECT 'refused', record_id, CASE WHEN (SELECT count(*) FROM v) = 0 THEN coalesce(d, decision) ELSE decision END FROM cur LEFT JOIN inc USING (record_id)
  UNION ALL SELECT 'forced', record_id, coalesce(d, decision) FROM cur LEFT JOIN inc USING (record_id)""")
def _(t):
    current = t.documents.select(F.col("doc_id").alias("record_id"), F.when(F.col("n_chars") < 800, "Exclude").otherwise("").alias("decision"),
                                 F.lit("").alias("reason"), F.lit("").alias("note"))
    good = F.col("quality") == 1
    incoming = t.labels.select(F.col("doc_id").alias("record_id"), F.when(good, " include").otherwise("EXCLUDE").alias("decision"),
                               F.when(good, "").otherwise(P_REASON).alias("reason"), F.lit("").alias("note"))
    table, violations = decisions.upsert(current, incoming)
    forced, _ = decisions.upsert(current, incoming, force=True)
    return violations.select(F.lit("conflict").alias("part"), "record_id", F.col("rule").alias("decision")).unionByName(
        table.select(F.lit("refused").alias("part"), "record_id", "decision")).unionByName(
        forced.select(F.lit("forced").alias("part"), "record_id", "decision"))


LABEL_CRITERIA = {"P": "p_size < 5", "I_hmd": "p_type = 'SMALL'", "I_scale": "p_size > 48", "C": "p_retailprice < 905", "O": "p_size = 30", "S": "p_type = 'PROMO' AND p_size < 25"}
#: Per part its answers and what an entry of a full-text progress file says of it.
ENTRIES_SQL = f"""answers AS (SELECT p_partkey, p_size, p_name, 'F' || p_partkey // 50 AS file, p_partkey // 50 % 10 AS kind,
    {', '.join(f"CASE WHEN {c} THEN 'N' WHEN p_partkey % 41 = 0 THEN '?' ELSE 'Y' END AS {k}" for k, c in LABEL_CRITERIA.items())} FROM part),
  entries AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN '{fixed.EXCLUDE_REASONS[5]}' ELSE '' END AS given,
    CASE {' '.join(f"WHEN {k} = 'N' THEN '{r}'" for k, r in fixed.REASON_OF_CRITERION)} ELSE '' END AS auto FROM answers),
  said AS (SELECT *, CASE WHEN auto <> '' AND given <> auto THEN given ELSE '' END AS reason,
    CASE WHEN p_partkey % 97 = 0 THEN 'many' WHEN p_size % 5 = 0 THEN '{fixed.MISSING_TOKENS[0]}' ELSE p_size::VARCHAR END AS n_total,
    CASE WHEN p_partkey % 89 = 0 THEN 'IPD; elsewhere' ELSE 'IPD; 環境' END AS scale_target FROM entries WHERE kind < 8)"""


def fulltext_files(t, sound: bool = False):
    """(file, json) of full-text progress, 50 parts a file; some files and cells are refused unless `sound`."""
    size, key = F.col("p_size"), F.col("p_partkey")
    answers = F.create_map(*[x for k, c in LABEL_CRITERIA.items() for x in (
        F.lit(k), F.when(F.expr(c), "N").when(key % 41 == 0, "?").otherwise(" Y "))])
    bad = (lambda c: F.lit(False)) if sound else (lambda c: c)
    listed = F.to_json(F.array(F.lit("IPD"), F.when(bad(key % 89 == 0), "elsewhere").otherwise("環境")))
    ext = F.create_map(
        F.lit("n_total"), F.when(bad(key % 97 == 0), "many").when(size % 5 == 0, fixed.MISSING_TOKENS[0]).otherwise(size.cast("string")),
        F.lit("scale_target"), F.when(key % 2 == 0, listed).otherwise(F.concat(F.lit("IPD; "), F.when(bad(key % 89 == 0), "elsewhere").otherwise("環境"))))
    ext = F.when(bad(key % 101 == 0), F.map_concat(ext, F.create_map(F.lit("colour"), F.lit("red")))).otherwise(ext)
    entry = F.struct(answers.alias("c"), F.when(size % 4 == 0, fixed.EXCLUDE_REASONS[5]).otherwise("").alias("reason"),
                     F.concat(F.lit(" "), "p_name").alias("evidence"), F.lit(None).cast("string").alias("memo"), ext.alias("ext"))
    rows = t.part.select(F.floor(key / 50).alias("no"), F.concat(F.lit("R"), key.cast("string")).alias("record_id"), entry.alias("e"))
    # Fifty parts a file by construction.
    files = rows.groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("record_id", "e"))).alias("entries"))
    kind = F.col("no") % 10
    text = F.to_json(F.struct(F.when(kind == 9, "other").otherwise("phase4-progress").alias("format"), F.lit(1).alias("version"),
                              F.when(kind == 8, "r2").otherwise("r1").alias("sheet"), "entries"))
    return files.select(F.concat(F.lit("F"), F.col("no").cast("string")).alias("file"), text.alias("json"))


@query("fulltext_import", f"""WITH {ENTRIES_SQL}, cells AS (
    {' UNION ALL '.join(f"SELECT file, 'R' || p_partkey AS record_id, '{k}' AS field, {k} AS value FROM said" for k in [*LABEL_CRITERIA, 'reason'])}
    UNION ALL SELECT file, 'R' || p_partkey, 'evidence', p_name FROM said UNION ALL SELECT file, 'R' || p_partkey, 'memo', '' FROM said
    UNION ALL SELECT file, 'R' || p_partkey, 'n_total', n_total FROM said WHERE n_total <> 'many'
    UNION ALL SELECT file, 'R' || p_partkey, 'scale_target', scale_target FROM said WHERE scale_target NOT LIKE '%elsewhere')
  SELECT 'cell' AS part, * FROM cells
  UNION ALL SELECT 'violation', file, 'R' || p_partkey, 'n_total', 'not a number' FROM said WHERE n_total = 'many'
  UNION ALL SELECT 'violation', file, 'R' || p_partkey, 'scale_target', 'not in vocabulary' FROM said WHERE scale_target LIKE '%elsewhere'
  UNION ALL SELECT 'violation', file, 'R' || p_partkey, 'colour', 'unknown column' FROM said WHERE p_partkey % 101 = 0
  UNION ALL SELECT DISTINCT 'violation', file, '', '', CASE kind WHEN 8 THEN 'owner' ELSE 'format' END FROM entries WHERE kind >= 8""")
def _(t):
    """Progress files of the full-text review, taken apart into cells, and what is refused."""
    cells, violations = decisions.parse_fulltext(fulltext_files(t), F.lit("r1"))
    return cells.select(F.lit("cell").alias("part"), "file", "record_id", "field", "value").unionByName(
        violations.select(F.lit("violation").alias("part"), "file", "record_id", "field", F.col("rule").alias("value")))


@query("fulltext_upsert", f"""WITH {ENTRIES_SQL}, good AS (SELECT p_partkey, evidence, reason, n FROM (SELECT p_partkey, p_size, p_name AS evidence, reason,
      CASE WHEN p_size % 5 = 0 THEN '{fixed.MISSING_TOKENS[0]}' ELSE p_size::VARCHAR END AS n FROM said)),
  sheet AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'seen before' ELSE '' END AS evidence,
    CASE WHEN p_partkey % 11 = 0 THEN 'own reason' ELSE '' END AS reason, '' AS n FROM part)
  SELECT 'forced' AS part, 'R' || s.p_partkey AS record_id, coalesce(g.evidence, s.evidence) AS evidence,
    CASE WHEN coalesce(g.reason, '') = '' THEN s.reason ELSE g.reason END AS reason, coalesce(g.n, s.n) AS n_total FROM sheet s LEFT JOIN good g USING (p_partkey)
  UNION ALL SELECT 'refused', 'R' || p_partkey, evidence, reason, n FROM sheet
  UNION ALL SELECT 'conflict', 'R' || p_partkey, 'evidence', '', '' FROM sheet JOIN good USING (p_partkey) WHERE p_partkey % 7 = 0
  UNION ALL SELECT 'conflict', 'R' || g.p_partkey, 'reason', '', '' FROM sheet s JOIN good g USING (p_partkey) WHERE s.reason <> '' AND g.reason <> ''
  UNION ALL SELECT 'warning', 'R' || g.p_partkey, 'reason', '', '' FROM sheet s JOIN good g USING (p_partkey) WHERE s.reason <> '' AND g.reason = ''""")
def _(t):
    """The cells written into a sheet that has other values in places: refused, and by force."""
    cells, errors = decisions.parse_fulltext(fulltext_files(t, sound=True).where("json NOT LIKE '%\"format\":\"other\"%' AND json LIKE '%\"sheet\":\"r1\"%'"), F.lit("r1"))
    key = F.col("p_partkey")
    sheet = t.part.select(F.concat(F.lit("R"), key.cast("string")).alias("record_id"), *[F.lit("").alias(k) for k in fixed.CRITERIA],
                          F.when(key % 7 == 0, "seen before").otherwise("").alias("evidence"), F.when(key % 11 == 0, "own reason").otherwise("").alias("reason"),
                          F.lit("").alias("memo"), F.lit("").alias("n_total"), F.lit("").alias("scale_target"))
    pick = lambda name, rows: rows.select(F.lit(name).alias("part"), "record_id", "evidence", "reason", "n_total")
    refused, findings = decisions.upsert_cells(sheet, cells, errors)
    forced, _ = decisions.upsert_cells(sheet, cells, errors, force=True)
    blank = F.lit("")
    found = findings.select(F.col("severity").alias("part"), "record_id", F.col("field").alias("evidence"), blank.alias("reason"), blank.alias("n_total"))
    return pick("forced", forced).unionByName(pick("refused", refused)).unionByName(found)


@query("latest_decisions", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(json_extract_string(props, '$.k'), event_id) AS k
  FROM events GROUP BY ALL""")
def _(t):
    """The latest logged value per user and type, as an update table would hold it."""
    rows = t.events.select("user_id", "event_type", "event_id", "value", F.get_json_object("props", "$.k").alias("k"))
    return rows.groupBy("user_id", "event_type").agg(
        F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"), F.max_by("k", "event_id").alias("k"))


@query("marked_rows_appended", """SELECT p_name AS marker, 'old' AS origin FROM part WHERE p_size < 10
  UNION ALL SELECT DISTINCT p_name, 'new' FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 10)""")
def _(t):
    table = t.part.where("p_size < 10").select(F.col("p_name").alias("marker"), F.lit("old").alias("origin"))
    additions = t.part.select(F.col("p_name").alias("marker"), F.lit("new").alias("origin")).distinct()
    once = decisions.append_marked(table, additions, "marker")
    return decisions.append_marked(once, additions, "marker")


# --- formats -------------------------------------------------------------------------------------------------

@query("bibtex_merged", f"""WITH {RECORDS_SQL}, e AS (SELECT key, ord, '@article{{' || key || ', title={{' || md5(title) || '}}}}' || chr(10) AS body FROM records)
  SELECT key AS entry_key, md5(arg_min(body, ord)) AS body_md5, count(*) AS copies, count(DISTINCT body) > 1 AS conflict FROM e GROUP BY key""")
def _(t):
    """Records written as BibTeX in files of 100 consecutive ids, then split and merged again."""
    entry = F.concat(F.lit("@article{"), "key", F.lit(", title={"), F.md5("title"), F.lit("}}"))
    pieces = records(t).select(F.floor(F.col("ord") / 100).alias("slice"), F.struct("ord", entry.alias("e")).alias("p"))
    files = pieces.groupBy("slice").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.when(
        p["ord"] % 2 == 0, p["e"]).otherwise(F.concat(p["e"], F.lit("\n")))), "").alias("value"))
    named = files.select(F.concat(F.lit("export ("), F.col("slice").cast("string"), F.lit(").bib")).alias("file"), "value")
    return readers.merge_bibtex(readers.bibtex_entries(named)).select("entry_key", F.md5("body").alias("body_md5"), "copies", "conflict")


RIS_SQL = f"""{RECORDS_SQL}, ris AS (SELECT ord, 'TY  - ' || CASE lang WHEN 'en' THEN 'CONF' ELSE 'JOUR' END || chr(10) ||
    CASE WHEN title <> '' THEN 'TI  - ' || trim(title) || chr(10) ELSE '' END ||
    CASE lang WHEN 'en' THEN 'T2  - ' ELSE 'JO  - ' END || source || chr(10) || 'PY  - ' || year || chr(10) ||
    CASE WHEN doi <> '' THEN 'DO  - ' || doi || chr(10) ELSE '' END || CASE WHEN issn <> '' THEN 'SN  - ' || issn || chr(10) ELSE '' END ||
    'UR  - ' || url || chr(10) || 'AU  - ' || source || chr(10) || 'KW  - ' || lang || chr(10) || 'ER  - ' || chr(10) AS value FROM records)"""


def ris_rows(t):
    c = F.col
    value = sinks.ris_text(c("title"), F.lit(""), c("source"), c("year"), c("doi"), c("issn"), c("url"), F.array("source"),
                           F.array(c("lang"), F.lit(" ")), c("lang") == "en")
    return records(t).select("ord", "source", value.alias("value"))


@query("ris_written", f"WITH {RIS_SQL} SELECT ord, md5(value) AS value_md5 FROM ris")
def _(t):
    return ris_rows(t).select("ord", F.md5("value").alias("value_md5"))


@query("ris_keys", f"""WITH {RECORDS_SQL} SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS record, CASE WHEN doi <> '' THEN doi WHEN trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) <> ''
    THEN 'T:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) END AS record_key FROM records""")
def _(t):
    """The RIS lines of every record, read back per source file."""
    rows = ris_rows(t).select("ord", "source", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = rows.select(F.col("source").alias("file"), F.lit(0).cast("bigint").alias("part"), (F.col("ord") * 20 + F.col("line")).alias("n"), "value")
    return readers.ris_keys(lines, chunk=1000).select("file", "record", "record_key")


@query("articles_mapped", f"""WITH {RECORDS_SQL} SELECT ord, md5(title) AS title_md5, source AS venue, year, doi, url, lang = 'en' AS is_conference, source || '; ' || lang AS authors FROM records""")
def _(t):
    blank = F.lit("")
    article = F.to_json(F.struct(
        F.when(F.col("lang") == "en", F.col("title")).otherwise(blank).alias("title"), F.col("title").alias("article_title"),
        F.col("source").alias("publication_title"), F.col("year").cast("int").alias("publication_year"), "doi", F.col("url").alias("pdf_url"),
        F.when(F.col("lang") == "en", "Conferences: Conference paper").otherwise("Journals").alias("content_type"),
        F.struct(F.array(F.struct(F.col("source").alias("full_name")), F.struct(F.lit("").alias("full_name")),
                         F.struct(F.col("lang").alias("full_name"))).alias("authors")).alias("authors")))
    return readers.map_articles(records(t).select("ord", article.alias("json"))).select(
        "ord", F.md5("title").alias("title_md5"), "venue", "year", "doi", "url", "is_conference", F.array_join("authors", "; ").alias("authors"))


@query("entries_mapped", f"""WITH {RECORDS_SQL} SELECT ord, md5(title) AS title_md5, source AS venue, year, doi, issn, url, lang = 'de' AS is_conference, source || '; ' || lang AS keywords
  FROM records WHERE lang <> 'fr'""")
def _(t):
    entry = F.when(F.col("lang") == "fr", F.lit('{"error": "Result set was empty"}')).otherwise(F.to_json(F.struct(
        F.col("title").alias("dc:title"), F.col("source").alias("prism:publicationName"), F.concat("year", F.lit("-05-01")).alias("prism:coverDate"),
        F.col("doi").alias("prism:doi"), F.col("issn").alias("prism:eIssn"),
        F.when(F.col("lang") == "de", "Conference Proceeding").otherwise("Journal").alias("prism:aggregationType"),
        F.concat("source", F.lit(" | | "), "lang").alias("authkeywords"),
        F.array(F.struct(F.lit("self").alias("@ref"), F.lit("x").alias("@href")), F.struct(F.lit("scopus").alias("@ref"), F.col("url").alias("@href"))).alias("link"))))
    return readers.map_entries(records(t).select("ord", entry.alias("json"))).select(
        "ord", F.md5("title").alias("title_md5"), "venue", "year", "doi", "issn", "url", "is_conference", F.array_join("keywords", "; ").alias("keywords"))


@query("pages_split", """SELECT conv_id || '-' || turn AS record_id, p::INT AS page, md5(CASE p WHEN 1 THEN chr(10) || text || chr(10) ELSE chr(10) || role || chr(10) END) AS text_md5
  FROM conversations CROSS JOIN (VALUES (1), (12)) v(p)""")
def _(t):
    value = F.concat(F.lit("head\n[p.1]\n"), "text", F.lit("\n[p.12]  \n"), "role", F.lit("\n"))
    files = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), value.alias("value"))
    return readers.pages_of(files).select("record_id", "page", F.md5("text").alias("text_md5"))


@query("exports_united", """SELECT 'ACM(wave2)' AS "Source_DB", doc_id AS id, lang, '' AS role FROM documents
  UNION ALL SELECT 'IEEE', conv_id, '', role FROM conversations UNION ALL SELECT 'my list', event_id, '', event_type FROM events""")
def _(t):
    """Tables of different columns under file names: the union of columns, blanks where one lacks."""
    tables = [
        (t.documents.select(F.col("doc_id").alias("id"), "lang"), "raw/ACM_wave2_20260803.csv"),
        (t.conversations.select(F.col("conv_id").alias("id"), "role"), "raw/ieee.csv"),
        (t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("role")), "raw/my list.csv"),
        (t.labels.select(F.col("doc_id").alias("id")), "raw/pubmed.csv"),
    ]
    merged = None
    for rows, name in tables:
        tagged = rows.withColumn("Source_DB", readers.source_of_file(F.lit(name)))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged.where(~F.col("Source_DB").isin(*fixed.SKIPPED_SOURCES)).na.fill("")
