"""Counting reports, agreement between raters, assignment."""

from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import identifiers as ids
from sievelake.functions import labels, screening
from sievelake.operators import agreement, reports, skew, workflow
from sievelake.plans.records import (
    KEYED_SQL, RECORDS_SQL, TOPIC_EXCLUSIONS, TOPIC_GROUPS, hits_sql, keyed_records, md5_modulo_sql, records,
    string_sql, strip_sql,
)
from sievelake.plans.registry import query
from sievelake.plans.text_queries import HAYSTACK, categories_sql, keywords_sql
from sievelake.session import cut

BIG = "bigint"


@query("keyword_report", f"""WITH {RECORDS_SQL}, h AS (SELECT unnest({keywords_sql(HAYSTACK, TOPIC_EXCLUSIONS)}) AS hit FROM records),
  p(category, pattern) AS (VALUES {', '.join(f'({string_sql(c)}, {string_sql(x)})' for c, ps in TOPIC_EXCLUSIONS for x in ps)})
  SELECT category, pattern, (SELECT count(*) FROM h WHERE h.hit = category || '::' || pattern) AS hits FROM p""")
def _(t):
    return reports.keyword_report(records(t).select("title", "abstract"), TOPIC_EXCLUSIONS)


@query("keyword_overlap", f"""WITH {RECORDS_SQL}, c AS (SELECT {categories_sql(HAYSTACK, TOPIC_EXCLUSIONS)} AS cats FROM records),
  x AS (SELECT * FROM c WHERE len(cats) > 0)
  {' UNION ALL '.join(f"SELECT {string_sql(n)} AS figure, count(*) FILTER (WHERE list_contains(cats, {string_sql(n)})) AS n FROM x" for n, _ in TOPIC_EXCLUSIONS)}
  UNION ALL SELECT 'in several', count(*) FILTER (WHERE len(cats) > 1) FROM x
  UNION ALL SELECT 'surplus', sum(len(cats) - 1)::BIGINT FROM x UNION ALL SELECT 'excluded', count(*) FROM x""")
def _(t):
    rows = screening.with_keywords(records(t).select("title", "abstract"), TOPIC_EXCLUSIONS)
    return reports.category_overlap(F.col("kw_categories"), rows, [n for n, _ in TOPIC_EXCLUSIONS])


@query("top_values", """WITH c AS (SELECT p_name AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
  b AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 10)
  SELECT value, n, round((SELECT sum(n) FROM b)::DOUBLE / (SELECT sum(n) FROM c), 6) AS covered FROM b""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_name")
    return reports.top_values(rows, "p_name", 10)


@query("reason_distribution", """WITH v AS (SELECT CASE WHEN p_size < 10 THEN 'P: 対象者が不適合' WHEN p_size < 20 THEN 'その他' WHEN p_size < 30 THEN 'free text' END AS value FROM part),
  c AS (SELECT value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY value)
  SELECT value, CASE value WHEN 'P: 対象者が不適合' THEN 1 WHEN 'その他' THEN 9 ELSE 999 END::BIGINT AS place, n,
    round(n * 100 / (SELECT sum(n) FROM c)::DOUBLE, 1) AS percent, value <> 'free text' AS listed FROM c""")
def _(t):
    size = F.col("p_size")
    reason = F.when(size < 10, fixed.EXCLUDE_REASONS[0]).when(size < 20, fixed.REASON_OTHER).when(size < 30, "free text")
    rows = t.part.select(reason.alias("reason")).where("reason IS NOT NULL")
    return reports.vocabulary_distribution(rows, "reason", fixed.EXCLUDE_REASONS)


@query("threshold_sweep", """WITH o AS (SELECT o_totalprice AS p, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y FROM orders)
  SELECT v::BIGINT AS threshold, count(*) FILTER (WHERE p < v AND NOT coalesce(y >= 1999, false)) AS dropped,
    count(*) FILTER (WHERE NOT (p < v AND NOT coalesce(y >= 1999, false))) AS kept, count(*) FILTER (WHERE p < v AND coalesce(y >= 1999, false)) AS rescued
  FROM o CROSS JOIN (VALUES (50000), (150000), (300000)) s(v) GROUP BY v""")
def _(t):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    return reports.threshold_sweep(t.orders, F.col("o_totalprice"), year, [50000, 150000, 300000], 1999)


SCORES = [("first", ["with the", r"\bder\b"]), ("second", [r"\bfor\b", "tion on"]), ("third", ["er the", r"\bla\b"])]


def score_sql(c):
    return [f"({' OR '.join(hits_sql(c, p) for p in ps)})::INT" for _, ps in SCORES]


@query("score_distribution", f"""WITH s AS (SELECT {', '.join(f'{e} AS s{i}' for i, e in enumerate(score_sql('lower(text)')))} FROM documents)
  SELECT 'hits first' AS figure, sum(s0)::BIGINT AS n FROM s UNION ALL SELECT 'hits second', sum(s1)::BIGINT FROM s UNION ALL SELECT 'hits third', sum(s2)::BIGINT FROM s
  UNION ALL SELECT 'score ' || v, (SELECT count(*) FROM s WHERE s0 + s1 + s2 = v) FROM range(4) r(v)
  UNION ALL SELECT 'below ' || v, (SELECT count(*) FROM s WHERE s0 + s1 + s2 < v) FROM range(1, 3) r(v)""")
def _(t):
    return reports.score_distribution(t.documents, F.col("text"), SCORES)


def score_figures_sql(c: str, categories) -> str:
    """The figures of a score distribution, for any categories."""
    hit = [f"({' OR '.join(hits_sql(c, p) for p in ps)})::INT" for _, ps in categories]
    n = len(categories)
    score = " + ".join(f"s{i}" for i in range(n))
    hits = " UNION ALL ".join(f"SELECT 'hits {name}' AS figure, coalesce(sum(s{i}), 0)::BIGINT AS n FROM s" for i, (name, _) in enumerate(categories))
    return f"""WITH s AS (SELECT {', '.join(f'{e} AS s{i}' for i, e in enumerate(hit))} FROM documents) {hits}
  UNION ALL SELECT 'score ' || v, (SELECT count(*) FROM s WHERE {score} = v) FROM range({n + 1}) r(v)
  UNION ALL SELECT 'below ' || v, (SELECT count(*) FROM s WHERE {score} < v) FROM range(1, {n}) r(v)"""


@query("score_distribution_standard", score_figures_sql("lower(text)", fixed.SCORE_CATEGORIES))
def _(t):
    return reports.score_distribution(t.documents, F.col("text"))


@query("verdict_cross_table", f"""WITH s AS (SELECT CASE WHEN n_chars < 1500 THEN 'low' ELSE 'kept' END AS verdict, {' + '.join(score_sql('lower(text)'))} AS s FROM documents)
  SELECT verdict, {', '.join(f'count(*) FILTER (WHERE s = {i}) AS score_{i}' for i in range(4))}, count(*) AS total FROM s GROUP BY verdict""")
def _(t):
    scored = t.documents.select("n_chars", *reports.score_columns(F.col("text"), SCORES))
    verdict = F.when(F.col("n_chars") < 1500, "low").otherwise("kept")
    return reports.verdict_cross_table(scored, verdict, F.col("first") + F.col("second") + F.col("third"), [0, 1, 2, 3])


@query("year_histogram", """WITH c AS (SELECT year(l_shipdate) AS y, l_returnflag AS f FROM lineitem),
  y AS (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM c)
  SELECT y.y AS year, f.f AS flag, count(c.y) AS n FROM y CROSS JOIN (SELECT DISTINCT f FROM c) f LEFT JOIN c ON c.y = y.y AND c.f = f.f GROUP BY ALL""")
def _(t):
    rows = t.lineitem.select(F.year("l_shipdate").cast(BIG).alias("year"), F.col("l_returnflag").alias("flag"))
    return reports.year_histogram(rows, "year", "flag")


SOURCE_SQL = """CASE WHEN contains(url, 'dl.acm.org') OR doi LIKE '10.1145%' THEN 'ACM' WHEN contains(url, 'ieeexplore') OR doi LIKE '10.1109%' THEN 'IEEE'
  WHEN contains(url, 'sciencedirect') OR doi LIKE '10.1016%' THEN 'Scopus/Elsevier' ELSE 'Others/不明' END"""


@query("source_distribution", f"""WITH {RECORDS_SQL} SELECT {SOURCE_SQL} AS value, CASE {SOURCE_SQL} WHEN 'ACM' THEN 1 WHEN 'IEEE' THEN 2 WHEN 'Scopus/Elsevier' THEN 3 ELSE 5 END::BIGINT AS place,
    count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM records)::DOUBLE, 1) AS percent, true AS listed FROM records GROUP BY ALL""")
def _(t):
    rows = records(t).select(ids.guess_source(F.col("url"), F.col("doi"), F.lit("")).alias("db"))
    return reports.vocabulary_distribution(rows, "db", ["ACM", "IEEE", "Scopus/Elsevier", "PubMed/PsycInfo", "Others/不明"])


@query("other_domains", f"""WITH {RECORDS_SQL}, c AS (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS value, count(*) AS n FROM records WHERE {SOURCE_SQL} = 'Others/不明' GROUP BY 1),
  b AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 10) SELECT value, n, round((SELECT sum(n) FROM b)::DOUBLE / (SELECT sum(n) FROM c), 6) AS covered FROM b""")
def _(t):
    other = records(t).where(ids.guess_source(F.col("url"), F.col("doi"), F.lit("")) == "Others/不明")
    return reports.top_values(other.select(ids.url_domain(F.col("url")).alias("domain")), "domain", 10)


@query("figures_reconciled", """WITH e AS (SELECT 'documents' AS label, count(DISTINCT doc_id) AS expected FROM documents
    UNION ALL SELECT 'labelled', count(*) FROM documents UNION ALL SELECT 'turns', sum(n) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)
    UNION ALL SELECT 'missing', 0),
  g AS (SELECT 'documents' AS label, count(*) AS got FROM documents UNION ALL SELECT 'labelled', count(*) FROM labels
    UNION ALL SELECT 'turns', count(*) FROM conversations)
  SELECT label, got, expected::BIGINT AS expected, CASE WHEN got = expected THEN 'OK' ELSE 'FAIL' END AS state FROM e LEFT JOIN g USING (label)""")
def _(t):
    """Figures as stated, each against a count taken another way; one is stated for nothing."""
    one = lambda label, rows, value, name: rows.agg(value.cast(BIG).alias(name)).select(F.lit(label).alias("label"), name)
    every = F.count("*")
    got = one("documents", t.documents, every, "got").unionByName(one("labelled", t.labels, every, "got")).unionByName(
        one("turns", t.conversations, every, "got"))
    turns = t.conversations.groupBy("conv_id").agg(every.alias("n"))
    expected = one("documents", t.documents, F.count_distinct("doc_id"), "expected").unionByName(
        one("labelled", t.documents, every, "expected")).unionByName(one("turns", turns, F.sum("n"), "expected")).unionByName(
        one("missing", t.documents, F.count_if(F.lit(False)), "expected"))
    return reports.reconcile(got, expected)


PUBLISHER_SQL = """CASE WHEN doi = '' THEN 'DOI なし(書誌の確認が先)' ELSE CASE split_part(doi, '/', 1) WHEN '10.1145' THEN 'ACM' WHEN '10.1109' THEN 'IEEE' WHEN '10.1016' THEN 'Elsevier' ELSE 'その他' END END"""


@query("missing_by_publisher", f"""WITH {RECORDS_SQL}, m AS (SELECT ord, {PUBLISHER_SQL} AS grp FROM records WHERE n_chars < 900)
  SELECT ord, grp, count(*) OVER (PARTITION BY grp) AS group_size FROM m""")
def _(t):
    missing = records(t).where("n_chars < 900").select("ord", "doi")
    return reports.grouped_list(missing, ids.publisher_of_doi(F.col("doi"))).select("ord", "grp", "group_size")


@query("repeatable_sample", """SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 30""")
def _(t):
    rows = t.documents.select("doc_id")
    return reports.first_sample(rows.withColumn("k", F.col("doc_id").cast("string")), "k", "42", 30).select("doc_id")


@query("drop_categories", """SELECT CASE WHEN p_size < 10 THEN 'unmatched' WHEN p_size % 4 = 0 THEN 'other' WHEN p_size < 25 THEN 'criterion' ELSE 'other' END AS category, count(*) AS n
  FROM part GROUP BY 1""")
def _(t):
    size = F.col("p_size")
    q = F.concat(F.lit("Q"), (size % 4 + 1).cast("string"))
    why = F.when(size < 10, "Venue not found in CORE or SJR").when(size < 25, F.concat(F.lit("SJR Quartile '"), q, F.lit("'"))).otherwise("")
    reason = labels.rank_drop_reason(why, F.col("p_name"), F.lit("x"), F.lit("B"), q)
    return t.part.select(labels.drop_category(reason)["category"].alias("category")).groupBy("category").agg(F.count("*").alias("n"))


# --- agreement: three raters of the labelled documents ------------------------------------------------

RATERS_SQL = """ratings AS (
  SELECT doc_id AS record_id, lang, reviewer, CASE reviewer
      WHEN 'r1' THEN CASE WHEN quality = 1 THEN 'include' WHEN n_chars > 3000 THEN ' Unsure' ELSE 'EXCLUDE' END
      WHEN 'r2' THEN CASE WHEN toxic = 1 THEN 'Exclude' WHEN n_chars > 4000 THEN 'unsure' WHEN n_chars < 300 THEN '' ELSE 'Include' END
      ELSE CASE WHEN n_chars % 3 = 0 THEN 'Exclude' WHEN n_chars % 7 = 0 THEN 'maybe' ELSE 'Include' END END AS decision
  FROM labels JOIN documents USING (doc_id) CROSS JOIN (VALUES ('r1'), ('r2'), ('r3')) v(reviewer)),
  valid AS (SELECT record_id, lang, reviewer, upper(substr(trim(decision), 1, 1)) || lower(substr(trim(decision), 2)) AS d FROM ratings
    WHERE lower(trim(decision)) IN ('include', 'exclude', 'unsure')),
  pairs AS (SELECT x.record_id, x.lang, x.reviewer AS rater_a, y.reviewer AS rater_b, x.d AS a, y.d AS b
    FROM valid x JOIN valid y ON x.record_id = y.record_id AND x.reviewer < y.reviewer)"""


def ratings(t):
    n = F.col("n_chars")
    one = F.when(F.col("quality") == 1, "include").when(n > 3000, " Unsure").otherwise("EXCLUDE")
    two = F.when(F.col("toxic") == 1, "Exclude").when(n > 4000, "unsure").when(n < 300, "").otherwise("Include")
    three = F.when(n % 3 == 0, "Exclude").when(n % 7 == 0, "maybe").otherwise("Include")
    rows = F.array(*[F.struct(F.lit(r).alias("reviewer"), d.alias("decision")) for r, d in (("r1", one), ("r2", two), ("r3", three))])
    return t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("record_id"), "lang", F.explode(rows).alias("x")).select("record_id", "lang", "x.reviewer", "x.decision")


def kappa_sql(table, keys):
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    return f"""t AS (SELECT {k}, count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM {table} GROUP BY ALL),
  ma AS (SELECT {k}, a AS c, count(*) AS n FROM {table} GROUP BY ALL), mb AS (SELECT {k}, b AS c, count(*) AS n FROM {table} GROUP BY ALL),
  cr AS (SELECT {', '.join('x.' + c for c in keys)}, sum(x.n * y.n)::BIGINT AS cross FROM ma x JOIN mb y ON {on} AND x.c = y.c GROUP BY ALL),
  kp AS (SELECT t.*, t.same::DOUBLE / t.n AS po, coalesce(cr.cross, 0)::DOUBLE / (t.n::DOUBLE * t.n) AS pe FROM t LEFT JOIN cr USING ({k})),
  kappas AS (SELECT {k}, n, po, pe, CASE WHEN abs(1 - pe) < 1e-12 THEN 'nan'::DOUBLE ELSE (po - pe) / (1 - pe) END AS kappa FROM kp)"""


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("rater_pairs", f"WITH {RATERS_SQL} SELECT record_id, rater_a, rater_b, a, b FROM pairs")
def _(t):
    return agreement.reviewer_pairs(ratings(t))


@query("kappa_by_pair", f"""WITH {RATERS_SQL}, {kappa_sql('pairs', ['rater_a', 'rater_b'])}
  SELECT rater_a, rater_b, n, round(po, 9) AS po, round(pe, 9) AS pe, round(kappa, 9) AS kappa FROM kappas""")
def _(t):
    return rounded(agreement.cohen_kappa(agreement.reviewer_pairs(ratings(t)), ["rater_a", "rater_b"]))


@query("kappa_two_categories", f"""WITH {RATERS_SQL}, two AS (SELECT rater_a, rater_b, replace(a, 'Unsure', 'Include') AS a, replace(b, 'Unsure', 'Include') AS b FROM pairs),
  {kappa_sql('two', ['rater_a', 'rater_b'])} SELECT rater_a, rater_b, n, round(po, 9) AS po, round(pe, 9) AS pe, round(kappa, 9) AS kappa FROM kappas""")
def _(t):
    two = agreement.two_categories(agreement.reviewer_pairs(ratings(t)))
    return rounded(agreement.cohen_kappa(two, ["rater_a", "rater_b"]))


@query("kappa_mean", f"""WITH {RATERS_SQL}, {kappa_sql('pairs', ['rater_a', 'rater_b'])},
  m AS (SELECT avg(kappa) AS k, count(*) FILTER (WHERE kappa < 0.41) AS low, count(*) AS pairs FROM kappas WHERE NOT isnan(kappa))
  SELECT round(k, 9) AS mean_kappa, low AS low_pairs, pairs, CASE WHEN k < 0 THEN 'poor(偶然以下)' WHEN k < 0.21 THEN 'slight' WHEN k < 0.41 THEN 'fair'
    WHEN k < 0.61 THEN 'moderate' WHEN k < 0.81 THEN 'substantial' ELSE 'almost perfect' END AS label,
    CASE WHEN k >= 0.61 THEN 'continue' WHEN k >= 0.41 THEN 'discuss and inspect reasons' ELSE 'widen stage 2' END
      || CASE WHEN k >= 0.41 AND low > 0 THEN '; low pairs: lower band applies' ELSE '' END AS action FROM m""")
def _(t):
    kappas = agreement.cohen_kappa(agreement.reviewer_pairs(ratings(t)), ["rater_a", "rater_b"])
    return rounded(agreement.mean_kappa(kappas))


@query("pair_summary", f"""WITH {RATERS_SQL}, b AS (SELECT rater_a || '×' || rater_b AS pair, a, b FROM pairs),
  ib AS (SELECT * FROM b WHERE a <> 'Unsure' AND b <> 'Unsure'), {kappa_sql('ib', ['pair'])}
  SELECT b.pair, count(*) AS records, count(*) FILTER (WHERE b.a = 'Unsure' OR b.b = 'Unsure') AS unsure,
    count(*) FILTER (WHERE b.a <> 'Unsure' AND b.b <> 'Unsure' AND b.a <> b.b) AS disagree, any_value(k.n) AS n,
    round(any_value(k.po), 9) AS po, round(any_value(k.pe), 9) AS pe, round(any_value(k.kappa), 9) AS kappa
  FROM b LEFT JOIN kappas k USING (pair) GROUP BY b.pair""")
def _(t):
    pairs = agreement.reviewer_pairs(ratings(t)).select(
        F.concat("rater_a", F.lit("×"), "rater_b").alias("pair"), F.col("a").alias("a_decision"), F.col("b").alias("b_decision"))
    return rounded(agreement.pair_summary(pairs))


@query("vote_summary", f"""WITH {RATERS_SQL}, c AS (SELECT record_id, d, count(*) AS n, min(reviewer) AS f FROM valid GROUP BY ALL)
  SELECT record_id, string_agg(d || '×' || n, ' / ' ORDER BY n DESC, f) AS vote, count(*) AS distinct_votes FROM c GROUP BY record_id""")
def _(t):
    return agreement.vote_summary(ratings(t))


# --- assignment and sheets -------------------------------------------------------------------------

ASSIGN_SQL = f"""firsts AS (SELECT record_key, record_id, min(ord) AS ord FROM keyed GROUP BY ALL),
  cache AS (SELECT doi, arg_max({strip_sql('abstract')}, ord) AS cached FROM records WHERE source < 'src5' AND doi <> '' AND {strip_sql('abstract')} <> '' GROUP BY doi),
  rows AS (SELECT f.record_key AS key, f.record_id, r.*, CASE WHEN lang = 'fr' THEN '' ELSE {strip_sql('abstract')} END AS own, cached
    FROM firsts f JOIN records r USING (ord) LEFT JOIN cache ON r.doi = cache.doi),
  assignment AS (SELECT record_id, key, ord, source, year, doi, {md5_modulo_sql('key', 3)} + 1 AS block,
      CASE WHEN {md5_modulo_sql("'cal:' || key", 100)} < 20 THEN 'Y' ELSE 'N' END AS calibration,
      CASE {md5_modulo_sql("'2nd:' || key", 2)} WHEN 0 THEN 'r2' ELSE 'r3' END AS second, {strip_sql('title')} AS title,
      CASE WHEN own <> '' THEN own ELSE coalesce(cached, '') END AS abstract,
      CASE WHEN own <> '' THEN 'database' WHEN cached IS NOT NULL THEN 'enriched' ELSE 'none' END AS abstract_source FROM rows)"""


def assignment(t):
    rows = records(t).select(
        "ord", "source", "title", F.when(F.col("lang") == "fr", "").otherwise(F.col("abstract")).alias("abstract"), "doi",
        F.col("source").alias("venue"), "year", F.lit("").alias("rank"))
    cache = records(t).where("source < 'src5'").select("ord", "doi", "abstract")
    return workflow.build_assignment(rows, cache, TOPIC_GROUPS)


@query("assignment", f"""WITH {RECORDS_SQL}, {KEYED_SQL}, {ASSIGN_SQL}
  SELECT record_id, block, calibration, 'r1' AS reviewer_a, CASE calibration WHEN 'Y' THEN 'all' ELSE second END AS reviewer_b, key, md5(title) AS title_md5, doi,
    abstract_source, CASE WHEN abstract = '' THEN 'N' ELSE 'Y' END AS has_abstract,
    ({' + '.join(f'''{hits_sql("title || ' ' || abstract", p)}::INT''' for _, p in TOPIC_GROUPS)})::BIGINT AS kw_groups FROM assignment""")
def _(t):
    return assignment(t).select("record_id", "block", "calibration", "reviewer_a", "reviewer_b", "key", F.md5("title").alias("title_md5"),
                                "doi", "abstract_source", "has_abstract", "kw_groups")


@query("first_sheet_load", f"""WITH {RECORDS_SQL}, {KEYED_SQL}, {ASSIGN_SQL}, s AS (
    SELECT 'r1' AS reviewer, source FROM assignment UNION ALL SELECT unnest(['r2', 'r3']), source FROM assignment WHERE calibration = 'Y')
  SELECT reviewer, source, count(*) AS n FROM s GROUP BY ALL""")
def _(t):
    return workflow.first_sheets(assignment(t)).groupBy("reviewer", "source").agg(F.count("*").alias("n"))


@query("pairs_assigned", f"""WITH {RECORDS_SQL}, {KEYED_SQL}, i AS (SELECT DISTINCT record_id FROM keyed),
  r AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS k FROM i)
  SELECT record_id, CASE k % 3 WHEN 0 THEN 'r1×r2' WHEN 1 THEN 'r1×r3' ELSE 'r2×r3' END AS pair,
    CASE WHEN (k // 3) % 2 = 0 THEN CASE k % 3 WHEN 2 THEN 'r2' ELSE 'r1' END ELSE CASE k % 3 WHEN 0 THEN 'r2' ELSE 'r3' END END AS extractor FROM r""")
def _(t):
    rows = keyed_records(t).select("record_id").distinct()
    return workflow.assign_pairs(rows, F.substring("record_id", 1, 6)).select("record_id", "pair", "extractor")


@query("pair_workload", f"""WITH {RECORDS_SQL}, {KEYED_SQL}, i AS (SELECT DISTINCT record_id FROM keyed),
  r AS (SELECT CASE (row_number() OVER (ORDER BY record_id) - 1) % 3 WHEN 0 THEN 'r1×r2' WHEN 1 THEN 'r1×r3' ELSE 'r2×r3' END AS pair FROM i)
  SELECT pair, reviewer, count(*) AS n FROM (SELECT pair, unnest(string_split(pair, '×')) AS reviewer FROM r) GROUP BY ALL""")
def _(t):
    rows = keyed_records(t).select("record_id").distinct()
    return workflow.workload(workflow.assign_pairs(rows, F.substring("record_id", 1, 6)), ["pair"])


@query("supplement", f"""WITH {RECORDS_SQL}, {KEYED_SQL}, k AS (SELECT DISTINCT record_id, record_key FROM keyed),
  c AS (SELECT record_id, {md5_modulo_sql("'cal:' || record_key", 100)} AS m FROM k)
  SELECT unnest(['r2', 'r3']) AS reviewer, record_id FROM c WHERE m >= 15 AND m < 20""")
def _(t):
    rows = keyed_records(t).select("record_id", "record_key").distinct()
    key = F.col("record_key")
    now = rows.withColumn("calibration", F.when(ids.is_calibration(key), "Y").otherwise("N"))
    had = rows.where(ids.is_calibration(key, 15)).withColumn("reviewer", F.explode(F.array(F.lit("r2"), F.lit("r3"))))
    return workflow.calibration_supplement(now, had, rows).select("reviewer", "record_id")


@query("sheet_fingerprints", """WITH s AS (SELECT doc_id // 500 AS sheet, 'D' || doc_id AS record_id, doc_id FROM documents)
  SELECT sheet, count(*) || ':' || substr(sha1(string_agg(record_id, chr(10) ORDER BY doc_id)), 1, 7) AS fingerprint FROM s GROUP BY sheet""")
def _(t):
    """Documents in sheets of at most 500 consecutive ids."""
    sheet = t.documents.select(F.floor(F.col("doc_id") / 500).alias("sheet"),
                               F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("record_id"), "doc_id")
    return workflow.fingerprints(sheet, ["sheet"], "doc_id")


@query("global_ranks", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders""")
def _(t):
    return skew.global_rank(t.orders.select("o_orderkey"), "o_orderkey", F.floor(F.col("o_orderkey") / 1_000_000))


@query("record_breaking", """SELECT event_id, user_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS breaks FROM events""")
def _(t):
    rows = t.events.select("event_id", "user_id", "value")
    return skew.record_breaking(rows, "user_id", "event_id", "value", 1000).select("event_id", "user_id", "breaks")


@query("contaminated_examples", """SELECT doc_id AS record_id, lang FROM documents WHERE n_chars < 700 AND doc_id IN (SELECT doc_id FROM labels)""")
def _(t):
    examples = t.documents.where("n_chars < 700").select(F.col("doc_id").alias("record_id"), "lang")
    return workflow.contamination(examples, t.labels.select(F.col("doc_id").alias("record_id")))


@query("branches_united", """SELECT 'database' AS branch, 'D' || doc_id AS record_id, source, '' AS seed FROM documents
  UNION ALL SELECT 'snowballing', 'C' || conv_id || '-' || turn, '', role FROM conversations""")
def _(t):
    database = t.documents.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("record_id"), "source")
    citation = t.conversations.select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("record_id"), F.col("role").alias("seed"))
    return workflow.union_branches(database, citation)


@query("reading_order", f"""WITH {RECORDS_SQL}, {KEYED_SQL}, {ASSIGN_SQL}, s AS (
    SELECT record_id, year::INT AS y, ({' + '.join(f'''{hits_sql("title || ' ' || abstract", p)}::INT''' for _, p in TOPIC_GROUPS)})::BIGINT AS kw_groups FROM assignment)
  SELECT record_id, kw_groups, row_number() OVER (ORDER BY kw_groups DESC, y DESC, record_id) AS place FROM s""")
def _(t):
    """The lead's reading list; the place is a number over groups small enough to rank apart."""
    sheet = cut(assignment(t).select("record_id", "kw_groups", F.col("year").cast("int").alias("y")))
    order = F.concat((9 - F.col("kw_groups")).cast("string"), F.lpad((9999 - F.col("y")).cast("string"), 4, "0"), "record_id")
    keyed = sheet.withColumn("order", order)
    return skew.global_rank(keyed, "order", F.substring("order", 1, 10)).select(
        "record_id", "kw_groups", (F.col("rank") + 1).alias("place"))


@query("overlap_of_runs", """WITH a AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE role = 'user'), b AS (SELECT DISTINCT doc_id AS id FROM labels)
  SELECT id FROM a INTERSECT SELECT id FROM b""")
def _(t):
    return t.conversations.where("role = 'user'").select(F.col("conv_id").alias("id")).intersect(t.labels.select(F.col("doc_id").alias("id")))


