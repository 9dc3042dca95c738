"""Gold-set audits, titles in documents, quotations in paged text.

Labelled documents are the gold set: good ones with their DOI, others with a blank, wrong
or misspelt entry. Benchmark passages are titles to find in documents; conversations are
paged texts.
"""

from pyspark.sql import functions as F

from sievelake.operators import documents, gold, quotes
from sievelake.plans.dedup_queries import GREEDY_SQL
from sievelake.plans.records import RECORDS_SQL, norm_title_sql, records
from sievelake.plans import quote_sql as sql
from sievelake.plans.registry import query
from sievelake.operators import dedup
from sievelake.session import cut

GOLD_SQL = """gold AS (
  SELECT r.ord AS id,
    CASE WHEN quality = 0 AND toxic = 0 THEN '' WHEN toxic = 1 AND quality = 0 THEN '10.9999/' || r.key
      ELSE 'https://doi.org/' || upper(doi) END AS doi,
    CASE WHEN source IN ('src1', 'src2') THEN reverse(title) WHEN source IN ('src3', 'src4', 'src5') THEN title || ' x'
      ELSE title END AS title,
    CASE WHEN lang = 'es' THEN 'background' ELSE 'in-scope' END AS scope
  FROM labels JOIN records r ON r.ord = labels.doc_id)"""


def gold_items(t):
    quality, toxic = F.col("quality"), F.col("toxic")
    return t.labels.join(records(t), F.col("doc_id") == F.col("ord")).select(
        F.col("ord").alias("id"),
        F.when((quality == 0) & (toxic == 0), "").when((toxic == 1) & (quality == 0), F.concat(F.lit("10.9999/"), "key"))
        .otherwise(F.concat(F.lit("https://doi.org/"), F.upper("doi"))).alias("doi"),
        F.when(F.col("source").isin("src1", "src2"), F.reverse("title"))
        .when(F.col("source").isin("src3", "src4", "src5"), F.concat("title", F.lit(" x"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("lang") == "es", "background").otherwise("in-scope").alias("scope"))


def norm_doi_sql(c):
    return f"regexp_replace(regexp_replace(lower(trim({c})), '^(?:https?://)?(?:dx\\.)?doi\\.org/', ''), '^doi:\\s*', '')"


MATCH_SQL = f"""asked AS (
    SELECT id, {norm_doi_sql('doi')} AS g_doi, {norm_title_sql('title')} AS g_title, unnest(['step0', 'step1']) AS stage
    FROM gold WHERE scope <> 'background' AND trim(title) <> ''),
  held AS (
    SELECT stage, ord, {norm_doi_sql('doi')} AS c_doi, {norm_title_sql('title')} AS c_title FROM (
      SELECT 'step0' AS stage, ord, doi, title FROM records UNION ALL
      SELECT 'step1', ord, doi, title FROM records WHERE ord IN (SELECT ord FROM verdicts WHERE kept))),
  by_doi AS (SELECT stage, c_doi, min(ord) AS ord, arg_min(c_title, ord) AS found FROM held WHERE c_doi <> '' GROUP BY ALL),
  by_title AS (SELECT stage, c_title, min(ord) AS ord, arg_min(c_doi, ord) AS found FROM held WHERE c_title <> '' GROUP BY ALL),
  matches AS (
    SELECT a.id, a.stage, a.g_doi, a.g_title, CASE
      WHEN d.ord IS NOT NULL THEN CASE WHEN g_title <> '' AND d.found <> '' AND d.found <> g_title THEN
          CASE WHEN 1 - levenshtein(g_title, d.found)::DOUBLE / greatest(length(g_title), length(d.found)) < 0.6::DOUBLE
            THEN 'SUSPECT' ELSE 'DOI(表記差)' END ELSE 'DOI' END
      WHEN t.ord IS NOT NULL THEN CASE WHEN g_doi <> '' AND t.found <> '' AND t.found <> g_doi THEN 'SUSPECT' ELSE 'TITLE' END
      ELSE 'NONE' END AS method, coalesce(d.ord, t.ord) AS found_ord
    FROM asked a LEFT JOIN by_doi d ON a.stage = d.stage AND a.g_doi = d.c_doi
      LEFT JOIN by_title t ON a.stage = t.stage AND a.g_title = t.c_title)"""


def stage_corpus(t):
    rows = records(t)
    kept = dedup.greedy_dedup(rows).where("kept").select("ord")
    first = rows.select(F.lit("step0").alias("stage"), "ord", "doi", "title")
    second = rows.join(kept, "ord", "left_semi").select(F.lit("step1").alias("stage"), "ord", "doi", "title")
    return cut(first.unionByName(second))


@query("gold_matches", f"""WITH RECURSIVE {GREEDY_SQL}, {GOLD_SQL}, {MATCH_SQL}
  SELECT id, stage, method, found_ord FROM matches""")
def _(t):
    return gold.match_stages(gold.in_scope(gold_items(t)), stage_corpus(t), ["step0", "step1"]).select(
        "id", "stage", "method", "found_ord")


NEAR_SQL = """titles AS (SELECT stage, c_title, min(ord) AS first_ord FROM held WHERE c_title <> '' GROUP BY ALL),
  near AS (SELECT m.id, m.stage, t.c_title, t.first_ord, m.g_title, greatest(length(m.g_title), length(t.c_title)) AS n
    FROM matches m JOIN titles t ON m.stage = t.stage AND abs(length(m.g_title) - length(t.c_title)) <=
      floor(greatest(length(m.g_title), length(t.c_title)) * (1 - 0.9::DOUBLE)) WHERE m.method = 'NONE' AND m.g_title <> ''),
  scored AS (SELECT *, levenshtein(g_title, c_title) AS d FROM near),
  placed AS (SELECT *, row_number() OVER (PARTITION BY id, stage ORDER BY 1 - d::DOUBLE / n DESC, first_ord) AS p
    FROM scored WHERE d <= floor(n * (1 - 0.9::DOUBLE)))"""


@query("gold_stage_recall", f"""WITH RECURSIVE {GREEDY_SQL}, {GOLD_SQL}, {MATCH_SQL}, {NEAR_SQL}
  SELECT stage, count(*) AS items, count(*) FILTER (WHERE method IN ('DOI', 'DOI(表記差)', 'TITLE')) AS survivors,
    (SELECT count(DISTINCT p.id) FROM placed p WHERE p.stage = matches.stage) AS fuzzy, count(*) FILTER (WHERE method = 'SUSPECT') AS suspects,
    round(count(*) FILTER (WHERE method IN ('DOI', 'DOI(表記差)', 'TITLE')) / count(*), 6) AS recall
  FROM matches GROUP BY stage""")
def _(t):
    corpus = stage_corpus(t)
    matches = cut(gold.match_stages(gold.in_scope(gold_items(t)), corpus, ["step0", "step1"]))
    return gold.stage_recall(gold.with_candidates(matches, corpus))


@query("gold_fuzzy_titles", f"""WITH RECURSIVE {GREEDY_SQL}, {GOLD_SQL}, {MATCH_SQL},
  {NEAR_SQL}
  SELECT id, stage, string_agg(c_title || ' (lev=' || printf('%.3f', 1 - d::DOUBLE / n) || ')', ' || ' ORDER BY p) AS candidates
  FROM placed WHERE p <= 3 GROUP BY id, stage""")
def _(t):
    corpus = stage_corpus(t)
    lost = cut(gold.match_stages(gold.in_scope(gold_items(t)), corpus, ["step0", "step1"]).where("method = 'NONE' AND g_title <> ''"))
    return gold.fuzzy_candidates(lost, corpus)


@query("known_item_table")
def _(t):
    """Survival per stage of the whole funnel, with the first drop stage and its reason."""
    from sievelake.plans.funnel_queries import STAGES, funnel

    rows = funnel(t)
    held = cut(rows.select(
        F.explode(F.slice(F.array(*[F.lit(s) for s in STAGES]), F.lit(1), F.col("last_stage") + 1)).alias("stage"),
        "ord", "doi", "title"))
    reason = F.when(F.col("stage") == "step0", "統合生データに不在 = 検索式で拾えていない").otherwise(
        F.concat(F.lit("dropped at "), F.col("stage")))
    return gold.known_item_table(gold.in_scope(gold_items(t)), held, STAGES, reason)


@query("gold_sources", f"""WITH {RECORDS_SQL}, {GOLD_SQL}, asked AS (
    SELECT id, {norm_doi_sql('doi')} AS g_doi, {norm_title_sql('title')} AS g_title FROM gold WHERE scope <> 'background'),
  held AS (SELECT source, ord, doi AS c_doi, {norm_title_sql('title')} AS c_title FROM records),
  bd AS (SELECT source, c_doi, arg_min(c_title, ord) AS found FROM held WHERE c_doi <> '' GROUP BY ALL),
  bt AS (SELECT source, c_title, arg_min(c_doi, ord) AS found FROM held WHERE c_title <> '' GROUP BY ALL),
  v AS (SELECT a.id, s.source, CASE WHEN bd.found IS NOT NULL THEN NOT (g_title <> '' AND bd.found <> '' AND bd.found <> g_title AND
        1 - levenshtein(g_title, bd.found)::DOUBLE / greatest(length(g_title), length(bd.found)) < 0.6::DOUBLE)
      WHEN bt.found IS NOT NULL THEN NOT (g_doi <> '' AND bt.found <> '' AND bt.found <> g_doi) ELSE false END AS ok
    FROM asked a CROSS JOIN (SELECT DISTINCT source FROM records) s
    LEFT JOIN bd ON bd.source = s.source AND bd.c_doi = a.g_doi LEFT JOIN bt ON bt.source = s.source AND bt.c_title = a.g_title)
  SELECT id, string_agg(source, '; ' ORDER BY source) AS sources FROM v WHERE ok GROUP BY id""")
def _(t):
    corpus = records(t).select(F.col("source").alias("stage"), "ord", "doi", "title")
    return gold.holding_sources(gold.in_scope(gold_items(t)), corpus)


PROVIDER_SQL = """CASE split_part(doi, '/', 1) WHEN '10.1145' THEN 'ACM' WHEN '10.1109' THEN 'IEEE' ELSE 'other' END"""


@query("gold_coverage", f"""WITH {RECORDS_SQL}, {GOLD_SQL}, asked AS (
    SELECT id, lower(regexp_extract(doi, '10\\.\\d{{4,9}}/\\S+')) AS g_doi, {norm_title_sql('title')} AS g_title,
      CASE split_part(regexp_extract(doi, '10\\.\\d{{4,9}}/\\S+'), '/', 1) WHEN '10.1145' THEN 'ACM' WHEN '10.1109' THEN 'IEEE' ELSE 'other' END AS provider
    FROM gold WHERE scope <> 'background'),
  held AS (SELECT source || '.csv' AS file, CASE lang WHEN 'en' THEN 'IEEE' WHEN 'fr' THEN 'ACM' ELSE 'other' END AS provider, ord, doi AS c_doi,
    {norm_title_sql('title')} AS c_title FROM records),
  files AS (SELECT DISTINCT file, provider FROM held),
  bd AS (SELECT file, c_doi FROM held WHERE c_doi <> '' GROUP BY ALL),
  bt AS (SELECT file, c_title, arg_max(c_doi, ord) AS found FROM held WHERE c_title <> '' GROUP BY ALL)
  SELECT a.id, f.file, a.provider, CASE WHEN bd.c_doi IS NOT NULL THEN 'HIT' WHEN bt.c_title IS NULL THEN 'MISS'
    WHEN g_doi <> '' AND bt.found <> '' AND bt.found <> g_doi THEN 'SUSPECT' ELSE 'HIT' END AS verdict
  FROM asked a JOIN files f USING (provider) LEFT JOIN bd ON bd.file = f.file AND bd.c_doi = a.g_doi
    LEFT JOIN bt ON bt.file = f.file AND bt.c_title = a.g_title""")
def _(t):
    provider = F.when(F.col("lang") == "en", "IEEE").when(F.col("lang") == "fr", "ACM").otherwise("other")
    corpus = records(t).select(F.concat("source", F.lit(".csv")).alias("file"), provider.alias("provider"), "ord", "doi", "title")
    return gold.coverage(gold.in_scope(gold_items(t)), corpus)


@query("gold_coverage_all", f"""WITH {RECORDS_SQL}, {GOLD_SQL}, asked AS (
    SELECT id, lower(regexp_extract(doi, '10\\.\\d{{4,9}}/\\S+')) AS g_doi, {norm_title_sql('title')} AS g_title FROM gold WHERE scope <> 'background'),
  held AS (SELECT ord, doi AS c_doi, {norm_title_sql('title')} AS c_title FROM records),
  bd AS (SELECT DISTINCT c_doi FROM held WHERE c_doi <> ''),
  bt AS (SELECT c_title, arg_max(c_doi, ord) AS found FROM held WHERE c_title <> '' GROUP BY ALL),
  v AS (SELECT a.id, CASE WHEN bd.c_doi IS NOT NULL THEN 'HIT' WHEN bt.c_title IS NULL THEN 'MISS'
    WHEN g_doi <> '' AND bt.found <> '' AND bt.found <> g_doi THEN 'SUSPECT' ELSE 'HIT' END AS verdict
    FROM asked a LEFT JOIN bd ON bd.c_doi = a.g_doi LEFT JOIN bt ON bt.c_title = a.g_title)
  SELECT verdict, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM v)::DOUBLE, 1) AS percent FROM v GROUP BY verdict""")
def _(t):
    """Gold items against all files together, and the share of each verdict."""
    corpus = records(t).select(F.concat("source", F.lit(".csv")).alias("file"), F.lit("any").alias("provider"), "ord", "doi", "title")
    verdicts = cut(gold.coverage(gold.in_scope(gold_items(t)), corpus, per_file=False))
    total = verdicts.agg(F.count("*").alias("n"))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("percent", F.round(F.col("n") * 100 / total.scalar(), 1))


SHEET_SQL = """sheet AS (SELECT ord, 'R' || substr(md5(doi || title), 1, 9) AS record_id, doi, title,
    CASE WHEN lang = 'en' THEN 'database' ELSE 'snowballing' END AS source, CASE WHEN n_chars < 1500 THEN 'Y' ELSE 'N' END AS calibration,
    CASE WHEN abstract = '' THEN 'N' ELSE 'Y' END AS has_abstract FROM records WHERE source <> 'src7'),
  bd AS (SELECT doi, max(ord) AS ord FROM sheet WHERE doi <> '' GROUP BY doi),
  bt AS (SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS t, max(ord) AS ord FROM sheet GROUP BY 1)"""


def gold_sheet(t):
    return records(t).where("source <> 'src7'").select(
        "ord", F.concat(F.lit("R"), F.substring(F.md5(F.concat("doi", "title")), 1, 9)).alias("record_id"), "doi", "title",
        F.when(F.col("lang") == "en", "database").otherwise("snowballing").alias("source"),
        F.when(F.col("n_chars") < 1500, "Y").otherwise("N").alias("calibration"),
        F.when(F.col("abstract") == "", "N").otherwise("Y").alias("has_abstract"))


IN_SHEET_SQL = f"""WITH {RECORDS_SQL}, {GOLD_SQL}, {SHEET_SQL},
  found AS (SELECT g.id, bd.ord AS d, bt.ord AS t FROM gold g LEFT JOIN bd ON bd.doi = {norm_doi_sql('g.doi')}
    LEFT JOIN bt ON bt.t = regexp_replace(lower(g.title), '[^a-z0-9]+', '', 'g')),
  named AS (SELECT f.id, CASE WHEN s.ord IS NULL THEN 'N' ELSE 'Y' END AS in_screening,
    CASE WHEN d IS NOT NULL THEN 'DOI' WHEN t IS NOT NULL THEN 'title' ELSE '—' END AS match_method,
    coalesce(s.record_id, '') AS record_id, coalesce(s.source, '') AS source, coalesce(s.calibration, '') AS calibration,
    coalesce(s.has_abstract, '') AS has_abstract FROM found f LEFT JOIN sheet s ON s.ord = coalesce(d, t))"""


@query("gold_in_sheet", f"{IN_SHEET_SQL} SELECT * FROM named")
def _(t):
    return gold.gold_in_sheet(gold_items(t), gold_sheet(t))


@query("gold_sheet_coverage", f"""{IN_SHEET_SQL} SELECT source, count(*) AS items,
    count(*) FILTER (WHERE calibration = 'Y') AS in_calibration, round(count(*) / (SELECT count(*) FROM named), 6) AS share
  FROM named WHERE in_screening = 'Y' GROUP BY source""")
def _(t):
    return gold.sheet_coverage(gold.gold_in_sheet(gold_items(t), gold_sheet(t)))


@query("wave_recall", """WITH items AS (
    SELECT text, string_agg(DISTINCT source || CASE WHEN lang = 'en' THEN '(wave2)' ELSE '' END, '; ') AS sources FROM documents GROUP BY text),
  toks AS (SELECT list_filter(string_split(sources, ';'), lambda x: trim(x) <> '') AS w FROM items)
  SELECT 'wave 1' AS wave, count(*) FILTER (WHERE len(list_filter(w, lambda x: NOT contains(x, 'wave2'))) > 0) AS survivors FROM toks
  UNION ALL SELECT 'wave 2', count(*) FILTER (WHERE len(list_filter(w, lambda x: contains(x, 'wave2'))) > 0) FROM toks""")
def _(t):
    label = F.concat("source", F.when(F.col("lang") == "en", "(wave2)").otherwise(""))
    # Sources and languages are few, so a set of labels per text is small.
    items = t.documents.groupBy("text").agg(F.array_join(F.collect_set(label), "; ").alias("sources"))
    tokens = F.filter(F.split("sources", ";"), lambda x: F.trim(x) != "")
    return gold.wave_recall(items, {
        "wave 1": F.exists(tokens, lambda x: ~x.contains("wave2")),
        "wave 2": F.exists(tokens, lambda x: x.contains("wave2")),
    })


@query("titles_in_documents", f"""WITH docs AS (
    SELECT doc_id, {norm_title_sql("regexp_replace(text, '-' || chr(10) || '([a-z])', '\\1', 'g')")} AS t FROM documents),
  d AS (SELECT doc_id, t, string_split(t, ' ') AS toks FROM docs),
  wanted AS (SELECT item_id, string_split({norm_title_sql('text')}, ' ') AS w, {norm_title_sql('text')} AS title FROM benchmark),
  pairs AS (SELECT d.doc_id, w.item_id, d.toks, w.w, length(w.title) >= 20 AND contains(' ' || d.t || ' ', ' ' || w.title || ' ') AS phrase,
      len(list_filter(w.w, lambda x: list_contains(d.toks, x)))::DOUBLE / len(w.w) AS share
    FROM d CROSS JOIN wanted w),
  level AS (SELECT doc_id, item_id, CASE WHEN phrase THEN 1 WHEN len(w) >= 5 AND share >= 0.9::DOUBLE AND
      len(list_filter(range(1, greatest(1, len(toks) - (len(w) + 5) + 1) + 1),
        lambda i: len(list_intersect(list_distinct(w), toks[i:i + len(w) + 4]))::DOUBLE / len(list_distinct(w)) >= 0.9::DOUBLE)) > 0
      THEN 2 END AS level FROM pairs WHERE phrase OR share >= 0.9::DOUBLE),
  best AS (SELECT doc_id, level, count(*) AS n, min(item_id) AS item_id FROM level WHERE level IS NOT NULL GROUP BY ALL),
  chosen AS (SELECT doc_id, min(level) AS level, arg_min(n, level) AS n, arg_min(item_id, level) AS item_id FROM best GROUP BY doc_id)
  SELECT documents.doc_id, CASE WHEN n = 1 THEN item_id END AS record_id, CASE WHEN n IS NULL THEN '該当なし' WHEN n > 1 THEN '候補が複数'
    WHEN level = 1 THEN 'タイトル一致' ELSE 'タイトル語の一致' END AS how, coalesce(n, 0)::BIGINT AS candidates
  FROM documents LEFT JOIN chosen USING (doc_id)""")
def _(t):
    wanted = t.benchmark.select(F.col("item_id").alias("record_id"), F.col("text").alias("title"),
                                F.concat(F.lit("10.5555/"), F.md5("text")).alias("doi"))
    docs = t.documents.select("doc_id", "text", F.col("text").alias("first_page"))
    return documents.titles_in_documents(docs, wanted)


# --- quotations in conversations: a conversation is a record, a turn a page ----------------------

FIELDS = ["opening", "closing", "whole", "absent"]


def turn_pages(t):
    return t.conversations.select(F.col("conv_id").alias("record_id"), F.col("turn").cast("int").alias("page"), "text")


def turn_quotes(t):
    """Quotations of every turn: its first sentence, its last line, the whole text on the wrong
    page, and its end joined with the next turn's beginning."""
    text = F.col("text")
    follows = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    rows = t.conversations.join(follows, ["conv_id", "turn"], "left")
    lines = F.split(text, "\n")
    first = F.concat(F.substring_index(text, ".", 1), F.lit("."))
    last = F.upper(F.element_at(lines, -1))
    crossing = F.concat(F.element_at(lines, -1), F.lit(" "), F.substring_index("next", "\n", 1))
    quote = F.array(
        F.struct(F.lit("opening").alias("field"), first.alias("quote"), F.col("turn").alias("page")),
        F.struct(F.lit("closing").alias("field"), last.alias("quote"), F.col("turn").alias("page")),
        F.struct(F.lit("whole").alias("field"), F.regexp_replace(text, r"\s+", "").alias("quote"), (F.col("turn") + 1).alias("page")),
        F.struct(F.lit("absent").alias("field"), F.concat(F.coalesce(crossing, F.reverse(text))).alias("quote"), F.col("turn").alias("page")),
    )
    return rows.select(
        F.col("conv_id").alias("record_id"), F.col("turn"), F.explode(quote).alias("q")
    ).select(
        F.concat_ws("-", F.col("record_id").cast("string"), F.col("turn").cast("string"), "q.field").alias("quote_id"),
        "record_id", F.col("q.field").alias("field"), F.col("q.page").cast("int").alias("page"), F.col("q.quote").alias("quote"))


@query("quote_spans", f"WITH {sql.QUOTES_SQL}, {sql.LOCATED_SQL} SELECT * FROM located")
def _(t):
    return quotes.locate_quotes(turn_quotes(t), turn_pages(t))


@query("quote_status_counts", sql.STATUS_SQL)
def _(t):
    asked = cut(turn_quotes(t))
    return quotes.verify_quotes(asked, turn_pages(t)).join(asked.select("quote_id", "field"), "quote_id").groupBy(
        "field", "status").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("loose").alias("loose"))


RUNS_SQL = """runs AS (
  SELECT conv_id AS record_id, role AS field, 'run' || (turn % 3 + 1) AS run, split_part(text, chr(10), 1) AS quote FROM conversations
  UNION ALL SELECT conv_id, role, unnest(['run1', 'run2', 'run3']), split_part(text, '.', 1) FROM conversations)"""


def run_quotes(t):
    field = F.col("role").alias("field")
    record = F.col("conv_id").alias("record_id")
    one = t.conversations.select(record, field, F.concat(F.lit("run"), (F.col("turn") % 3 + 1).cast("string")).alias("run"),
                                 F.substring_index("text", "\n", 1).alias("quote"), F.col("turn").cast("int").alias("page"))
    every = t.conversations.select(record, field, F.explode(F.array(F.lit("run1"), F.lit("run2"), F.lit("run3"))).alias("run"),
                                   F.substring_index("text", ".", 1).alias("quote"), F.col("turn").cast("int").alias("page"))
    return one.unionByName(every)


@query("run_stability", f"""WITH {RUNS_SQL}, q AS (
    SELECT record_id, field, regexp_replace(lower(quote), '\\s+', '', 'g') AS q, bool_or(run = 'run1') AS r1, bool_or(run = 'run2') AS r2,
      bool_or(run = 'run3') AS r3 FROM runs GROUP BY ALL)
  SELECT record_id, field, bool_and(r1 AND r2 AND r3) AS identical, count(*) FILTER (WHERE r1 AND r2 AND r3) AS n_common, count(*) AS n_union,
    count(*) FILTER (WHERE r1) AS n_run1, count(*) FILTER (WHERE r2) AS n_run2, count(*) FILTER (WHERE r3) AS n_run3
  FROM q GROUP BY record_id, field""")
def _(t):
    return quotes.run_stability(run_quotes(t), ["run1", "run2", "run3"])


def run_agreement(t):
    asked = cut(run_quotes(t).withColumn("quote_id", F.concat_ws("|", F.col("record_id").cast("string"), "field", "run",
                                                               F.col("page").cast("string"), F.md5("quote"))).distinct())
    spans = quotes.locate_quotes(asked.select("quote_id", "record_id", "page", "quote").distinct(), turn_pages(t))
    placed = asked.join(spans.where("start IS NOT NULL"), "quote_id")
    return quotes.span_agreement(placed.select("record_id", "field", "run", "start", "stop"),
                                 asked.select("record_id", "field").distinct(), ["run1", "run2", "run3"])


@query("span_agreement", f"WITH {sql.AGREEMENT_SQL} SELECT record_id, field, round(jaccard, 6) AS jaccard, shared, empty_all FROM agreement")
def _(t):
    return run_agreement(t).withColumn("jaccard", F.round("jaccard", 6))


@query("span_summary", sql.SUMMARY_SQL)
def _(t):
    return quotes.field_summary(run_agreement(t))


@query("field_gaps", """WITH a AS (
    SELECT conv_id, turn, role, CASE WHEN strlen(text) < 200 THEN NULL WHEN contains(text, chr(10)) THEN 'both' ELSE 'one' END AS kind FROM conversations)
  SELECT conv_id || '-' || turn AS record_id, role AS run, '' AS field, 'PARSE_ERROR' AS status FROM a WHERE kind IS NULL
  UNION ALL SELECT conv_id || '-' || turn, role, 'closing', 'EMPTY' FROM a WHERE kind = 'one'
  UNION ALL SELECT conv_id || '-' || turn, role, 'whole', 'MISSING_KEY' FROM a WHERE kind IS NOT NULL""")
def _(t):
    many = F.contains("text", F.lit("\n"))
    first = F.array(F.substring_index("text", "\n", 1))
    none = F.array().cast("array<string>")
    fields = F.when(F.octet_length("text") >= 200, F.create_map(
        F.lit("opening"), first, F.lit("closing"), F.when(many, F.array(F.element_at(F.split("text", "\n"), -1))).otherwise(none)))
    answers = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"),
        F.col("role").alias("run"), fields.alias("fields"))
    return quotes.field_gaps(answers, ["opening", "closing", "whole"])
