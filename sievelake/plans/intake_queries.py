"""Queries that write files and read them back: exports, aliased columns, stages, logs, guarded tables."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sievelake.functions import labels
from sievelake.operators import workflow
from sievelake.plans.records import RECORDS_SQL, TOPIC_EXCLUSIONS, norm_title_sql, records
from sievelake.plans.registry import query
from sievelake.plans.text_queries import HAYSTACK, categories_sql, keyword_rows, keywords_sql
from sievelake.session import shared_folder
from sievelake.sources import readers, sinks
from sievelake.streaming import inbox


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.documents.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("exports_read", """SELECT 'ACM(wave2)' AS "Source_DB", doc_id::VARCHAR AS id, lang, split_part(text, chr(10), 1) AS title, '' AS role FROM documents
  UNION ALL SELECT 'IEEE', conv_id::VARCHAR, '', '', role FROM conversations
  UNION ALL SELECT 'my list', event_id::VARCHAR, '', '', event_type FROM events""")
def _(t):
    """Exports of different columns, written as CSV and read as one table; the fourth is one to skip."""
    exports = {
        "ACM_wave2_20260803.csv": t.documents.select(F.col("doc_id").alias("id"), "lang", F.substring_index("text", "\n", 1).alias("title")),
        "ieee.csv": t.conversations.select(F.col("conv_id").alias("id"), "role"),
        "my list.csv": t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("role")),
        "pubmed.csv": t.labels.select(F.col("doc_id").alias("id")),
    }
    folder = _folder(t, "exports")
    for name, rows in exports.items():
        rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}")
    rows = readers.concat_exports(t.documents.sparkSession, [f"{folder}/{name}" for name in exports])
    return rows.select("Source_DB", "id", "lang", "title", "role")


@query("bibtex_files", f"""WITH {RECORDS_SQL}, e AS (SELECT key, ord, '@article{{' || key || ',' || chr(10) || '  title={{' || md5(title) || '}}}}' || chr(10) AS body FROM records)
  SELECT key AS entry_key, md5(arg_min(body, ord)) AS body_md5, count(*) AS copies, count(DISTINCT body) > 1 AS conflict FROM e GROUP BY key""")
def _(t):
    """Records written as large BibTeX files, some with no line break between entries, read in blocks and merged."""
    folder = _folder(t, "bibtex")
    entry = F.concat(F.lit("@article{"), "key", F.lit(",\n  title={"), F.md5("title"), F.lit("}}"))
    gap = F.when(F.col("ord") % 2 == 0, "").otherwise("\n")
    records(t).repartitionByRange("ord").sortWithinPartitions("ord").select(F.concat(entry, gap)).write.option("lineSep", " ").text(folder)
    merged = readers.merge_bibtex(readers.read_bibtex(t.documents.sparkSession, folder))
    return merged.select("entry_key", F.md5("body").alias("body_md5"), "copies", "conflict")


@query("pages_files", r"""SELECT doc_id::INT AS page, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""")
def _(t):
    """Documents written as the pages of large texts, read in blocks and split."""
    folder = _folder(t, "pages")
    t.documents.select(F.concat(F.lit("[p."), F.col("doc_id").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))).write.option("lineSep", "\n").text(folder)
    pages = readers.read_pages(t.documents.sparkSession, folder)
    return pages.select("page", F.md5(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text_md5"))


@query("columns_resolved", """SELECT doc_id AS ord, source AS title, lang AS abstract, lang AS venue, '10.1/' || doc_id AS doi, '' AS key, '' AS issn FROM documents""")
def _(t):
    """The first accepted name of each column that the table has; one it lacks is blank."""
    wanted = readers.RECORD_COLUMNS
    rows = t.documents.select(
        F.col("doc_id").alias("ord"), F.col("source").alias("Title"), F.col("lang").alias("Abstract Note"),
        F.col("text").alias("AbstractNote"), F.col("lang").alias(wanted["venue"][-1]), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias(wanted["doi"][0]))
    return readers.resolve_columns(rows, wanted)


@query("stage_written", """SELECT doc_id, lang, CASE WHEN n_chars < 900 THEN 'excluded' ELSE 'included' END AS decision FROM documents""")
def _(t):
    """A stage's table, written by decision and read again."""
    rows = t.documents.select("doc_id", "lang", "source", F.when(F.col("n_chars") < 900, "excluded").otherwise("included").alias("decision"))
    path = _folder(t, "stage")
    sinks.write_stage(rows, path, columns=["doc_id", "lang", "absent"])
    return t.documents.sparkSession.read.parquet(path)


@query("log_appended", """SELECT 'log' AS kind, lang, count(*) * 2 AS n FROM documents GROUP BY lang
  UNION ALL SELECT 'kept', lang, 2 FROM documents GROUP BY lang UNION ALL SELECT 'forced', lang, count(*) FROM documents GROUP BY lang""")
def _(t):
    """A log takes rows of its own columns only; a table that people fill in is replaced only by force."""
    spark, counted = t.documents.sparkSession, t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    log, kept, forced = (_folder(t, name) for name in ("log", "kept", "forced"))
    sinks.append_log(counted, log)
    sinks.append_log(counted, log)
    try:
        sinks.append_log(counted.withColumnRenamed("n", "other"), log)
        raise AssertionError("a log took other columns")
    except ValueError:
        pass
    for path in (kept, forced):
        sinks.write_guarded(counted.withColumn("n", F.lit(2).cast("bigint")), path)
    try:
        sinks.write_guarded(counted, kept)
        raise AssertionError("a guarded table was replaced")
    except AnalysisException:
        pass
    sinks.write_guarded(counted, forced, force=True)
    read = lambda kind, path: spark.read.parquet(path).groupBy("lang").agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "lang", "n")
    return read("log", log).unionByName(read("kept", kept)).unionByName(read("forced", forced))


@query("consensus_order", """WITH c AS (SELECT 'C' || lpad(conv_id::VARCHAR, 9, '0') AS record_id, count(DISTINCT role) AS n_distinct FROM conversations GROUP BY 1)
  SELECT record_id, n_distinct, row_number() OVER (ORDER BY n_distinct DESC, record_id) AS place FROM c""")
def _(t):
    """Conversations by how many roles they have, as votes."""
    votes = t.conversations.select(F.concat(F.lit("C"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("record_id"), F.col("role").alias("decision"))
    return workflow.consensus_order(votes)


@query("keyword_reasons", f"""WITH {RECORDS_SQL}, k AS (SELECT ord, array_to_string({categories_sql(HAYSTACK, TOPIC_EXCLUSIONS)}, ' | ') AS categories,
    array_to_string({keywords_sql(HAYSTACK, TOPIC_EXCLUSIONS)}, ' | ') AS keywords FROM records)
  SELECT ord, '除外キーワード命中: [' || categories || '] ' || keywords AS reason FROM k WHERE categories <> ''""")
def _(t):
    rows = keyword_rows(t, TOPIC_EXCLUSIONS).where("categories <> ''")
    return rows.select("ord", labels.keyword_drop_reason(F.col("categories"), F.col("keywords")).alias("reason"))


# --- the inbox: every document is a file that is looked at several times ---------------------------

START = "2026-01-01 00:00:00"
#: Per document its states in the order in which they settle: number, text, size, second of the second equal look.
STATES_SQL = """states AS (
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(text, length(text) // 2) ELSE text END AS text,
      CASE WHEN doc_id % 3 = 0 THEN length(text) // 2 ELSE length(text) END + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size,
      doc_id % 40 * 60 + CASE WHEN doc_id % 7 = 0 THEN 40 ELSE 20 END AS settled FROM documents
    UNION ALL SELECT doc_id, text, length(text) + 1000000, 3620 + doc_id % 40 * 60 FROM documents WHERE doc_id % 3 = 0)"""


def document_looks(t):
    """`LOOK` rows with `second`: a third of the documents come in halves first, a seventh grows between two looks."""
    whole = F.char_length("text")
    half = F.col("doc_id") % 3 == 0
    size = F.when(half, F.floor(whole / 2)).otherwise(whole).cast("long")
    minute = F.col("doc_id") % 40 * 60
    part = F.when(half, F.expr("left(text, cast(floor(char_length(text) / 2) AS int))")).otherwise(F.col("text"))
    look = lambda second, n, text: F.struct(second.cast("long").alias("second"), n.cast("long").alias("size"), text.alias("text"))
    grows = F.col("doc_id") % 7 == 0
    early = [look(minute, size, part), look(minute + 20, size + grows.cast("int"), part)]
    more = F.when(grows, F.array(look(minute + 40, size + 1, part))).otherwise(F.array().cast("array<struct<second: bigint, size: bigint, text: string>>"))
    late = F.when(half, F.array(*[look(3600 + k + minute, whole + 1000000, F.col("text")) for k in (0, 20)])).otherwise(
        F.array().cast("array<struct<second: bigint, size: bigint, text: string>>"))
    rows = t.documents.select("doc_id", F.explode(F.concat(F.array(*early), more, late)).alias("l"))
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + s)
    return rows.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("l.size").alias("size"),
                       at(F.lit(0)).alias("modified"), at(F.col("l.second")).alias("seen_at"), F.col("l.text").alias("text"),
                       F.col("l.text").alias("first_page"), F.col("l.second").alias("second"))


@query("inbox_verdicts", f"""WITH RECURSIVE {STATES_SQL},
  d AS (SELECT doc_id, size, settled, {norm_title_sql("regexp_replace(text, '-' || chr(10) || '([a-z])', '\\1', 'g')")} AS t FROM states),
  docs AS (SELECT *, string_split(t, ' ') AS toks FROM d),
  wanted AS (SELECT item_id, string_split({norm_title_sql('text')}, ' ') AS w, {norm_title_sql('text')} AS title FROM benchmark),
  pairs AS (SELECT d.doc_id, d.size, d.settled, w.item_id, d.toks, w.w, length(w.title) >= 20 AND contains(' ' || d.t || ' ', ' ' || w.title || ' ') AS phrase,
      len(list_filter(w.w, lambda x: list_contains(d.toks, x)))::DOUBLE / len(w.w) AS share FROM docs d CROSS JOIN wanted w),
  level AS (SELECT doc_id, size, settled, item_id, CASE WHEN phrase THEN 1 WHEN len(w) >= 5 AND
      len(list_filter(range(1, greatest(1, len(toks) - (len(w) + 5) + 1) + 1),
        lambda i: len(list_intersect(list_distinct(w), toks[i:i + len(w) + 4]))::DOUBLE / len(list_distinct(w)) >= 0.9::DOUBLE)) > 0
      THEN 2 END AS level FROM pairs WHERE phrase OR share >= 0.9::DOUBLE),
  fits AS (SELECT doc_id, size, settled, list(item_id * 10 + level) AS found, row_number() OVER (ORDER BY settled, 'f' || doc_id || '.txt') AS k
    FROM level WHERE level IS NOT NULL GROUP BY doc_id, size, settled),
  -- One file after the other; what an earlier one took is closed.
  turns AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS item, 0::BIGINT AS level, 0::BIGINT AS n
    UNION ALL SELECT k, CASE WHEN len(best) = 1 THEN list_append(taken, best[1]) ELSE taken END, CASE WHEN len(best) = 1 THEN best[1] END, lv, len(best)
    FROM (SELECT k, taken, lv, list_transform(list_filter(open, lambda x: x % 10 = lv), lambda x: x // 10) AS best
      FROM (SELECT k, taken, open, coalesce(list_min(list_transform(open, lambda x: x % 10)), 0)::BIGINT AS lv
        FROM (SELECT f.k, t.taken, list_filter(f.found, lambda x: NOT list_contains(t.taken, x // 10)) AS open FROM turns t JOIN fits f ON f.k = t.k + 1))))
  SELECT 'f' || s.doc_id || '.txt' AS path, s.size::BIGINT AS size, s.settled::BIGINT AS second, t.item AS record_id,
    CASE WHEN coalesce(t.n, 0) = 0 THEN '該当なし' WHEN t.n > 1 THEN '候補が複数' WHEN t.level = 1 THEN 'タイトル一致' ELSE 'タイトル語の一致' END AS how,
    coalesce(t.n, 0)::BIGINT AS candidates
  FROM states s LEFT JOIN fits f ON f.doc_id = s.doc_id AND f.size = s.size AND f.settled = s.settled LEFT JOIN turns t ON t.k = f.k""")
def _(t):
    """Documents land as looks in three goes, each read as a stream; the verdicts on what has settled."""
    spark = t.documents.sparkSession
    folder, verdicts, checkpoint = (_folder(t, name) for name in ("looks", "verdicts", "inbox"))
    records = t.benchmark.select(F.col("item_id").cast("string").alias("record_id"), F.col("text").alias("title"),
                                 F.concat(F.lit("10.5555/"), F.md5("text")).alias("doi"), F.lit("missing").alias("status"))
    looks = document_looks(t)
    tick = spark.range(1).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("size"), F.to_timestamp(F.lit(START)).alias("modified"),
                                 F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + 90000).alias("seen_at"), F.lit("").alias("text"),
                                 F.lit("").alias("first_page"), F.lit(90000).cast("long").alias("second"))
    for low, high in ((0, 1200), (1200, 3700), (3700, 1 << 40)):
        rows = looks.unionByName(tick).where((F.col("second") >= low) & (F.col("second") < high)).drop("second")
        rows.write.mode("append").json(folder)
        inbox.watch_inbox(spark, folder, records, verdicts, checkpoint).awaitTermination()
    second = F.unix_timestamp("settled_at") - F.unix_timestamp(F.lit(START))
    return inbox.verdicts_so_far(spark, verdicts).select("path", "size", second.alias("second"), F.col("record_id").cast("long").alias("record_id"), "how", "candidates")
