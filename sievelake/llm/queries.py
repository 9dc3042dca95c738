"""One registered query per operator, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import (chat, conversation_repair, exact_dedup, hard_negatives, html_text, language, mixing, ordering, packing, quality_rules,
                           shingle_join, tokens, url_filter, vector_graph)
from sievelake.llm.common import WORD, cut, new_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


OP8_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i+1], words[i+2]) AS c FROM p),
d AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM g WHERE c > 1),
n AS (SELECT r, sum(least(3, i - coalesce(before, i - 3))) AS n_repeat_words FROM d GROUP BY r),
s AS (SELECT list_transform(string_split('STOP', ' '), lambda x: x) AS stop),
m AS (SELECT w.r, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(words, lambda x: list_contains(stop, lower(x)))) AS n_stop, len(lines) AS n_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦][\x20\x09]'))) AS n_bullet,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_open
      FROM w CROSS JOIN s LEFT JOIN n ON n.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_stop >= 2 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_bullet <= 90 * n_lines
       AND 100 * n_open <= 30 * n_lines AS kept
FROM b
""".replace("'STOP'", "'" + " ".join(quality_rules.STOP_WORDS) + "'")


@query("op8_quality_rules", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text"))
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select("doc_id", *[F.col("quality")[c].alias(c) for c in wanted])


#: The rule table of the url query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

OP9_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id, instr(url, '://') AS p, url FROM pages),
h AS (SELECT r, page_id, CASE WHEN p > 0 THEN substring(url, p + 3) ELSE '' END AS rest FROM u),
s AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
m AS (SELECT s.r, rules.host || rules.path AS rule, rules.verdict,
             row_number() OVER (PARTITION BY s.r ORDER BY length(rules.host) + length(rules.path) DESC, length(rules.host) DESC) AS k
      FROM s JOIN rules ON (s.host = rules.host OR ends_with(s.host, '.' || rules.host)) AND starts_with(s.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m ON m.r = s.r AND m.k = 1
"""


@query("op9_url_filters", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, folder, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op4_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return mixing.taken(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = tokens.pieces(docs, tokens.vocabulary(), length=1024, end_id=2, with_ids=False)
    return packing.packed(rows, size=1024).withColumnRenamed("key", "doc_id")


@query("op1_training_order")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "order")
    ordering.written(table(spark, folder, "documents").select("doc_id", "text"), out, tokens.vocabulary())
    rows = ordering.read(spark, out)
    used = F.expr("substring(ids, 1, 2 * n)")  # without the padding
    return rows.select("doc_id", "piece", "start", "n", "slot", "shard", "position", F.crc32(used).alias("ids_crc32"))


@query("op2_vector_graph")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fitted(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    rows = language.predicted(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", language.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"),
                       F.col("language.score").alias("score"))


@query("op6_html_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = html_text.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_chat_formatting")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digested(chat.formatted(rows.unionByName(more), tokens.vocabulary()))


@query("op5_shingle_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = shingle_join.linked(table(spark, folder, "documents").select("doc_id", "text"), words=3, percent=90)
    return rows.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST, r) AS k FROM t),
g AS (SELECT body, count(*) AS group_size FROM t GROUP BY body)
SELECT w.doc_id, s.doc_id AS keep_id, group_size, w.k = 1 AS kept, sha256(w.body) AS text_sha256
FROM w JOIN w AS s ON s.body = w.body AND s.k = 1 JOIN g ON g.body = w.body
"""


@query("op11_exact_dedup", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicated(table(spark, folder, "documents").select("doc_id", "text"), new_folder(spark, "exact"))


OP12_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same,
             list_inner_product(a.v, c.v)::BIGINT AS score FROM e AS a JOIN e AS c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, cr) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.cr) AS rank
      FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mined(rows, F.col("id") % 50 == 0)


def _longer(repair: str, cost: str, letter: str, line: str | None = None) -> str:
    """SQL of a repair (eight digits of cost, audit, a separator, lines) that goes on with one edit."""
    more = f" || chr(10) || {line}" if line else ""
    return (f"CASE WHEN {repair} < '99999999' THEN lpad((left({repair}, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || "
            f"substring({repair}, 9, instr({repair}, chr(1)) - 9) || '{letter}' || substring({repair}, instr({repair}, chr(1))){more} ELSE '99999999' END")


def _kept(state: str, before: str, name: str | None) -> str:
    """SQL of the cheapest repair in `state` once the row is read: deleted, or written behind the repair `before`."""
    gone = _longer(state, "2", "D")
    kept = f"least({gone}, {_longer(before, 'more', 'K', 'line')})"
    if name is None:
        return f"CASE WHEN free AND x = 's' THEN {kept} ELSE {gone} END"
    other = f"least({gone}, {_longer(before, 'more + 1', 'R', f"'{name}:' || text")})"
    return f"CASE WHEN free AND x = '{name[0]}' THEN {kept} WHEN free THEN {other} ELSE {gone} END"


OP13_SQL = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
-- crc32 of a name: every byte and then seven zeros are steps of one bit each.
b AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''),
        lambda c: [ord(c)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT]))),
        lambda s, y: xor(xor(s, y) >> 1, 3988292384::BIGINT * (xor(s, y) & 1))), 4294967295::BIGINT) % 20 AS kind FROM t),
d AS (SELECT r, conv_id, turn, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM b WHERE kind <> 0),
h AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS tie, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tie, r, copy) AS i,
             row_number() OVER (PARTITION BY c, tie ORDER BY turn NULLS FIRST, r, copy) AS again FROM h),
f AS (SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN again > 1 THEN 2
             WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 3 ELSE 0 END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM o),
k AS (SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
-- The cheapest repair so far that ends in nothing, a system's, a user's, an assistant's turn.
z AS (SELECT c, 0::BIGINT AS i, '00000000' || chr(1) AS q0, '99999999' AS q1, '00000005I' || chr(1) || chr(10) || 'user:' AS q2,
             '00000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' AS q3 FROM k
      UNION ALL
      SELECT c, i, q0, q1, q2, least(q3, {_longer('q2', '5', 'I', "'assistant:'")}) AS q3
      FROM (SELECT c, i, q0, q1, least(q2, {', '.join(_longer(q, '5', 'I', "'user:'") for q in ('q0', 'q1', 'q3'))}) AS q2, q3
            FROM (SELECT c, i, {_longer('p0', '2', 'D')} AS q0, {_kept('p1', 'p0', None)} AS q1, {_kept('p2', 'p4', 'user')} AS q2,
                         {_kept('p3', 'p2', 'assistant')} AS q3
                  FROM (SELECT f.c, f.i, f.x, f.text, f.role || ':' || f.text AS line, f.fault NOT IN (1, 2) AS free,
                               CASE WHEN f.fault = 3 THEN 5 ELSE 0 END AS more,
                               z.q0 AS p0, z.q1 AS p1, z.q2 AS p2, z.q3 AS p3, least(z.q0, z.q1, z.q3) AS p4 FROM z JOIN f ON f.c = z.c AND f.i = z.i + 1)))),
e AS (SELECT k.*, least(z.q0, z.q3) AS q FROM k JOIN z ON z.c = k.c AND z.i = k.n),
v AS (SELECT *, substring(q, 9, instr(q, chr(1)) - 9) AS audit, substring(q, instr(q, chr(1)) + 2) AS lines FROM e)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(q, 8)::BIGINT, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN v ON a.conv_id IS NOT DISTINCT FROM v.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.of_all(cut(conversation_repair.repaired(conversation_repair.damaged(rows))), rows)
