"""Column functions and text screening over the whole tables."""

from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import identifiers as ids
from sievelake.functions import labels, screening, similarity, venues
from sievelake.functions.text import first_filled, split_multi, strip, strip_markup, try_number
from sievelake.operators import workflow
from sievelake.operators.ranking import adoption_bucket
from sievelake.plans.records import (
    KEYED_SQL, RECORDS_SQL, TOPIC_EXCLUSIONS, TOPIC_GROUPS, TOPIC_TERMS, hits_sql, keyed_records,
    md5_modulo_sql, norm_title_sql, records, string_sql, strip_sql,
)
from sievelake.plans.quote_sql import CANONICAL_SQL, ratio_sql
from sievelake.plans.registry import query

BIG = "bigint"


def nested_sql(c: str, patterns: list[str], gap: str = " ") -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p}', '{gap}', 'g')"
    return c


def normalize_sql(c: str) -> str:
    noise = [r"\b\d{4}\b", r"\b\d+(?:st|nd|rd|th)\b", r"\([^)]*\)", r"[^\w\s]"]
    chain = nested_sql(f"lower({c})", noise + [rf"\b{p}\b" for p in fixed.VENUE_STOP_PHRASES])
    return f"trim(regexp_replace({chain}, '\\s+', ' ', 'g'))"


def marker_sql(c: str) -> str:
    j = f"regexp_matches({c}, '(?i)\\b({'|'.join(fixed.JOURNAL_WORDS)})\\b')"
    k = f"regexp_matches({c}, '(?i)\\b({'|'.join(fixed.CONFERENCE_WORDS)})\\b')"
    return f"CASE WHEN {j} AND NOT {k} THEN 'J' WHEN {k} AND NOT {j} THEN 'C' ELSE '' END"


def tokens_sql(c: str) -> str:
    fillers = ", ".join(f"'{w}'" for w in fixed.VENUE_FILLERS)
    return (f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), "
            f"lambda w: w NOT IN ({fillers}) AND NOT regexp_full_match(w, '\\d+(?:st|nd|rd|th)?')))")


# --- identifiers ---------------------------------------------------------------------------

@query("doi_normalized", f"""
  SELECT doc_id, regexp_replace(regexp_replace(lower({strip_sql('raw')}),
      '^(?:https?://)?(?:dx\\.)?doi\\.org/', ''), '^doi:\\s*', '') AS doi,
    CASE WHEN {strip_sql('raw')} LIKE '10.%' THEN {strip_sql('raw')}
         ELSE regexp_extract({strip_sql('raw')}, '10\\.\\d{{4,9}}/\\S+') END AS extracted
  FROM (SELECT doc_id, CASE lang WHEN 'en' THEN ' https://doi.org/10.1109/' || upper(md5(text))
      WHEN 'fr' THEN 'http://dx.doi.org/10.1145/' || md5(text) || chr(10)
      WHEN 'de' THEN 'doi: 10.1016/' || md5(text) ELSE 'see ' || source END AS raw FROM documents)""")
def _(t):
    digest = F.md5("text")
    raw = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" https://doi.org/10.1109/"), F.upper(digest)))
        .when(F.col("lang") == "fr", F.concat(F.lit("http://dx.doi.org/10.1145/"), digest, F.lit("\n")))
        .when(F.col("lang") == "de", F.concat(F.lit("doi: 10.1016/"), digest))
        .otherwise(F.concat(F.lit("see "), F.col("source")))
    )
    cells = t.documents.select("doc_id", raw.alias("raw"))
    return cells.select("doc_id", ids.norm_doi(F.col("raw")).alias("doi"),
                        ids.extract_doi(F.col("raw")).alias("extracted"))


@query("title_normalized", f"""WITH {RECORDS_SQL}
  SELECT ord, md5({norm_title_sql('title')}) AS spaced, md5(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')) AS compact
  FROM records""")
def _(t):
    title = F.col("title")
    return records(t).select("ord", F.md5(ids.norm_title(title)).alias("spaced"),
                             F.md5(ids.compact_title(title)).alias("compact"))


@query("record_keys", f"""WITH {RECORDS_SQL}, {KEYED_SQL} SELECT ord, record_key, record_id FROM keyed""")
def _(t):
    return keyed_records(t).select("ord", "record_key", "record_id")


@query("hash_buckets", f"""WITH {RECORDS_SQL}, {KEYED_SQL}
  SELECT ord, {md5_modulo_sql('record_key', 3)} AS block,
    {md5_modulo_sql("'cal:' || record_key", 100)} < 15 AS calibration_15,
    {md5_modulo_sql("'cal:' || record_key", 100)} < 20 AS calibration_20,
    CASE {md5_modulo_sql("'2nd:' || record_key", 2)} WHEN 0 THEN 'r2' ELSE 'r3' END AS second FROM keyed""")
def _(t):
    key = F.col("record_key")
    return keyed_records(t).select(
        "ord", ids.block_of(key).alias("block"),
        ids.is_calibration(key, 15).alias("calibration_15"),
        ids.is_calibration(key).alias("calibration_20"),
        ids.second_reviewer(key).alias("second"),
    )


@query("source_of_record", f"""WITH {RECORDS_SQL}
  SELECT ord, CASE WHEN contains(url, 'dl.acm.org') OR doi LIKE '10.1145%' THEN 'ACM'
      WHEN contains(url, 'ieeexplore.ieee.org') OR doi LIKE '10.1109%' THEN 'IEEE'
      WHEN contains(url, 'sciencedirect.com') OR doi LIKE '10.1016%' THEN 'Scopus/Elsevier'
      ELSE 'Others/Unknown' END AS source_db,
    CASE split_part(doi, '/', 1) WHEN '10.1145' THEN 'ACM' WHEN '10.1109' THEN 'IEEE' ELSE 'other' END AS provider,
    CASE WHEN doi = '' THEN 'DOI なし(書誌の確認が先)' ELSE CASE split_part(doi, '/', 1) WHEN '10.1145' THEN 'ACM'
      WHEN '10.1109' THEN 'IEEE' WHEN '10.1016' THEN 'Elsevier' ELSE 'その他' END END AS publisher
  FROM records""")
def _(t):
    return records(t).select(
        "ord", ids.guess_source(F.col("url"), F.col("doi")).alias("source_db"),
        ids.provider_of_doi(F.col("doi")).alias("provider"),
        ids.publisher_of_doi(F.col("doi")).alias("publisher"),
    )


@query("page_domains", """
  SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS domain, substr(replace(url, 'http', '10.11'), 1, 7) AS head
  FROM pages""")
def _(t):
    return t.pages.select("page_id", ids.url_domain(F.col("url")).alias("domain"),
                          ids.doi_head(F.replace("url", F.lit("http"), F.lit("10.11"))).alias("head"))


@query("markup_stripped", """
  SELECT page_id, md5(trim(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
    '[\\s\\x{00A0}\\x{2028}\\x{3000}]+', ' ', 'g')), '(?i)^\\s*abstract\\s*', ''))) AS body_md5 FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(strip_markup(F.col("html"))).alias("body_md5"))


@query("best_links", f"""WITH {RECORDS_SQL}
  SELECT ord, CASE lang WHEN 'en' THEN url ELSE CASE WHEN doi <> '' THEN 'https://doi.org/' || doi
    ELSE 'https://scholar.google.com/scholar?q=' || replace(url_encode(title), '%2F', '/') END END AS link FROM records""")
def _(t):
    open_url = F.when(F.col("lang") == "en", F.col("url")).otherwise("")
    return records(t).select("ord", ids.best_link(open_url, F.col("doi"), F.col("title")).alias("link"))


@query("title_terms", f"""WITH {RECORDS_SQL}
  SELECT ord, array_to_string(list_filter(regexp_extract_all(lower(title), '[a-z][a-z\\-]{{2,}}'),
    lambda w: w NOT IN ({', '.join(string_sql(w) for w in fixed.TITLE_STOPWORDS)})), ' ') AS terms FROM records""")
def _(t):
    return records(t).select("ord", F.array_join(ids.title_terms(F.col("title")), " ").alias("terms"))


@query("aliased_columns", f"""
  SELECT doc_id, CASE WHEN {strip_sql("coalesce(a, '')")} <> '' THEN {strip_sql('a')} ELSE {strip_sql('b')} END AS title FROM (
    SELECT doc_id, CASE lang WHEN 'en' THEN split_part(text, chr(10), 1) WHEN 'de' THEN ' ' END AS a,
      source AS b FROM documents)""")
def _(t):
    named = t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.substring_index("text", "\n", 1)).when(F.col("lang") == "de", " ").alias("Title"),
        F.col("source").alias("title_alt"),
    )
    return named.select("doc_id", first_filled(F.col("Title"), F.col("title_alt")).alias("title"))


@query("multi_values", """
  SELECT p_partkey, len(v)::BIGINT AS n, array_to_string(v, '|') AS tokens FROM (
    SELECT p_partkey, list_filter(list_transform(string_split(replace(replace(p_name, ' ', ' ;') || '；' || p_brand || ';;', '；', ';'), ';'),
      lambda x: trim(x)), lambda x: x <> '') AS v FROM part)""")
def _(t):
    cell = F.concat(F.regexp_replace("p_name", " ", " ;"), F.lit("；"), F.col("p_brand"), F.lit(";;"))
    parts = t.part.select("p_partkey", split_multi(cell).alias("v"))
    return parts.select("p_partkey", F.size("v").cast(BIG).alias("n"), F.array_join("v", "|").alias("tokens"))


@query("numbers_coerced", """
  SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
    try_cast(event_type AS DOUBLE) IS NULL AS not_a_number FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", F.coalesce(try_number(k, BIG), F.lit(0)).cast(BIG).alias("k"),
                           try_number(F.col("event_type")).isNull().alias("not_a_number"))


# --- venue names -----------------------------------------------------------------------------

VENUE_SQL = """venues AS (
  SELECT DISTINCT CASE l_linenumber
      WHEN 1 THEN 'Proceedings of the 12th International Conference on ' || p_name || ' (' || upper(p_type) || ')'
      WHEN 2 THEN 'Journal of ' || p_name || ' ' || p_brand
      WHEN 3 THEN year(l_shipdate) || ' ' || p_type || ' Symposium on ' || p_name || ', Adjunct'
      WHEN 4 THEN 'Transactions on ' || p_name || ' Proceedings ' || year(l_shipdate)
      WHEN 5 THEN p_name WHEN 6 THEN 'The 3rd Workshops and Posters' ELSE p_name || ' & ' || p_brand END AS venue
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sample_venues(t):
    """Distinct venue spellings made from the part names of all order lines."""
    year = F.year("l_shipdate").cast("string")
    name, brand = F.col("p_name"), F.col("p_brand")
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(F.lit("Proceedings of the 12th International Conference on "), name,
                                   F.lit(" ("), F.upper("p_type"), F.lit(")")))
        .when(line == 2, F.concat(F.lit("Journal of "), name, F.lit(" "), brand))
        .when(line == 3, F.concat(year, F.lit(" "), F.col("p_type"), F.lit(" Symposium on "), name, F.lit(", Adjunct")))
        .when(line == 4, F.concat(F.lit("Transactions on "), name, F.lit(" Proceedings "), year))
        .when(line == 5, name)
        .when(line == 6, "The 3rd Workshops and Posters")
        .otherwise(F.concat(name, F.lit(" & "), brand))
    )
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(text.alias("venue")).distinct()


@query("venue_normalized", f"""WITH {VENUE_SQL}
  SELECT venue, {normalize_sql('venue')} AS norm,
    trim(regexp_replace({nested_sql("regexp_replace(lower(venue), '[^a-z0-9_]', ' ', 'g')",
        [rf"{chr(92)}b{p}{chr(92)}b" for p in fixed.VENUE_STOP_PHRASES_EARLY], '')}, '\\s+', ' ', 'g')) AS norm_early
  FROM venues""")
def _(t):
    venue = F.col("venue")
    return sample_venues(t).select(
        "venue", venues.normalize_venue(venue).alias("norm"),
        venues.normalize_venue(venue, fixed.VENUE_STOP_PHRASES_EARLY, early=True).alias("norm_early"),
    )


@query("venue_keys", f"""WITH {VENUE_SQL}, n AS (
    SELECT venue, {normalize_sql('venue')} AS norm, {marker_sql('venue')} AS marker FROM venues)
  SELECT venue, marker, CASE WHEN norm = '' THEN '' WHEN marker <> '' THEN marker || ':' || norm
      ELSE 'J:' || norm || '|C:' || norm END AS keys,
    CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END <= 2 AS short,
    regexp_extract(venue, '\\(([A-Za-z][A-Za-z0-9 \\-]{{0,20}})\\)\\s*$', 1) AS acronym FROM n""")
def _(t):
    venue = F.col("venue")
    named = sample_venues(t).withColumn("norm", venues.normalize_venue(venue))
    return named.select(
        "venue", venues.type_marker(venue).alias("marker"),
        F.array_join(venues.typed_keys(venue, F.col("norm")), "|").alias("keys"),
        venues.is_short_key(F.col("norm")).alias("short"),
        venues.trailing_acronym(venue).alias("acronym"),
    )


@query("venue_containment", f"""WITH {VENUE_SQL}, pairs AS (
    SELECT DISTINCT v.venue, p.p_type || ' Conference on the ' || p.p_name || ' (was ' || p.p_brand || ')' AS title
    FROM venues v JOIN part p ON lower(v.venue) = lower(p.p_name) OR v.venue = 'Journal of ' || p.p_name || ' ' || p.p_brand),
  toks AS (SELECT *, {tokens_sql("regexp_replace(title, '\\([^)]*\\)', ' ', 'g')")} AS a, {tokens_sql('venue')} AS b FROM pairs)
  SELECT venue, title, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b))::DOUBLE / len(a), 9) END AS share
  FROM toks""")
def _(t):
    entries = t.part.select(
        F.explode(F.array(F.col("p_name"), F.concat(F.lit("Journal of "), F.col("p_name"), F.lit(" "), F.col("p_brand")))).alias("venue"),
        F.concat(F.col("p_type"), F.lit(" Conference on the "), F.col("p_name"), F.lit(" (was "), F.col("p_brand"), F.lit(")")).alias("title"),
    ).distinct()
    pairs = sample_venues(t).join(entries, "venue")
    return pairs.select("venue", "title",
                        F.round(venues.containment(F.col("title"), F.col("venue")), 9).alias("share"))


@query("raw_similarity", f"""WITH RECURSIVE {VENUE_SQL}, pairs AS (SELECT DISTINCT venue AS id, lower(venue) AS a, {normalize_sql('venue')} AS b FROM venues),
  {ratio_sql('pairs')} SELECT id AS venue, round(ratio, 6) AS ratio FROM scored""")
def _(t):
    """Ratio of every distinct venue spelling to its own normal form."""
    venue = F.col("venue")
    return sample_venues(t).select(
        "venue", F.round(similarity.raw_similarity(venue, venues.normalize_venue(venue)), 6).alias("ratio")
    )


@query("edit_similarity", f"""WITH {RECORDS_SQL}, pairs AS (
    SELECT ord, {norm_title_sql('title')} AS a, {norm_title_sql('key')} || ' ' || {norm_title_sql('doi')} AS b FROM records)
  SELECT ord, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0::DOUBLE
      ELSE round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) END AS similarity,
    CASE WHEN greatest(length(a), length(b)) > 0 AND levenshtein(a, b) <=
        floor(greatest(length(a), length(b)) * (1 - 0.1::DOUBLE))
      THEN round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) END AS above_floor
  FROM pairs""")
def _(t):
    pairs = records(t).select(
        "ord", ids.norm_title(F.col("title")).alias("a"),
        F.concat_ws(" ", ids.norm_title(F.col("key")), ids.norm_title(F.col("doi"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return pairs.select("ord", F.round(similarity.edit_similarity(a, b), 9).alias("similarity"),
                        F.round(similarity.levenshtein_similarity(a, b, 0.1), 9).alias("above_floor"))


@query("canonical_text", CANONICAL_SQL)
def _(t):
    """Canonical forms of every conversation turn, as digests."""
    rows = t.conversations.select("conv_id", "turn", similarity.canonical_text(F.col("text")).alias("c"))
    c = F.col("c")
    return rows.select("conv_id", "turn", F.md5(c).alias("canonical"), F.md5(similarity.no_space(c)).alias("no_space"),
                       F.md5(similarity.no_space_or_hyphen(c)).alias("no_hyphen"))


# --- labels ------------------------------------------------------------------------------------

ANSWERS_SQL = """answers AS (
  SELECT p_partkey, CASE WHEN p_size < 5 THEN 'N' WHEN p_size < 8 THEN '?' ELSE 'Y' END AS "P",
    CASE WHEN p_type = 'SMALL' THEN 'N' ELSE 'Y' END AS "I_hmd", CASE WHEN p_brand = 'Brand#7' THEN '' ELSE 'Y' END AS "I_scale",
    CASE WHEN p_name LIKE 'red%' THEN '?' ELSE 'Y' END AS "C", CASE WHEN p_retailprice < 950 THEN 'N' ELSE 'Y' END AS "O",
    CASE WHEN p_type = 'PROMO' AND p_size < 25 THEN 'N' ELSE 'Y' END AS "S" FROM part)"""


def part_answers(t):
    size, kind = F.col("p_size"), F.col("p_type")
    y = F.lit("Y")
    return t.part.select(
        "p_partkey",
        F.when(size < 5, "N").when(size < 8, "?").otherwise(y).alias("P"),
        F.when(kind == "SMALL", "N").otherwise(y).alias("I_hmd"),
        F.when(F.col("p_brand") == "Brand#7", "").otherwise(y).alias("I_scale"),
        F.when(F.col("p_name").startswith("red"), "?").otherwise(y).alias("C"),
        F.when(F.col("p_retailprice") < 950, "N").otherwise(y).alias("O"),
        F.when((kind == "PROMO") & (size < 25), "N").otherwise(y).alias("S"),
    )


@query("criteria_decisions", f"""WITH {ANSWERS_SQL}
  SELECT p_partkey, CASE WHEN 'N' IN ("P","I_hmd","I_scale","C","O","S") THEN 'Exclude'
      WHEN '' IN ("P","I_hmd","I_scale","C","O","S") THEN '' WHEN '?' IN ("P","I_hmd","I_scale","C","O","S") THEN 'Unsure'
      ELSE 'Include' END AS decision,
    CASE {' '.join(f'''WHEN "{k}" = 'N' THEN {string_sql(r)}''' for k, r in fixed.REASON_OF_CRITERION)} ELSE '' END AS reason
  FROM answers""")
def _(t):
    columns = {k: F.col(k) for k in fixed.CRITERIA}
    return part_answers(t).select("p_partkey", labels.expected_decision(list(columns.values())).alias("decision"),
                                  labels.auto_reason(columns).alias("reason"))


@query("agreement_labels", """
  SELECT c_custkey, CASE WHEN k < 0 THEN 'poor(偶然以下)' WHEN k < 0.21 THEN 'slight' WHEN k < 0.41 THEN 'fair'
      WHEN k < 0.61 THEN 'moderate' WHEN k < 0.81 THEN 'substantial' ELSE 'almost perfect' END AS label,
    CASE WHEN k >= 0.61 THEN 'continue' WHEN k >= 0.41 THEN 'discuss and inspect reasons' ELSE 'widen stage 2' END ||
      CASE WHEN k >= 0.41 AND c_nationkey < 5 THEN '; low pairs: lower band applies' ELSE '' END AS action
  FROM (SELECT c_custkey, c_nationkey, c_acctbal / 10000 AS k FROM customer)""")
def _(t):
    k = F.col("c_acctbal") / 10000
    low = (F.col("c_nationkey") < 5).cast("int")
    return t.customer.select("c_custkey", labels.agreement_label(k).alias("label"),
                             labels.agreement_action(k, low).alias("action"))


@query("drop_reasons", """WITH d AS (
    SELECT p_partkey, p_name, p_type, CASE WHEN p_size < 10 THEN 'Venue not found in CORE or SJR'
      WHEN p_size < 25 THEN 'SJR Quartile ''Q' || (p_size % 4 + 1) || ''' is not Q1' WHEN p_size < 45 THEN 'CORE Rank ''B'' < A'
      ELSE '' END AS why, 'Q' || (p_size % 4 + 1) AS q FROM part),
  r AS (SELECT p_partkey, CASE WHEN why LIKE 'Venue not%' THEN 'Venue名 ''' || p_name || ''' が CORE/SJR いずれにも未照合'
      WHEN why LIKE 'SJR%' THEN 'SJR ''' || q || ''' のため除外 (venue: ''' || p_name || ''' → 照合先: ''' || p_type || ''')'
      WHEN why LIKE 'CORE%' THEN 'CORE Rank ''B'' (< A) のため除外 (venue: ''' || p_name || ''' → 照合先: ''' || p_type || ''')'
      ELSE '理由不明(除外CSVに理由列なし)' END AS reason FROM d)
  SELECT p_partkey, reason, CASE WHEN reason LIKE '%SJR ''Q2''%' OR reason LIKE '%SJR ''Q3''%' OR reason LIKE '%SJR ''Q4''%' THEN 'criterion'
    WHEN reason LIKE '%未照合%' THEN 'unmatched' WHEN reason LIKE '%CORE Rank ''B''%' THEN 'below_rank' ELSE 'other' END AS category FROM r""")
def _(t):
    size = F.col("p_size")
    q = F.concat(F.lit("Q"), (size % 4 + 1).cast("string"))
    why = (
        F.when(size < 10, "Venue not found in CORE or SJR")
        .when(size < 25, F.concat(F.lit("SJR Quartile '"), q, F.lit("' is not Q1")))
        .when(size < 45, "CORE Rank 'B' < A").otherwise("")
    )
    reason = labels.rank_drop_reason(why, F.col("p_name"), F.col("p_type"), F.lit("B"), q)
    rows = t.part.select("p_partkey", reason.alias("reason"))
    return rows.select("p_partkey", "reason", labels.drop_category(F.col("reason"))["category"].alias("category"))


@query("file_names", f"""WITH {RECORDS_SQL}, {KEYED_SQL}, b AS (
    SELECT DISTINCT record_id, arg_min(title, ord) AS title FROM keyed GROUP BY record_id),
  c AS (SELECT record_id, regexp_replace(substr(regexp_replace(trim(regexp_replace(regexp_replace(title,
      '[\\\\/:*?"<>|#%\\[\\]\\x00-\\x1f]+', ' ', 'g'), '\\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g'), 1, 90), '[ .]+$', '') AS base FROM b),
  d AS (SELECT record_id, CASE WHEN base = '' THEN record_id ELSE base END AS base FROM c),
  e AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY record_id) AS place FROM d)
  SELECT record_id, CASE WHEN place = 1 THEN base || '.pdf'
    ELSE regexp_replace(substr(base, 1, 77), '[ .]+$', '') || ' (' || record_id || ').pdf' END AS file_name FROM e""")
def _(t):
    titles = keyed_records(t).groupBy("record_id").agg(F.min_by("title", "ord").alias("title"))
    return workflow.unique_file_names(titles)


@query("rank_labels", """
  SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'CORE A' WHEN 'PROMO' THEN trim('SJR Q' || (p_size % 4 + 1))
    WHEN 'LARGE' THEN '—(引用探索)' ELSE '' END AS label FROM part""")
def _(t):
    kind = F.col("p_type")
    source = F.when(kind == "SMALL", "CORE(alias)").when(kind == "PROMO", "SJR").otherwise("")
    q = F.concat(F.lit("Q"), (F.col("p_size") % 4 + 1).cast("string"))
    origin = F.when(kind == "LARGE", "snowballing").otherwise("database")
    return t.part.select("p_partkey", venues.rank_label(source, F.lit("A"), q, origin).alias("label"))


# --- screening -------------------------------------------------------------------------------

def missing_sql(text: str, groups) -> str:
    tests = ", ".join(f"CASE WHEN NOT {hits_sql(text, p)} THEN {string_sql(n)} END" for n, p in groups)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


VERDICT_SQL = f"""verdicts AS (
  SELECT *, CASE WHEN body = '' THEN 'hold' WHEN len(missing) = 0 THEN 'pass' ELSE 'fail' END AS verdict,
    CASE WHEN body = '' THEN {string_sql(fixed.HOLD_REASON)} WHEN len(missing) = 0 THEN ''
      ELSE {string_sql(fixed.FAIL_PREFIX)} || array_to_string(missing, ' / ') END AS reason
  FROM (SELECT *, {missing_sql("title || ' ' || body", TOPIC_GROUPS)} AS missing
        FROM (SELECT *, {strip_sql('abstract')} AS body FROM records)))"""


@query("concept_filter", f"WITH {RECORDS_SQL}, {VERDICT_SQL} SELECT ord, verdict, reason FROM verdicts")
def _(t):
    rows = records(t).select("ord", "title", "abstract")
    return screening.with_filter_verdict(rows, TOPIC_GROUPS).select("ord", "verdict", "reason")


@query("concept_filter_standard", f"""WITH {RECORDS_SQL}
  SELECT ord, CASE WHEN {strip_sql('abstract')} = '' THEN 'hold'
    WHEN {' AND '.join(hits_sql("title || ' ' || abstract", p) for _, p in fixed.CONCEPT_GROUPS)} THEN 'pass' ELSE 'fail' END AS verdict
  FROM records""")
def _(t):
    return screening.with_filter_verdict(records(t).select("ord", "title", "abstract")).select("ord", "verdict")


@query("missing_group_counts", f"""WITH {RECORDS_SQL}, {VERDICT_SQL}
  SELECT unnest(missing) AS concept, count(*) AS n FROM verdicts WHERE verdict = 'fail' GROUP BY 1""")
def _(t):
    judged = screening.with_filter_verdict(records(t).select("title", "abstract"), TOPIC_GROUPS)
    sets = judged.groupBy("verdict", "missing").agg(F.count("*").alias("n")).where("verdict = 'fail'")
    return sets.select("n", F.explode("missing").alias("concept")).groupBy("concept").agg(F.sum("n").alias("n"))


@query("concept_flags", f"""WITH {RECORDS_SQL}, f AS (
    SELECT ord, {', '.join(f'{hits_sql("title || chr(32) || abstract", p)} AS kw_g{i}' for i, (_, p) in enumerate(TOPIC_GROUPS, 1))} FROM records)
  SELECT *, (kw_g1::INT + kw_g2::INT + kw_g3::INT)::BIGINT AS kw_groups FROM f""")
def _(t):
    title, abstract = F.col("title"), F.col("abstract")
    return records(t).select("ord", *screening.group_flags(title, abstract, TOPIC_GROUPS),
                             screening.group_count(title, abstract, TOPIC_GROUPS).cast(BIG).alias("kw_groups"))


@query("title_only_retest", f"""WITH {RECORDS_SQL}
  SELECT source, count(*) AS abstract_less, count(*) FILTER (WHERE {' AND '.join(hits_sql('title', p) for _, p in TOPIC_GROUPS)}) AS surviving
  FROM records WHERE {strip_sql('abstract')} = '' GROUP BY source""")
def _(t):
    all_hit = F.size(screening.missing_groups(F.col("title"), TOPIC_GROUPS)) == 0
    return records(t).where(strip(F.col("abstract")) == "").groupBy("source").agg(
        F.count("*").alias("abstract_less"), F.count_if(all_hit).alias("surviving"))


def keywords_sql(text: str, categories) -> str:
    tests = ", ".join(
        f"CASE WHEN {hits_sql(text, p)} THEN {string_sql(f'{n}::{p}')} END" for n, ps in categories for p in ps)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def categories_sql(text: str, categories) -> str:
    tests = ", ".join(
        f"CASE WHEN {' OR '.join(hits_sql(text, p) for p in ps)} THEN {string_sql(n)} END" for n, ps in categories)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def keyword_rows(t, categories):
    rows = screening.with_keywords(records(t).select("ord", "title", "abstract"), categories)
    return rows.select("ord", F.array_join("kw_categories", " | ").alias("categories"),
                       F.array_join("kw_keywords", " | ").alias("keywords"))


HAYSTACK = "lower(title || chr(32) || abstract)"


@query("keyword_exclusion", f"""WITH {RECORDS_SQL}
  SELECT ord, array_to_string({categories_sql(HAYSTACK, TOPIC_EXCLUSIONS)}, ' | ') AS categories,
    array_to_string({keywords_sql(HAYSTACK, TOPIC_EXCLUSIONS)}, ' | ') AS keywords FROM records""")
def _(t):
    return keyword_rows(t, TOPIC_EXCLUSIONS)


@query("keyword_exclusion_standard", f"""WITH {RECORDS_SQL}
  SELECT ord, array_to_string({categories_sql(HAYSTACK, fixed.EXCLUSION_CATEGORIES)}, ' | ') AS categories,
    array_to_string({keywords_sql(HAYSTACK, fixed.EXCLUSION_CATEGORIES)}, ' | ') AS keywords FROM records""")
def _(t):
    return keyword_rows(t, fixed.EXCLUSION_CATEGORIES)


@query("term_matches", f"""WITH w AS (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents)
  SELECT doc_id, string_agg(DISTINCT word, ';' ORDER BY word) AS terms FROM w
  WHERE regexp_full_match(word, '(fat(?:ter|ness)?|thin(?:ner|ness)?|ther[\\p{{L}}\\p{{N}}_]*|clown)') GROUP BY doc_id""")
def _(t):
    rows = t.documents.select("doc_id", screening.term_matches(F.col("text"), TOPIC_TERMS).alias("terms"))
    return rows.where("terms <> ''")


@query("query_predicate", f"""
  SELECT doc_id, {hits_sql('text', chr(92) + 'b(?:with|erth' + chr(92) + 'w*)' + chr(92) + 'b')} AND
    {hits_sql('text', chr(92) + 'b(?:for|der)' + chr(92) + 'b')} AS in_scope,
    {string_sql(screening.fielded_query([["with", "erth*"], ["for", "der"]]))} AS fielded,
    {string_sql(screening.scoped_query([["with", "erth*"], ["for", "der"]]))} AS scoped FROM documents""")
def _(t):
    terms = [["with", "erth*"], ["for", "der"]]
    return t.documents.select(
        "doc_id", screening.term_predicate(F.col("text"), terms).alias("in_scope"),
        F.lit(screening.fielded_query(terms)).alias("fielded"), F.lit(screening.scoped_query(terms)).alias("scoped"))


@query("threshold_verdicts", """
  SELECT o_orderkey, o_totalprice < 150000 AND NOT coalesce(y >= 1999, false) AS dropped,
    o_totalprice < 150000 AND coalesce(y < 1999, false) AS dropped_cross FROM (
    SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END AS y FROM orders)""")
def _(t):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", screening.recent_or_kept(price, year, 150000, 1999).alias("dropped"),
                           screening.below_and_old(price, year, 150000, 1999).alias("dropped_cross"))


@query("rank_adoption", """
  SELECT p_partkey, (p_type IN ('SMALL', 'PROMO') AND p_size <= 20) OR (p_type NOT IN ('SMALL', 'PROMO') AND p_size <= 12) AS adopted,
    CASE WHEN p_type IN ('SMALL', 'PROMO') THEN CASE WHEN p_size <= 20 THEN 'include' ELSE 'exclude' END
      WHEN p_size <= 12 THEN 'include' WHEN p_size <= 25 THEN 'review' ELSE 'exclude' END AS bucket FROM part""")
def _(t):
    listed = F.when(F.col("p_type").isin("SMALL", "PROMO"), "CORE").otherwise("SJR")
    size = F.col("p_size")
    rank = (
        F.when(listed == "CORE", F.when(size <= 10, "A*").when(size <= 20, "A").when(size <= 35, "B").otherwise("C"))
        .otherwise(F.when(size <= 12, "Q1").when(size <= 25, "Q2").when(size <= 38, "Q3").otherwise("Q4"))
    )
    return t.part.select("p_partkey", venues.adopted(listed, rank).alias("adopted"),
                         adoption_bucket(listed, rank).alias("bucket"))
