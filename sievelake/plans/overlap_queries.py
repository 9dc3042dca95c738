"""Source overlap, completeness, enrichment, and citation edges."""

from pyspark.sql import functions as F

from sievelake.operators import citations, overlap
from sievelake.plans.records import (
    KEYED_SQL, RECORDS_SQL, TOPIC_EXCLUSIONS, hits_sql, keyed_records, norm_title_sql, records, strip_sql,
)
from sievelake.plans.registry import query

BASE = f"WITH {RECORDS_SQL}, {KEYED_SQL}"


@query("known_in_corpus", f"""{BASE} SELECT k.ord, CASE WHEN EXISTS (SELECT 1 FROM keyed c WHERE c.source < 'src15' AND c.record_key = k.record_key)
    THEN 'Y' ELSE 'N' END AS in_corpus FROM keyed k WHERE k.source >= 'src15'""")
def _(t):
    rows = keyed_records(t).select("ord", "source", "record_key")
    return overlap.flag_known(rows.where("source >= 'src15'"), rows.where("source < 'src15'")).select("ord", "in_corpus")


@query("only_in_source", f"""{BASE} SELECT ord, record_key FROM keyed WHERE source = 'src3'
    AND record_key NOT IN (SELECT record_key FROM keyed WHERE source <> 'src3')""")
def _(t):
    return overlap.only_in(keyed_records(t), "source", "src3").select("ord", "record_key")


@query("source_overlap", f"""{BASE}, k AS (SELECT DISTINCT source, record_key FROM keyed)
  SELECT x.source AS a, y.source AS b, count(*) AS common FROM k x JOIN k y ON x.record_key = y.record_key AND x.source < y.source GROUP BY ALL""")
def _(t):
    return overlap.pairwise_overlap(keyed_records(t).select("source", "record_key"), "source")


@query("export_completeness", f"""{BASE}
  SELECT source || '.csv' AS file, count(*) AS records, count(DISTINCT record_key) AS unique_keys,
    count(*) - count(DISTINCT record_key) AS dup_in_file, count(*) FILTER (WHERE doi <> '') AS doi_filled,
    count(*) FILTER (WHERE {strip_sql('abstract')} <> '') AS abstract_filled,
    round(count(*) FILTER (WHERE year::INT >= 2021) * 100 / count(*), 1) AS recent_pct,
    CASE WHEN count(*) IN (100, 200, 250, 500, 1000, 2000, 5000, 10000) THEN 'Y' ELSE 'N' END AS truncation_suspected,
    count(*) - count(*) FILTER (WHERE lang = 'en') AS difference FROM keyed GROUP BY source""")
def _(t):
    rows = keyed_records(t).withColumn("file", F.concat("source", F.lit(".csv")))
    expected = rows.groupBy("file").agg(F.count_if(F.col("lang") == "en").alias("expected"))
    return overlap.export_completeness(rows.select("file", "record_key", "doi", "abstract", "year"), expected)


@query("source_dates", """WITH d AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)
  SELECT source, sum(n)::BIGINT AS records, string_agg(day || ': ' || n, ', ' ORDER BY day) AS dates FROM d GROUP BY source""")
def _(t):
    return overlap.source_dates(t.events.select(F.col("event_type").alias("source"), F.col("ts").cast("string").alias("added")))


@query("key_agreement", f"""WITH {RECORDS_SQL}, l AS (SELECT key, count(*) AS n FROM records WHERE lang <> 'de' GROUP BY key),
    m AS (SELECT DISTINCT key FROM records WHERE lang <> 'fr')
  SELECT count(l.key) AS raw_keys, count(*) FILTER (WHERE n > 1) AS several, count(*) FILTER (WHERE m.key IS NULL) AS missing_in_merged,
    count(*) FILTER (WHERE l.key IS NULL) AS only_in_merged FROM l FULL JOIN m ON l.key = m.key""")
def _(t):
    rows = records(t).select("key", "lang")
    return overlap.key_agreement(rows.where("lang <> 'de'"), rows.where("lang <> 'fr'"))


@query("expected_received", """
  SELECT l.doc_id AS record, 'foreign' AS problem FROM labels l JOIN documents d USING (doc_id) WHERE d.lang <> 'en'
  UNION ALL SELECT doc_id, 'missing' FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    wanted = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("record"))
    return overlap.expected_received(wanted, t.labels.select(F.col("doc_id").alias("record")), ["record"])


@query("blank_fields_filled", """
  SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '' ELSE o_custkey::VARCHAR END AS doi,
    CASE o_orderstatus WHEN 'P' THEN '' WHEN 'F' THEN o_orderpriority ELSE coalesce(c_name, '') END AS title,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE coalesce(c_mktsegment, '') END AS venue
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderstatus <> 'P'""")
def _(t):
    status = F.col("o_orderstatus")
    found = t.orders.select(
        "o_orderkey", F.when(status == "P", "").otherwise(F.col("o_custkey").cast("string")).alias("doi"),
        F.when(status == "F", F.col("o_orderpriority")).otherwise("").alias("title"), F.lit("").alias("venue"))
    lookup = t.customer.select(F.col("c_custkey").cast("string").alias("doi"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("venue"))
    return overlap.fill_blank(found, lookup, "doi", ["title", "venue"])


ENRICH_SQL = f"""{BASE}, cache AS (SELECT doi, arg_max({strip_sql('abstract')}, ord) AS cached FROM records
    WHERE source < 'src5' AND doi <> '' AND {strip_sql('abstract')} <> '' GROUP BY doi),
  enriched AS (SELECT k.ord, k.record_id, CASE WHEN k.lang = 'fr' THEN '' ELSE {strip_sql('k.abstract')} END AS own, cached
    FROM keyed k LEFT JOIN cache ON k.doi = cache.doi)"""


@query("abstracts_enriched", f"""{ENRICH_SQL}
  SELECT ord, md5(CASE WHEN own <> '' THEN own ELSE coalesce(cached, '') END) AS abstract_md5,
    CASE WHEN own <> '' THEN 'database' WHEN cached IS NOT NULL THEN 'enriched' ELSE 'none' END AS abstract_source FROM enriched""")
def _(t):
    rows = records(t).select("ord", "doi", F.when(F.col("lang") == "fr", "").otherwise(F.col("abstract")).alias("abstract"))
    cache = records(t).where("source < 'src5'").select("ord", "doi", "abstract")
    return overlap.enrich_abstracts(rows, cache).select("ord", F.md5("abstract").alias("abstract_md5"), "abstract_source")


@query("enrichment_report", f"""{ENRICH_SQL}
  SELECT CASE WHEN own <> '' THEN 'database' WHEN cached IS NOT NULL THEN 'enriched' ELSE 'none' END AS status, count(*) AS n,
    sum(length(CASE WHEN own <> '' THEN own ELSE coalesce(cached, '') END))::BIGINT AS chars FROM enriched GROUP BY 1""")
def _(t):
    from sievelake.operators.reports import status_report

    rows = records(t).select("ord", "doi", F.when(F.col("lang") == "fr", "").otherwise(F.col("abstract")).alias("abstract"))
    cache = records(t).where("source < 'src5'").select("ord", "doi", "abstract")
    return status_report(overlap.enrich_abstracts(rows, cache), F.col("abstract_source"), F.col("abstract"))


@query("enrichment_queue", f"""WITH {RECORDS_SQL}, r AS (SELECT ord, doi, CASE WHEN source < 'src4' THEN '' ELSE {strip_sql('abstract')} END AS a FROM records),
  cache AS (SELECT r.doi, CASE WHEN toxic = 1 THEN 'ratelimited' WHEN quality = 0 THEN 'notfound' ELSE 'ok' END AS status FROM labels JOIN records r ON r.ord = labels.doc_id)
  SELECT 'retry none' AS rule, ord, doi FROM r WHERE doi <> '' AND a = '' AND doi NOT IN (SELECT doi FROM cache WHERE status <> 'ratelimited')
  UNION ALL SELECT 'retry not found', ord, doi FROM r WHERE doi <> '' AND a = '' AND doi NOT IN (SELECT doi FROM cache WHERE status NOT IN ('ratelimited', 'notfound'))""")
def _(t):
    rows = records(t).select("ord", "doi", F.when(F.col("source") < "src4", "").otherwise(F.col("abstract")).alias("abstract"))
    status = F.when(F.col("toxic") == 1, "ratelimited").when(F.col("quality") == 0, "notfound").otherwise("ok")
    cache = t.labels.join(records(t), F.col("doc_id") == F.col("ord")).select("doi", status.alias("status"))
    first = overlap.enrichment_queue(rows, cache).withColumn("rule", F.lit("retry none"))
    return first.unionByName(overlap.enrichment_queue(rows, cache, True).withColumn("rule", F.lit("retry not found")))


TRANSLATIONS_SQL = f"""texts AS (SELECT 'D' || ord AS record_id, abstract, lang FROM records),
  cache AS (SELECT 'D' || r.ord AS record_id, sha1(CASE WHEN toxic = 1 THEN 'changed' ELSE {strip_sql('abstract')} END) AS src_sha1, 'ja ' || r.ord AS ja
    FROM labels JOIN records r ON r.ord = labels.doc_id)"""


def translations(t):
    texts = records(t).select(F.concat(F.lit("D"), F.col("ord").cast("string")).alias("record_id"), "abstract", "lang", "ord")
    from sievelake.functions.text import strip

    source = F.when(F.col("toxic") == 1, "changed").otherwise(strip(F.col("abstract")))
    cache = t.labels.join(texts, F.col("doc_id") == F.col("ord")).select(
        "record_id", F.sha1(source).alias("src_sha1"), F.concat(F.lit("ja "), F.col("ord").cast("string")).alias("ja"))
    return texts.drop("ord"), cache


@query("translation_queue", f"""WITH {RECORDS_SQL}, {TRANSLATIONS_SQL}
  SELECT record_id, length({strip_sql('abstract')})::BIGINT AS chars FROM texts t WHERE {strip_sql('abstract')} <> '' AND lang = 'en'
    AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.record_id = t.record_id AND c.src_sha1 = sha1({strip_sql('t.abstract')}))""")
def _(t):
    texts, cache = translations(t)
    return overlap.translation_queue(texts, cache, F.col("lang") == "en")


@query("translations_attached", f"""WITH {RECORDS_SQL}, {TRANSLATIONS_SQL}
  SELECT t.record_id, coalesce(c.ja, '') AS ja FROM texts t LEFT JOIN cache c ON c.record_id = t.record_id AND c.src_sha1 = sha1({strip_sql('t.abstract')})""")
def _(t):
    texts, cache = translations(t)
    return overlap.attach_translation(texts, cache).select("record_id", "ja")


@query("calibration_override", """
  SELECT doc_id AS record_id, CASE quality WHEN 1 THEN 'Y' WHEN 0 THEN 'N' ELSE CASE WHEN n_chars < 900 THEN 'Y' ELSE 'N' END END AS calibration,
    coalesce(CASE quality WHEN 1 THEN 'Y' WHEN 0 THEN 'N' END <> CASE WHEN n_chars < 900 THEN 'Y' ELSE 'N' END, false) AS drifted
  FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("record_id"), F.when(F.col("n_chars") < 900, "Y").otherwise("N").alias("calibration"))
    truth = t.labels.select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "Y").otherwise("N").alias("calibration"))
    return overlap.override_flag(rows, truth).select("record_id", "calibration", "drifted")


@query("metadata_fallback", f"""WITH {RECORDS_SQL}, {KEYED_SQL},
  bd AS (SELECT doi, arg_min(source, ord) AS v, arg_min(year, ord) AS y FROM records WHERE lang = 'en' GROUP BY doi),
  bt AS (SELECT {norm_title_sql('title')} AS k, arg_min('T ' || source, ord) AS v, arg_min(year, ord) AS y FROM records WHERE lang = 'fr' GROUP BY 1),
  bi AS (SELECT record_id, arg_min('I ' || source, ord) AS v, arg_min(year, ord) AS y FROM keyed WHERE lang = 'de' GROUP BY 1)
  SELECT k.ord, coalesce(bd.v, bt.v, bi.v, '') AS venue, CASE WHEN bd.v IS NOT NULL THEN bd.y WHEN bt.v IS NOT NULL THEN bt.y ELSE coalesce(bi.y, '') END AS year
  FROM keyed k LEFT JOIN bd ON k.doi = bd.doi LEFT JOIN bt ON {norm_title_sql('k.title')} = bt.k LEFT JOIN bi ON k.record_id = bi.record_id""")
def _(t):
    from sievelake.functions.identifiers import norm_title

    rows = keyed_records(t).withColumn("title_key", norm_title(F.col("title")))
    pick = lambda lang, key, tag: rows.where(F.col("lang") == lang).select(
        F.col(key).alias("key"), "ord", F.concat(F.lit(tag), "source").alias("venue"), "year")
    asked = rows.select("ord", "doi", "title_key", "record_id")
    return overlap.metadata_fallback(asked, pick("en", "doi", ""), pick("fr", "title_key", "T "), pick("de", "record_id", "I ")).select(
        "ord", "venue", "year")


@query("first_filled_file", f"""{BASE} SELECT record_key, arg_min(lang, source || lpad(ord::VARCHAR, 12, '0')) AS venue,
    arg_min(year, source || lpad(ord::VARCHAR, 12, '0')) AS year FROM keyed WHERE lang <> 'de' GROUP BY record_key""")
def _(t):
    rows = keyed_records(t).select("record_key", F.col("source").alias("file"), "ord",
                                   F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("venue"), "year")
    return overlap.first_filled_file(rows, "record_key")


# --- citations: an order cites its parts -----------------------------------------------------------

EDGES_SQL = """edges AS (SELECT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst, l_orderkey * 8 + l_linenumber AS place FROM lineitem),
  seeds AS (SELECT 'O' || o_orderkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_size = 1),
  definitional AS (SELECT 'P' || p_partkey AS seed FROM part WHERE p_type = 'ECONOMY'),
  hops AS (SELECT src AS seed, 'backward' AS direction, dst AS found, place FROM edges WHERE src IN (SELECT seed FROM seeds)
    UNION ALL SELECT dst, 'forward', src, place FROM edges WHERE dst IN (SELECT seed FROM seeds) AND dst NOT IN (SELECT seed FROM definitional))"""


def edges(t):
    return t.lineitem.select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))


def seeds(t):
    orders = t.orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("seed"))
    parts = t.part.where("p_size = 1").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("seed"))
    return orders.unionByName(parts)


def definitional(t):
    return t.part.where("p_type = 'ECONOMY'").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("seed"))


@query("citation_hop", f"WITH {EDGES_SQL} SELECT * FROM hops")
def _(t):
    return citations.expand(seeds(t), edges(t), definitional(t))


@query("citation_hop_limited", f"""WITH {EDGES_SQL} SELECT seed, direction, found, place FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, direction ORDER BY place, found) AS n FROM hops) WHERE n <= 3""")
def _(t):
    return citations.expand(seeds(t), edges(t), definitional(t), per_seed=3)


@query("citation_seeds", """WITH refs AS (SELECT p_partkey AS seed, ' ' || p_name AS title, 'https://doi.org/10.1234/' || p_partkey AS doi FROM part WHERE p_size < 40),
  dropped AS (SELECT DISTINCT l_partkey AS seed FROM lineitem WHERE l_returnflag = 'R'),
  chosen AS (SELECT seed FROM dropped UNION SELECT p_partkey FROM part WHERE p_type = 'SMALL')
  SELECT seed, trim(title) AS title, '10.1234/' || seed AS doi FROM chosen JOIN refs USING (seed)""")
def _(t):
    refs = t.part.where("p_size < 40").select(
        F.col("p_partkey").alias("seed"), F.concat(F.lit(" "), "p_name").alias("title"),
        F.concat(F.lit("https://doi.org/10.1234/"), F.col("p_partkey").cast("string")).alias("doi"))
    dropped = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("seed")).distinct()
    return citations.choose_seeds(dropped, refs, t.part.where("p_type = 'SMALL'").select(F.col("p_partkey").alias("seed")))


@query("citation_fallback", """WITH s AS (SELECT o_orderkey AS seed FROM orders),
  p AS (SELECT l_orderkey AS seed, 'P' || l_partkey AS found FROM lineitem WHERE l_returnflag = 'A'),
  q AS (SELECT l_orderkey AS seed, 'S' || l_suppkey AS found FROM lineitem WHERE l_linestatus = 'F')
  SELECT seed, found, 'S2' AS ref_source FROM p
  UNION ALL SELECT seed, found, 'Crossref' FROM q WHERE seed NOT IN (SELECT seed FROM p)
  UNION ALL SELECT seed, NULL, '取得不可' FROM s WHERE seed NOT IN (SELECT seed FROM p) AND seed NOT IN (SELECT seed FROM q)""")
def _(t):
    pick = lambda condition, tag, key: t.lineitem.where(condition).select(
        F.col("l_orderkey").alias("seed"), F.concat(F.lit(tag), F.col(key).cast("string")).alias("found"))
    return citations.with_fallback(t.orders.select(F.col("o_orderkey").alias("seed")),
                                   pick("l_returnflag = 'A'", "P", "l_partkey"), pick("l_linestatus = 'F'", "S", "l_suppkey"))


def any_hit_sql(c):
    return " OR ".join(hits_sql(c, p) for _, ps in TOPIC_EXCLUSIONS for p in ps)


@query("citation_branch", f"""{BASE}, f AS (
    SELECT ord, CASE WHEN source < 'src12' THEN 'Y' ELSE 'N' END AS in_corpus, CASE WHEN lang = 'es' AND n_chars < 900 THEN '' ELSE {strip_sql('title')} END AS title,
      abstract, doi FROM records),
  k AS (SELECT *, CASE WHEN doi <> '' THEN doi ELSE 'T:' || {norm_title_sql('title')} END AS record_key FROM f),
  w AS (SELECT *, min(ord) FILTER (WHERE in_corpus = 'N' AND title <> '') OVER (PARTITION BY record_key) AS first FROM k)
  SELECT ord, CASE WHEN in_corpus <> 'N' THEN 'known' WHEN title = '' THEN 'no title' WHEN ord <> first THEN 'repeat'
    WHEN {any_hit_sql("lower(title || ' ' || abstract)")} THEN 'keyword' ELSE 'to screening' END AS outcome FROM w""")
def _(t):
    found = records(t).select(
        "ord", F.when(F.col("source") < "src12", "Y").otherwise("N").alias("in_corpus"),
        F.when((F.col("lang") == "es") & (F.col("n_chars") < 900), "").otherwise(F.col("title")).alias("title"), "abstract", "doi")
    return citations.citation_branch(found, TOPIC_EXCLUSIONS).select("ord", "outcome")
