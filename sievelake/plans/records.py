"""How the given tables play the roles of the domain, in Spark and in SQL.

`documents` are bibliographic records: the first line is the title, the rest the
abstract; identifiers come from the content, so copies share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions import identifiers as ids
from sievelake.plans.registry import Tables

# A review topic with words that the given texts contain.
TOPIC_GROUPS = [
    ("G1 setting", r"\b(with|erth\w*|the(?:re|m)?)\b"),
    ("G2 subject", r"\b(tions?|for|der|th(?:at|is))\b"),
    ("G3 measure", r"\b(of|la|ver\w*|fat(?:ter)?)\b"),
]
TOPIC_EXCLUSIONS = [
    ("Out of scope", [r"\bidiot\b", r"\bar\b", r"\bclown\w*\b", r"\bno such phrase\b"]),
    ("Not a study", [r"\btoken\b", r"\blicense\b", r"\bcopyright\b", r"\bpassword\b"]),
    ("Clinical", [r"\bpatients?\b", r"\bther\w+\b"]),
    ("Two forms", [r"\bfat(?:ter)?\b|\bclown\b"]),
]
TOPIC_TERMS = r"\b(fat(?:ter|ness)?|thin(?:ner|ness)?|ther\w*|clown)\b"


def records(t: Tables) -> DataFrame:
    text = F.col("text")
    newline = F.instr(text, "\n")
    lang = F.col("lang")
    prefix = F.when(lang == "en", "10.1109/").when(lang == "fr", "10.1145/").when(lang == "de", "10.1016/")
    host = (
        F.when(lang == "en", "https://ieeexplore.ieee.org/document/")
        .when(lang == "fr", "https://dl.acm.org/doi/")
        .when(lang == "de", "https://www.sciencedirect.com/science/")
    )
    return t.documents.select(
        F.col("doc_id").alias("ord"),
        "lang", "source", "n_chars",
        F.substring_index(text, "\n", 1).alias("title"),
        F.when(newline > 0, F.substr(text, newline + 1)).otherwise("").alias("abstract"),
        F.coalesce(F.concat(prefix, F.md5(text)), F.lit("")).alias("doi"),
        F.concat_ws("-", "source", F.col("n_chars").cast("string")).alias("key"),
        F.when(lang.isin("fr", "de"), F.lpad(F.col("n_chars").cast("string"), 8, "0"))
        .otherwise("").alias("issn"),
        F.concat(
            F.coalesce(host, F.concat(F.lit("http://"), F.col("source"), F.lit(".example.org/r/"))),
            F.col("doc_id").cast("string"),
        ).alias("url"),
        (F.col("n_chars") % 26 + 2000).cast("string").alias("year"),
    )


RECORDS_SQL = """records AS (
  SELECT doc_id AS ord, lang, source, n_chars,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS abstract,
    CASE lang WHEN 'en' THEN '10.1109/' || md5(text) WHEN 'fr' THEN '10.1145/' || md5(text)
      WHEN 'de' THEN '10.1016/' || md5(text) ELSE '' END AS doi,
    source || '-' || n_chars AS key,
    CASE WHEN lang IN ('fr', 'de') THEN lpad(n_chars::VARCHAR, 8, '0') ELSE '' END AS issn,
    CASE lang WHEN 'en' THEN 'https://ieeexplore.ieee.org/document/' WHEN 'fr' THEN 'https://dl.acm.org/doi/'
      WHEN 'de' THEN 'https://www.sciencedirect.com/science/'
      ELSE 'http://' || source || '.example.org/r/' END || doc_id AS url,
    (n_chars % 26 + 2000)::VARCHAR AS year
  FROM documents)"""


def keyed_records(t: Tables) -> DataFrame:
    """Records with `record_key` and `record_id`."""
    key = ids.record_key(F.col("doi"), F.col("title"))
    return records(t).withColumn("record_key", key).withColumn("record_id", ids.record_id(F.col("record_key")))


def norm_title_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


KEYED_SQL = f"""keyed AS (
  SELECT *, 'R' || substr(md5(record_key), 1, 9) AS record_id FROM (
    SELECT *, CASE WHEN doi <> '' THEN doi ELSE 'T:' || {norm_title_sql('title')} END AS record_key
    FROM records))"""


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def pattern_sql(pattern: str) -> str:
    """The pattern for an engine whose classes are ASCII: explicit letter classes at the edges."""
    p = pattern
    if p.startswith(r"\b"):
        p = r"(?:^|[^\p{L}\p{N}_])" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return "(?i)" + p.replace(r"\w", r"[\p{L}\p{N}_]")


def hits_sql(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern_sql(pattern)}')"


def string_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def md5_modulo_sql(text: str, n: int) -> str:
    """MD5 as a 128-bit number modulo n, from its two 64-bit halves."""
    high = f"('0x' || substr(md5({text}), 1, 16))::UBIGINT::HUGEINT"
    low = f"('0x' || substr(md5({text}), 17, 16))::UBIGINT::HUGEINT"
    return f"(((({high}) % {n}) * {(1 << 64) % n} + ({low}) % {n}) % {n})::BIGINT"
