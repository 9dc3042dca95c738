"""Writing results: tagged stage tables, RIS, append-only logs, guarded files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import strip


def ris_text(title: Column, abstract: Column, venue: Column, year: Column, doi: Column, issn: Column,
             url: Column, authors: Column, keywords: Column, is_conference: Column) -> Column:
    """One record as RIS lines; blank fields have no line, line breaks become spaces."""
    flat = lambda c: strip(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "))

    def line(tag: Column | str, value: Column) -> Column:
        name = F.lit(tag) if isinstance(tag, str) else tag
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(name, F.lit("  - "), flat(value)))

    single = F.array_compact(F.array(
        F.concat(F.lit("TY  - "), F.when(is_conference, "CONF").otherwise("JOUR")),
        line("TI", title), line("AB", abstract), line(F.when(is_conference, "T2").otherwise("JO"), venue),
        line("PY", year), line("DO", doi), line("SN", issn), line("UR", url)))
    many = lambda tag, values: F.transform(
        F.filter(values, lambda v: strip(v) != ""), lambda v: F.concat(F.lit(f"{tag}  - "), flat(v)))
    end = F.array(F.lit("ER  - "), F.lit(""))
    return F.array_join(F.concat(single, many("AU", authors), many("KW", keywords), end), "\n")


def write_ris(records: DataFrame, path: str) -> None:
    """Records (the columns of the search mapping) as RIS text files."""
    names = ("title", "abstract", "venue", "year", "doi", "issn", "url", "authors", "keywords", "is_conference")
    records.select(ris_text(*[F.col(n) for n in names]).alias("value")).write.text(path)


def write_stage(rows: DataFrame, path: str, decision: str = "decision", columns: list[str] | None = None) -> None:
    """One tagged table per stage, partitioned by its decision (included / excluded)."""
    kept = rows if columns is None else rows.select(*[c for c in columns if c in rows.columns], decision)
    kept.write.mode("overwrite").partitionBy(decision).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to a log; refuses when the columns there are others."""
    spark = rows.sparkSession
    try:
        present = spark.read.parquet(path).columns
    except AnalysisException:
        present = None
    if present is not None and present != rows.columns:
        raise ValueError(f"the log has the columns {present}, not {rows.columns}")
    rows.write.mode("append").parquet(path)


def write_guarded(rows: DataFrame, path: str, force: bool = False) -> None:
    """Writes a table that people fill in: an existing one is kept unless forced."""
    rows.write.mode("overwrite" if force else "errorifexists").parquet(path)
