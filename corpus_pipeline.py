"""A training corpus from `documents`: quality rules, language, near duplicates, mixture, packing.

Every stage works on all rows that the one before it kept. All but the last return the columns
of documents; each result is written as Parquet and read again by the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import language, mixing, packing, quality_rules, shingle_join, tokens
from sievelake.llm.common import WORD, cut, fresh, table

#: Below this probability a language is not believed, and the document goes.
LANGUAGE_SCORE = 0.5
#: Rows that go to Python at a time: texts are long, and several tasks share an executor's memory.
ROWS_AT_ONCE = 1000


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; an empty or null text has too few words and goes."""
    out = fresh("quality", docs)
    return quality_rules.judged(docs, out=out).where(f"{out}.kept").drop(out)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a score of `LANGUAGE_SCORE` or more.

    The model learns from the labelled documents that are not held out. Without any it can
    recognise nothing, and all documents stay.
    """
    _short_batches(spark)
    model = language.fitted(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    if model is None:
        return docs
    out = fresh("language", docs)
    found = language.predicted(docs, model, out=out)
    return found.where((F.col(f"{out}.lang") != language.UNKNOWN) & (F.col(f"{out}.score") >= LANGUAGE_SCORE)).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 or more, the row with the smallest doc_id.

    Of repeated rows one stays; documents without words are linked with nothing and stay.
    """
    _short_batches(spark)
    row = fresh("row", docs)
    own = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = cut(shingle_join.linked(own, words=5, percent=80, row=row, group=True))
    kept = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("key").isNull(), "key", "row"))["row"].alias(row)).select(row)
    alone = found.where("group IS NULL").select(F.col("row").alias(row))
    return own.join(kept.unionByName(alone), row, "left_semi").drop(row)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mixture has them: some sources in part, others up to twice."""
    size = fresh("size", docs)
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)))
    return mixing.repeated(sized, size).drop(size)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), sequences of 1024 tokens."""
    _short_batches(spark)
    rows = tokens.pieces(docs, tokens.vocabulary(), length=1024, end_id=2, with_ids=False)
    return packing.packed(rows, size=1024).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("language id", languages),
    ("n-gram jaccard join", near_duplicates),
    ("mixing", mixture),
    ("best-fit packing", packed),
]

#: Learned languages and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
