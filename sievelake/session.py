"""Session helpers: building a local session, and cutting lineage in shared storage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Setting of a session that has few, small files: text tables are dealt over so many partitions.
SPREAD_TEXT = "sievelake.text.partitions"


def local_session(cpus: str = "8", app: str = "sievelake") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config(SPREAD_TEXT, cpus if cpus.isdigit() else "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that survives executor loss: `spark.checkpoint.dir` of the session.

    A machine-local folder is used only by local sessions that name none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"sievelake-{application_id}-")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so later steps do not recompute it.

    A written table (unlike a cached one) is still there when an executor is lost, and the
    columnar form keeps statistics, so adaptive joins after it see its true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sievelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_work(df: DataFrame, *columns: str) -> DataFrame:
    """Spread rows over all shuffle partitions before work that is costly per row.

    Adaptive execution sizes partitions by bytes and would put few, small but slow rows
    into one task; an explicit number of partitions is left alone.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns)


def not_broadcast(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is sorted and merged, whatever its size looks like.

    Rows that repeat the same few values pack to almost nothing, so by the bytes of its file a
    table of millions of rows would be broadcast, and be unpacked in the driver.
    """
    return df.hint("merge")
