"""Documents that arrive in a folder are matched to the records still waiting for one.

A folder is polled: every look at a file is a row with its size, time of change and text. A
stream with state per path waits until a file looks the same twice in a row, and hands it on
once; a file that changes is handed on again when it has settled anew. Looks are taken in the
order of their time, up to the watermark, by timeouts: how they are dealt to batches makes no
difference as long as none is later than `LATE`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievelake.operators.documents import HOW, NO_RECORD, SEVERAL, claimed, record_candidates
from sievelake.session import cut

#: A look at a file. A look with an empty path tells the time only: a poll that found nothing.
LOOK = "path string, size long, modified timestamp, seen_at timestamp, text string, first_page string"
SETTLED = "path string, size long, modified timestamp, settled_at timestamp, text string, first_page string"
#: As `SETTLED`, times in microseconds.
MICROS = "path string, size long, modified long, settled_at long, text string, first_page string"
HANDED = ["path", "size", "modified", "settled_at", "text", "first_page"]
#: Per bucket: a JSON object of path to (last size, last time of change, those handed on last, looks ahead
#: of the watermark), looks being (seen, size, changed, text, first_page).
STATE = "paths string"
#: Paths that agree in their hash modulo this number share one state and one call, as a call costs far more than a
#: path. It is part of the state's key: a stream that goes on from a checkpoint needs the number it began with.
BUCKETS = 1024
#: A look may arrive so much later than others; later ones are left out.
LATE = "10 seconds"
VERDICTS = "path string, size long, modified timestamp, settled_at timestamp, record_id string, how string, candidates long, batch int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _passed(last: tuple, given: tuple, ahead: list[tuple], watermark: int) -> tuple[tuple, tuple, list[tuple], list[tuple]]:
    """(last, given, looks still ahead, looks to hand on) of one path when the watermark has come so far.

    `last` is the last look behind the watermark, `given` the one that was handed on last. Sizes or
    times of change that are not known agree with each other, but not with what an earlier call has
    left, so a file of unknown size is handed on whenever it settles anew.
    """
    last, given = (tuple(math.nan if v is None else v for v in k) for k in (last, given))
    ahead, out, n = sorted(ahead, key=lambda r: [(v is not None, v or 0) for v in r[:3]]), [], 0
    while n < len(ahead) and ahead[n][0] // 1000 <= watermark:
        now = tuple(ahead[n][1:3])
        if last == now and given != last:
            out.append(ahead[n])
            given = last
        last = now
        n += 1
    last, given = (tuple(None if v is None or v != v else v for v in k) for k in (last, given))
    return last, given, ahead[n:], out


def _looks(rows: pd.DataFrame) -> Iterator[tuple]:
    """(seen, size, changed, text, first_page); where others of the frame are NULL, numbers come as doubles."""
    whole = lambda c: [None if v is None or v != v else int(v) for v in rows[c].tolist()]
    return zip(whole("seen"), whole("size"), whole("changed"), rows["text"].tolist(), rows["first_page"].tolist())


def _wait(ahead: int, watermark: int, state: GroupState) -> None:
    """A timeout comes when the watermark is beyond its time; `ahead` is the first look's time in microseconds."""
    state.setTimeoutTimestamp(max(ahead // 1000 - 1, watermark + 1))


def _settle(key: tuple, looks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hands a file on when two looks in a row have the same size and time of change.

    State of one path: the last look behind the watermark, the look that was handed on last, and the
    looks ahead of the watermark. Texts of looks behind the watermark are not kept. A call takes all
    that the watermark has passed.
    """
    *known, kept = state.get if state.exists else (None, None, None, None, "[]")
    ahead = [tuple(r) for r in json.loads(kept)]
    if not state.hasTimedOut:
        for rows in looks:
            ahead += _looks(rows)
    watermark = state.getCurrentWatermarkMs()
    last, given, ahead, out = _passed(tuple(known[:2]), tuple(known[2:]), ahead, watermark)
    state.update((*last, *given, json.dumps(ahead)))
    if ahead:
        _wait(ahead[0][0], watermark, state)
    yield pd.DataFrame([(key[0], r[1], r[2], r[0], *r[3:]) for r in out], columns=HANDED, dtype=object)


def _settle_bucket(key: tuple, looks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """As `_settle` for all paths of a bucket, each by itself; looks without a path only tell the time."""
    paths = json.loads(state.get[0]) if state.exists else {}
    if not state.hasTimedOut:
        for rows in looks:
            for path, look in zip(rows["path"].tolist(), _looks(rows)):
                if path:
                    paths.setdefault(path, [None, None, None, None, []])[4].append(look)
    watermark, first, out = state.getCurrentWatermarkMs(), None, []
    for path, (*known, ahead) in paths.items():
        if ahead:
            last, given, ahead, handed = _passed(tuple(known[:2]), tuple(known[2:]), ahead, watermark)
            paths[path] = [*last, *given, ahead]
            out += [(path, r[1], r[2], r[0], *r[3:]) for r in handed]
            first = min(first or ahead[0][0], ahead[0][0]) if ahead else first
    state.update((json.dumps(paths, ensure_ascii=False),))
    if first is not None:
        _wait(first, watermark, state)
    yield pd.DataFrame(out, columns=HANDED, dtype=object)


def settled_files(looks: DataFrame, late: str = LATE) -> DataFrame:
    """`SETTLED` rows of a stream of `LOOK` rows: every file once per state in which it settled.

    `settled_at` is the time of the second of the two looks. Times are microseconds in the state,
    whatever the time zone of the session.
    """
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")
    known = looks.withWatermark("seen_at", late).where("path <> '' OR seen_at IS NOT NULL").select(
        bucket, "path", "size", F.unix_micros("modified").alias("changed"), "seen_at", F.unix_micros("seen_at").alias("seen"), "text", "first_page")
    settled = known.groupBy("bucket").applyInPandasWithState(
        _settle_bucket, MICROS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return settled.select(
        "path", "size", F.timestamp_micros("modified").alias("modified"), F.timestamp_micros("settled_at").alias("settled_at"), "text", "first_page")


def open_records(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records (record_id, title, doi, status) that have no document yet."""
    waiting = records.where(F.col("status") != "ok")
    return waiting.join(verdicts.where("record_id IS NOT NULL").select("record_id"), "record_id", "left_anti")


def judged_files(settled: DataFrame, records: DataFrame, share: float = 0.9) -> DataFrame:
    """Verdicts on settled files, in the order of (settled_at, path), over records that are open.

    A record goes to the first file that fits it alone; later files no longer see it. What fits
    none is left with its reason and comes back only when it changes.
    """
    place = F.struct("settled_at", "path", "size", "modified")
    files = settled.withColumn("doc_id", F.sha2(F.concat_ws("\u0000", "path", F.col("size").cast("string"), F.col("modified").cast("string"), F.col("settled_at").cast("string")), 256))
    found = record_candidates(files.select("doc_id", "text", "first_page"), records, share)
    verdicts = claimed(found.join(files.select("doc_id", place.alias("place")), "doc_id"))
    return files.select("doc_id", "path", "size", "modified", "settled_at").join(verdicts, "doc_id", "left").select(
        "path", "size", "modified", "settled_at", "record_id", F.coalesce("how", F.lit(NO_RECORD)).alias("how"),
        F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def verdicts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """`VERDICTS` written so far; an empty table before the first."""
    try:
        return spark.read.schema(VERDICTS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in VERDICTS.split(", "))])


def watch_inbox(spark: SparkSession, looks: str, records: DataFrame, verdicts: str, checkpoint: str, late: str = LATE,
                files_per_batch: int | None = None) -> StreamingQuery:
    """Judges what the looks (JSON lines of `LOOK` in the folder) say has settled, then stops.

    Verdicts are written per batch; a batch that is repeated after a failure replaces its own.
    """

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = verdicts_so_far(session, verdicts).where(F.col("batch") != number)
        settled = cut(batch)
        if settled.isEmpty():
            return
        judged = judged_files(settled, open_records(records, before))
        judged.write.mode("overwrite").parquet(f"{verdicts}/batch={number}")

    reader = spark.readStream.schema(LOOK)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # state on disk, not on the heap; read when the query starts
    try:
        return (
            settled_files(reader.json(looks), late).writeStream.foreachBatch(handle).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(STORE, old) if old is not None else spark.conf.unset(STORE)


def left_files(verdicts: DataFrame) -> DataFrame:
    """(path, how): files whose latest state fits no record."""
    last = verdicts.groupBy("path").agg(F.max_by(F.struct("record_id", "how"), "settled_at").alias("v"))
    return last.where("v.record_id IS NULL").select("path", "v.how")


__all__ = ["HOW", "LATE", "LOOK", "NO_RECORD", "SETTLED", "SEVERAL", "judged_files", "left_files", "open_records", "settled_files",
           "verdicts_so_far", "watch_inbox"]
