"""Exact duplicates, found through an extendible-hash index kept in shared files.

Two texts are equal when the same bytes are left after white space is deleted. Three tables make
the index, all in one folder that every executor sees:

- `rows`: one row per document. Each task compares its own texts first, so a text's bytes are
  there once per task; that row is the *entry* its other rows name.
- `directory`: the buckets, as ranges of hash keys. Doubling the directory halves the ranges;
  a bucket that holds too many bytes takes both halves, any other keeps its old one.
- `buckets`: what owner tasks found. A task owns whole buckets, reads their entries in key order,
  chains texts whose keys collide and compares bytes. The first of equal texts is their `class`.

A bucket that is too large although it has one key cannot be split: its entries go to pages, and
the first text of each class of every page meets the others in the next round.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.llm.common import cut

BLANKS = b" \t\n\x0b\x0c\r"
#: Bits of a key, and bytes of entries that a bucket holds before it is split.
BITS, CAPACITY = 63, 8 << 20
#: A task forgets its texts when it holds so many bytes or rows of them; a page has so many entries at least.
WINDOW, WINDOW_ROWS, FAN = 32 << 20, 1 << 20, 16
#: Directories of up to so many slots are broadcast; larger ones are joined.
SMALL_DIRECTORY = 1 << 16
#: What an entry takes besides its text.
ENTRY = 64


@dataclass(frozen=True)
class Index:
    """Where the three tables of an index are."""

    folder: str

    @property
    def rows(self) -> str:
        return f"{self.folder}/rows"

    @property
    def directory(self) -> str:
        return f"{self.folder}/directory"

    @property
    def buckets(self) -> str:
        return f"{self.folder}/buckets"


def _entered(bits: int, window: int):
    """Rows (id, points, text bytes) as rows of the index."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen, held, rows = TaskContext.get().partitionId() << 33, {}, 0, 0
        for batch in batches:
            first, keys, digests, bodies, start = [], [], [], [], row
            for text in batch.column(2).to_pylist():
                body = (text or b"").translate(None, BLANKS)
                digest = hashlib.sha256(body).digest()
                key = int.from_bytes(digest[:8], "big") >> (64 - bits) << (BITS - bits)
                if held > window or rows >= WINDOW_ROWS:
                    seen, held, rows = {}, 0, 0
                chain = seen.setdefault(key, [])
                same = next((entry for entry, other in chain if other == body), None)
                if same is None:
                    chain.append((row, body))
                    held += len(body) + ENTRY
                first.append(row if same is None else same)
                bodies.append(body if same is None else None)
                keys.append(key)
                digests.append(digest)
                row, rows = row + 1, rows + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(range(start, row), pa.int64()), pa.array(first, pa.int64()),
                 pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())],
                ["id", "points", "row", "entry", "key", "digest", "body"])

    return enter


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, page, paged, key, entry, body), sorted by the first two and the key, as classes.

    Only the texts of one key are held; those of paged buckets go on with the first of their class.
    """
    now, chain = None, []
    for batch in batches:
        out = [[] for _ in range(6)]
        for bucket, page, paged, key, entry, body in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, page, key) != now:
                now, chain = (bucket, page, key), []
            place = next((i for i, (_, other) in enumerate(chain) if other == body), len(chain))
            if place == len(chain):
                chain.append((entry, body))
            first = chain[place][0]
            for column, value in zip(out, (bucket, key, place, entry, first, body if paged and first == entry else None)):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["bucket", "key", "place", "entry", "class", "body"])


FOUND = "bucket long, key long, place int, entry long, class long, body binary"


def directory(sizes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Buckets of rows (key, entries, bytes), one per key: (slot, bucket, depth, keys, entries, bytes, pages).

    Also the depth from which doubling started; `slot` is the range of that depth a bucket lies
    in. A bucket is named by the first key of its range, the 2 ** (63 - depth) keys from it on.
    Every doubling counts again only what lies in buckets that are still too large.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    base = max(0, min(40, (int(total) // capacity).bit_length()))
    open_, depth, done = sizes, base, []
    while True:
        range_ = F.shiftright("key", BITS - depth)
        cells = cut(open_.groupBy(range_.alias("range")).agg(
            F.count("*").alias("keys"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes")))
        over = (F.col("bytes") > capacity) & (F.col("keys") > 1) & F.lit(depth < BITS)
        done.append(cells.where(~over).withColumn("depth", F.lit(depth)))
        full = cells.where(over).select("range")
        if full.isEmpty():
            break
        open_ = open_.withColumn("range", range_).join(full, "range", "left_semi").drop("range")
        depth += 1
    found = functools.reduce(DataFrame.unionByName, done)
    pages = F.greatest(F.lit(1), F.least(F.ceil(F.col("bytes") / capacity), F.ceil(F.col("entries") / FAN)))
    bucket = F.expr(f"shiftleft(range, {BITS} - depth)")
    return found.select(
        F.shiftright(bucket, BITS - base).alias("slot"), bucket.alias("bucket"), "depth", "keys", "entries", "bytes",
        pages.cast("int").alias("pages")), base


def built(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = BITS,
          window: int = WINDOW) -> None:
    """Writes the index of all rows of `docs` into its folder, which must be new.

    A null text counts as empty. `bits` below 63 make keys collide, which is of use in tests.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.char_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("points"),
                       F.col(text).cast("string").cast("binary").alias("text"))
    kinds = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("points", T.IntegerType())]
                         + [T.StructField(c, T.LongType()) for c in ("row", "entry", "key")]
                         + [T.StructField(c, T.BinaryType()) for c in ("digest", "body")])
    rows.mapInArrow(_entered(bits, window), kinds).write.parquet(index.rows)
    entries = spark.read.schema(kinds).parquet(index.rows).where("body IS NOT NULL").select("key", "entry", "body")
    sizes = cut(entries.groupBy("key").agg(F.count("*").alias("entries"), F.sum(F.octet_length("body") + F.lit(ENTRY)).alias("bytes")))
    cells, base = directory(sizes, capacity)
    cells.write.parquet(index.directory)
    cells = spark.read.parquet(index.directory)

    # The buckets of a slot, in order: an entry belongs to the last that starts at its key or before.
    slots = cells.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("bucket", "pages"))).alias("starts"))
    if slots.limit(SMALL_DIRECTORY + 1).count() <= SMALL_DIRECTORY:
        slots = F.broadcast(slots)
    at = F.element_at(F.filter("starts", lambda s: s["bucket"] <= F.col("key")), -1)
    pages = F.col("at.pages")
    placed = entries.withColumn("slot", F.shiftright("key", BITS - base)).join(slots, "slot").withColumn("at", at).select(
        F.col("at.bucket").alias("bucket"), F.pmod(F.xxhash64("entry"), pages).cast("int").alias("page"),
        (pages > 1).alias("paged"), "key", "entry", "body")
    found = _owned(placed)
    left, more = found.where("body IS NOT NULL").count(), None
    while left:
        again = found.where("body IS NOT NULL")
        # Pages of a size that shrinks the rest; what does not shrink is different texts of one key.
        counts = again.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))
        pages = F.col("pages") if more is None or left < 0.5 * more else F.lit(1)
        counts = counts.select("bucket", F.least(F.ceil(F.col("bytes") / capacity), F.ceil(F.col("n") / FAN)).alias("pages"))
        again = again.join(counts, "bucket").withColumn("pages", F.greatest(F.lit(1), pages)).select(
            "bucket", F.pmod(F.xxhash64("entry"), F.col("pages")).cast("int").alias("page"), (F.col("pages") > 1).alias("paged"), "key", "entry", "body")
        merged = _owned(again)
        later = merged.select(F.col("entry").alias("class"), F.col("class").alias("later"), F.col("place").alias("later_place"))
        found = cut(found.drop("body").join(later, "class", "left").select(
            "bucket", "key", F.coalesce("later_place", "place").alias("place"), "entry", F.coalesce("later", "class").alias("class"),
        ).join(merged.where("body IS NOT NULL").select("entry", "body"), "entry", "left").select("bucket", "key", "place", "entry", "class", "body"))
        left, more = merged.where("body IS NOT NULL").count(), left
    found.drop("body").write.parquet(index.buckets)


def _owned(placed: DataFrame) -> DataFrame:
    """The classes of placed entries, each bucket's page in one task."""
    rows = placed.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "key", "entry")
    return cut(rows.mapInArrow(_compared, FOUND))


def judged(docs: DataFrame, index: Index, key: str = "doc_id") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of the documents in the index.

    Of equal texts the row with the most code points before deletion stays, then the one with the
    smallest id, a missing id last; of rows repeated with their id, any one. A row without text is
    an empty one, and equal to one of white space only. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = spark.read.parquet(index.rows).drop("body", "key")
    classes = spark.read.parquet(index.buckets).select("entry", "class")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), "id", "row"))
    # By entry first: of a text in a third of all rows, one row per task is left.
    entries = cut(rows.groupBy("entry").agg(F.count("*").alias("n"), best.alias("best")).join(classes, "entry"))
    groups = entries.groupBy("class").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    stays = entries.select("entry", "class").join(groups, "class").select("entry", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("stays"))
    return rows.join(stays, "entry").select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    ).withColumnRenamed("id", key)


def deduplicated(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`judged` rows of an index built in `folder`; other columns of `docs` are left out."""
    index = Index(folder)
    built(docs, index, key, text, **options)
    return judged(docs, index, key)
