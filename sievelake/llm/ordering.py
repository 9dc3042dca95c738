"""Training-order materialisation: token sequences in a keyed random order, as shards of records.

Every sequence (a piece of one document, at most `length` ids) has an index made of its document
and its piece; a keyed Feistel permutation of the index space, walked in cycles until it lands
inside, gives its key. Equal ranges of keys are the shards, one task and one file each; the rank
of a record among all keys is its global slot. Ids are made and moved once: the exact number of
sequences need not be known before they are written.

Where ids of documents repeat or are missing, the index also has a digest of the text, and equal
rows are numbered, so that no id and no group of copies shares a range of keys. Equal rows are one
row with a count until they are encoded.

Layout of a folder:
    shards/shard=S/   records (key, doc_id, piece, start, n, ids) in the order of their slots; `ids` has
                      the same stride everywhere: `length` little-endian numbers, padded with `end_id`
    manifest/         (shard, records, first_slot)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.llm.common import cut
from sievelake.llm.tokens import cut_places, encoder
from sievelake.operators.skew import spread_join

ROUNDS = 6
#: Bytes of text that one shard is made from, until there are `MOST_SHARDS`; then shards grow with the table.
SHARD_BYTES = 16 << 20
MOST_SHARDS = 1 << 16
#: Copies of a row, and bytes of them, that are encoded together; records handed on together.
COPIES, COPY_BYTES, RECORDS = 256, 1 << 20, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, domain: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 .. domain - 1, applied to `index` (uint64; domain up to 2**62)."""
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + _mix(np.array([seed & (2**64 - 1)], np.uint64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= domain]
    return out


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """`rows` with `first` and `copies`: equal rows once per some copies, numbered from `first`, others as they are."""
    joined = spread_join(rows, repeated.select("digest", "n"), ["digest"])
    single = joined.where("n IS NULL").select(*rows.columns, F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("copies"))
    held = joined.where("n IS NOT NULL").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("key", "text", "n")])
    step = F.least(F.lit(COPIES), F.greatest(F.lit(1), F.floor(F.lit(COPY_BYTES) / (F.octet_length("text") + 1)))).cast("long")
    held = held.withColumn("step", step).withColumn("first", F.explode(F.expr("sequence(0L, n - 1, step)")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.select(*rows.columns, "first", F.least(F.col("step"), F.col("n") - F.col("first")).alias("copies"))
    return single.unionByName(held.repartition(parts, "digest", "first"))


def written(docs: DataFrame, folder: str, vocabulary: str, length: int = 256, end_id: int = 50256, seed: int = 0,
            key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the sequences of `docs` to `folder` and return its manifest.

    A document is its ids and then `end_id`, cut into sequences of `length`, of which the first
    may be shorter; a null text counts as empty and gives one sequence. The order depends on the
    seed and on the rows, not on partitions: other rows in the table can change the index space (smallest
    and largest id, longest text), and with it the order. Where an id repeats or several rows
    have none, all indexes are hashes of id, piece, text and the number among equal rows. Records of
    one key are in the order of id, piece and ids. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("-")), F.lit(":"), "text"), 256)))
    size = F.octet_length("text").cast("long")
    groups = rows.groupBy("key", "digest").agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.sum(size).alias("total"))
    per_id = groups.groupBy("key").agg(F.sum("n").alias("rows"), F.max("n").alias("copies"), F.max("longest").alias("longest"), F.sum("total").alias("total"))
    facts = per_id.agg(F.min("key"), F.max("key"), F.max("longest"), F.sum("total"), F.max("rows"), F.max("copies")).first()
    low, high, longest, total, of_id, copies = (v or 0 for v in facts)
    # A text has no more ids than bytes, so this many sequences are enough for any document.
    most = (longest + 1 + length - 1) // length
    domain = (high - low + 2) * most
    hashed = of_id > 1 or domain >= 1 << 62  # ids repeat, or are too far apart: hashes are permuted instead
    domain = 1 << 62 if hashed else domain
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))
    width = -(-domain // shards)
    kind = "<u2" if _size(vocabulary) <= 1 << 16 else "<u4"
    names = ["shard", "key", "doc_id", "piece", "start", "n", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(vocabulary)
        index, salts, records = [], [], []

        def handed_on() -> pa.RecordBatch:
            places = np.array(index, np.uint64)
            if hashed:
                places = _mix(places + _mix(np.array(salts, np.uint64))) >> np.uint64(2)
            keys = permuted(places, domain, seed).astype(np.int64)
            columns = [keys // width, keys, *zip(*records)]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            for held in (index, salts, records):
                held.clear()
            return out

        for batch in batches:
            for d, t, salt, first, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = np.array([*to_ids(t), end_id], dtype=kind)
                place = 0 if d is None else d - low + 1
                for k, (s, n) in enumerate(cut_places(len(ids), length)):
                    own = np.full(length, end_id, dtype=kind)
                    own[:n] = ids[s:s + n]
                    record = (d, k, s, n, own.tobytes())
                    for copy in range(first, first + copies):
                        index.append(place * most + k & 2**64 - 1)
                        salts.append(salt + copy & 2**64 - 1)
                        records.append(record)
                    if len(index) >= RECORDS:
                        yield handed_on()
        if index:
            yield handed_on()

    schema = "shard int, key long, doc_id long, piece int, start long, n int, ids binary"
    if copies > 1:
        rows = _numbered(rows, cut(groups.where("n > 1").select("digest", "n")))
    else:
        rows = rows.withColumns({"first": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    salt = F.xxhash64("digest") if hashed else F.lit(0).cast("long")
    records = rows.select("key", "text", salt.alias("salt"), "first", "copies").mapInArrow(encode, schema)
    order = ["shard", "key", "doc_id", "piece", "ids"]
    records.repartitionById(shards, "shard").sortWithinPartitions(*order).write.partitionBy("shard").option(
        "compression", "zstd").parquet(f"{folder}/shards")
    sizes = stored(spark, folder).groupBy("shard").agg(F.count("*").alias("records"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_SHARDS rows
    sizes.withColumn("first_slot", F.coalesce(F.sum("records").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _size(vocabulary: str) -> int:
    import json

    with open(vocabulary, encoding="utf-8") as f:
        return len(json.load(f)["model"]["vocab"])


def stored(spark: SparkSession, folder: str) -> DataFrame:
    schema = "key long, doc_id long, piece int, start long, n int, ids binary, shard int"
    return spark.read.schema(schema).parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, first_slot: int = 0, slots: int | None = None) -> DataFrame:
    """Records with `slot`, from `first_slot` on, `slots` of them: a run resumes where it stopped.

    The manifest tells the shards that hold those slots, and the record's row in the shard's only
    file its place, so nothing else is read.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    end = first_slot + slots if slots is not None else None
    wanted = manifest.where(F.col("first_slot") + F.col("records") > first_slot)
    rows = stored(spark, folder).withColumn("position", F.col("_metadata.row_index"))
    if first_slot or slots is not None:
        wanted = wanted.where(F.col("first_slot") < end) if end is not None else wanted
        low, high = wanted.agg(F.min("shard"), F.max("shard")).first()
        rows = rows.where(F.col("shard").between(low, high) if low is not None else F.lit(False))
    rows = rows.join(wanted.drop("records"), "shard").withColumn("slot", F.col("first_slot") + F.col("position")).drop("first_slot")
    rows = rows.where(F.col("slot") >= first_slot) if first_slot else rows
    return rows.where(F.col("slot") < end) if end is not None else rows
