"""Jaccard similarity join of word n-grams with adaptive multi-match prefixes.

1. Every text becomes its set of hashed shingles; texts with equal sets are one class.
2. Of each set the shingles with the lowest hashes are dealt by value, as many as it may have beside
   those it shares with a partner, and some more: linked sets have at least these some in common
   there. A set of which too few are found in other sets of fitting size is done. So about a sixth
   of all shingles are moved for the whole table, and all shingles of the few sets that are left.
3. These are dealt whole. A shingle is of use to a set only if a set of fitting size has it
   too; a set whose useful shingles are too few for any partner is done. Each round of this
   narrows the sizes a set may be linked with, so that few sets go on, and exactly: no shingle
   that two linked sets share is ever dropped.
4. The rest is ordered by frequency. A set's prefix holds its rarest shingles and is the longer the
   more candidates it would meet: with l more shingles, partners must share l of the prefix.
5. Groups of near copies would meet in all pairs. So every set is first compared with one hub of
   its prefix; what is linked then is one component, and only sets of different components
   become candidates. That gives the same components as all links.

A task holds `BUCKET` shingles, the ids of the sets of one input partition, and the holders of the most
frequent shingle it is dealt (16 bytes each): one for every different set that has it, once per
input partition; copies do not count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import cut
from sievelake.llm.components import components

#: Shingles that one task compares, and that one task gathers before it hands them on.
BUCKET = 1_000_000
#: Bytes of text that are hashed at a time.
STRETCH = 1 << 21
ROUNDS = 5
#: Cost of verifying a candidate, in steps of the candidate search.
VERIFY = 4
EXTRA = (1, 2, 4, 8)
#: A shingle in so many is dealt beyond those that a set need not share.
SPARE = 16
#: Keys of remaining sets that are broadcast; more are joined by key.
WANTED = 1_000_000

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@functools.cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its 64-bit value (A-Z as a-z) and whether it is white space."""
    values = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return values, blank


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    steps = [np.full(STRETCH + 1, b, np.uint64) for b in (_BASE, _INVERSE)]
    for s in steps:
        s[0] = 1
    return tuple(np.multiply.accumulate(s) for s in steps)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _stretch(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words in at most STRETCH bytes that end no word half-way."""
    values, blanks = _bytes()
    blank = blanks[data]
    edges = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _powers()
    sums = np.r_[np.uint64(0), np.cumsum(values[data] * up[:len(data)], dtype=np.uint64)]
    return starts, _mix((sums[ends] - sums[starts]) * down[starts])


def _long_word(data: np.ndarray) -> np.uint64:
    """The same hash for a word longer than STRETCH."""
    values, _ = _bytes()
    total, up = 0, _powers()[0]
    for at in range(0, len(data), STRETCH):
        part = data[at:at + STRETCH]
        total += int(np.sum(values[part] * up[:len(part)], dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return _mix(np.array([total & (1 << 64) - 1], np.uint64))[0]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all words of UTF-8 bytes; equal words have equal hashes."""
    if len(data) <= STRETCH:
        return _stretch(data)
    _, blanks = _bytes()
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + STRETCH, len(data))
        if end < len(data):
            gaps = np.flatnonzero(blanks[data[at:end]])
            if not len(gaps):  # one word fills the stretch
                more = np.flatnonzero(blanks[data[end:]])
                end += int(more[0]) if len(more) else len(data) - end
                starts.append(np.array([at]))
                hashes.append(np.array([_long_word(data[at:end])]))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        s, h = _stretch(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], words: int = 3) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of each text; see `linked`."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < STRETCH // 2):
            group.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1]) + 1
            at += 1
        places = np.cumsum([0, *(len(g) + 1 for g in group)])
        starts, h = word_hashes(np.frombuffer(b"\n".join(group), np.uint8))
        first = np.searchsorted(starts, places)
        s = np.full(len(h), words, np.uint64)
        if len(h) >= words:
            s = s[:len(h) - words + 1]
            for k in range(words):
                s = _mix(s * np.uint64(0x9FB21C651E98DF25) + h[k:len(h) - words + 1 + k])
        for a, b in zip(first[:-1], first[1:]):
            n = int(b - a)
            if n >= words:
                out.append(np.unique(s[a:b - words + 1]))
            elif n:
                whole = np.array([n], np.uint64)
                for x in h[a:b]:
                    whole = _mix(whole * np.uint64(0x9FB21C651E98DF25) + x)
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _class_of(shingles: np.ndarray) -> int:
    """A number that equal sets share."""
    spread = _mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))
    both = np.array([np.sum(spread, dtype=np.uint64), np.bitwise_xor.reduce(spread) ^ np.uint64(len(shingles))])
    return int(_mix(_mix(both[:1]) + both[1:]).astype(np.int64)[0])


def _low(bits: int) -> int:
    """Bits of a shingle beside those that name its bucket."""
    return min(48, 64 - bits)


def _least(n, percent: int):
    """The fewest shingles that a partner of a set of n shares, and so its least size."""
    return -(-n * percent // 100)


def _spare(n):
    """How many shingles a set of n deals beyond those it may have alone; linked sets share the smaller's number."""
    return 1 + n // SPARE


def _batches(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


# What is dealt to buckets and homes: per row, arrays of sets (id, size, largest partner) and, set
# after set, their shingles; `counts` says how many each has.
_FIELDS = "ids binary, sizes binary, most binary, counts binary, low binary, high binary, df binary"


def _split(tokens: np.ndarray) -> tuple[bytes, bytes]:
    return (tokens & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (tokens >> np.uint64(32)).astype("<u2").tobytes()


def _joined(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)


def _row(ids, sizes, most, counts, tokens, df=None) -> dict:
    low, high = _split(tokens)
    return {"ids": ids.astype("<i8").tobytes(), "sizes": sizes.astype("<u4").tobytes(), "most": most.astype("<u4").tobytes(),
            "counts": counts.astype("<u4").tobytes(), "low": low, "high": high, "df": b"" if df is None else df.astype("<u4").tobytes()}


def _unrow(r) -> tuple[np.ndarray, ...]:
    numbers = [np.frombuffer(getattr(r, c), "<u4").astype(np.int64) for c in ("sizes", "most", "counts", "df")]
    return np.frombuffer(r.ids, "<i8"), *numbers[:3], _joined(r.low, r.high), numbers[3]


def _dealt(ids, sizes, most, owner, tokens, bits: int) -> Iterator[dict]:
    """Rows for buckets: `tokens` by their first `bits` bits, the others kept; owners ascending."""
    bucket = (tokens >> np.uint64(_low(bits))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(ends)):
        own = order[ends[b]:ends[b + 1]]
        present, counts = np.unique(owner[own], return_counts=True)
        yield {"bucket": int(b)} | _row(ids[present], sizes[present], most[present], counts, tokens[own] & np.uint64((1 << _low(bits)) - 1))


def _shared(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, ...]:
    """Of one bucket: its sets (ids, sizes, largest partners), and the shingles that a set of fitting
    size has too (value, owner, number of the shingle)."""
    parts = [_unrow(r) for r in pdf.itertuples()]
    ids, sizes, most = (np.concatenate([p[k] for p in parts]) for k in range(3))
    counts, tokens = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
    ids, first, which = np.unique(ids, return_index=True, return_inverse=True)
    sizes, most = sizes[first], most[first]
    owner = np.repeat(which, counts)
    # Alone in the bucket: of no use. Copies of a set, from several partitions, count once.
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    alone = np.r_[True, t[1:] != t[:-1]] & np.r_[t[1:] != t[:-1], True]
    order = order[~alone]
    t, owner = tokens[order], owner[order]
    order = np.lexsort((owner, sizes[owner], t))
    t, owner = t[order], owner[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])] if len(t) else np.zeros(0, bool)
    t, owner = t[new], owner[new]
    rank = np.cumsum(np.r_[0, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    n = sizes[owner]
    at = rank << 33
    found = np.searchsorted(at + n, at + most[owner], "right") - np.searchsorted(at + n, at + _least(n, percent), "left")
    kept = found - (most[owner] >= n) > 0
    return ids, sizes, most, t[kept], owner[kept], rank[kept]


_COUNTS = "home int, ids binary, sizes binary, counts binary"


def _counted(pdf: pd.DataFrame, percent: int, homes: int) -> pd.DataFrame:
    """Of one bucket: how many shingles of each set a set of fitting size has too, by the sets' homes."""
    ids, sizes, _, _, owner, _ = _shared(pdf, percent)
    n = np.bincount(owner, minlength=len(ids))
    home = (ids.astype(np.uint64) % np.uint64(homes)).astype(np.int64)
    rows = []
    for h in np.unique(home[n > 0]):
        own = (home == h) & (n > 0)
        rows.append((int(h), ids[own].astype("<i8").tobytes(), sizes[own].astype("<u4").tobytes(), n[own].astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=["home", "ids", "sizes", "counts"])


def _enough(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of one home: the sets with as many shingles found as linked sets have in common."""
    ids, sizes, n = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]).astype(np.int64)
                     for c, t in (("ids", "<i8"), ("sizes", "<u4"), ("counts", "<u4")))
    ids, first, which = np.unique(ids, return_index=True, return_inverse=True)
    found = np.bincount(which, weights=n)
    sizes = sizes[first]
    left = found >= _spare(_least(sizes, percent))
    return pd.DataFrame({"id": ids[left], "size": sizes[left]})


def _useful(pdf: pd.DataFrame, percent: int, homes: int) -> pd.DataFrame:
    """Of one bucket: the shingles that a set of fitting size has too, by the sets' homes."""
    ids, sizes, most, t, owner, rank = _shared(pdf, percent)
    df = np.bincount(rank)[rank] if len(rank) else np.zeros(0, np.int64)
    home = ids.astype(np.uint64) % np.uint64(homes)
    rows = []
    order = np.lexsort((owner, home[owner]))
    t, owner, df = t[order], owner[order], df[order]
    ends = np.searchsorted(home[owner], np.arange(homes + 1, dtype=np.uint64))
    for h in np.flatnonzero(np.diff(ends)):
        a, b = ends[h], ends[h + 1]
        present, counts = np.unique(owner[a:b], return_counts=True)
        row = _row(ids[present], sizes[present], most[present], counts, t[a:b], df[a:b])
        rows.append({"home": int(h), "bucket": int(pdf["bucket"].iloc[0])} | row)
    return pd.DataFrame(rows, columns=["home", "bucket", "ids", "sizes", "most", "counts", "low", "high", "df"])


def _surviving(pdf: pd.DataFrame, percent: int, bits: int) -> pd.DataFrame:
    """Of one home: the sets that still can have a partner, with their useful shingles."""
    parts = [_unrow(r) for r in pdf.itertuples()]
    shingles = np.concatenate([p[4] | np.uint64(b) << np.uint64(_low(bits)) for p, b in zip(parts, pdf["bucket"])])
    df = np.concatenate([p[5] for p in parts])
    all_ids = np.concatenate([p[0] for p in parts])
    ids, first, which = np.unique(all_ids, return_index=True, return_inverse=True)
    sizes, most = (np.concatenate([p[k] for p in parts])[first] for k in (1, 2))
    owner = np.repeat(which, np.concatenate([p[3] for p in parts]))
    useful = np.bincount(owner, minlength=len(ids))
    # useful >= percent / (100 + percent) * (own size + partner's size)
    most = np.minimum(most, ((100 + percent) * useful - percent * sizes) // percent)
    alive = most >= _least(sizes, percent)
    kept = alive[owner]
    owner, shingles, df = owner[kept], shingles[kept], df[kept]
    order = np.lexsort((shingles, owner))
    owner, shingles, df = owner[order], shingles[order], df[order]
    rows = [{"id": int(ids[i]), "size": int(sizes[i]), "most": int(most[i]), "tokens": shingles[a:b].astype("<u8").tobytes(),
             "df": df[a:b].astype("<u4").tobytes()}
            for i in np.flatnonzero(alive) for a, b in [np.searchsorted(owner, [i, i + 1])]]
    return pd.DataFrame(rows, columns=["id", "size", "most", "tokens", "df"])


_SET = "id long, size long, most long, tokens binary, df binary"


def _round(dealt: DataFrame, percent: int, bits: int) -> DataFrame:
    found = dealt.groupBy("bucket").applyInPandas(
        lambda pdf: _useful(pdf, percent, 1 << bits), f"home int, bucket int, {_FIELDS}")
    return cut(found.groupBy("home").applyInPandas(lambda pdf: _surviving(pdf, percent, bits), _SET))


def _bits(total: int, bucket: int) -> int:
    return (max(1, -(-total // bucket)) - 1).bit_length()


def _open(rows: DataFrame, percent: int, bucket: int) -> DataFrame:
    """Ids of the sets that may have a partner as far as their lowest shingles tell.

    `rows` have (id, n_shingles, lowest): the lowest shingles, once or more per id. Bytes per shingle
    do not grow with the number of buckets beyond those of one set's number and sizes.
    """
    total = rows.agg(F.coalesce(F.sum(F.octet_length("lowest")), F.lit(0))).first()[0] // 8
    bits = _bits(total, bucket)
    shift = np.uint64(64 - bits - _low(bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def handed() -> pa.RecordBatch:
            ids, sizes = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            tokens = [np.frombuffer(h[2], "<u8") for h in held]
            owner = np.repeat(np.arange(len(held)), [len(t) for t in tokens])
            # Low hashes lie close together: mixed again they spread over all buckets.
            found = list(_dealt(ids, sizes, sizes * 100 // percent, owner, _mix(np.concatenate(tokens)) >> shift, bits))
            held.clear()
            return pa.RecordBatch.from_pylist(found, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in (
                "ids", "sizes", "most", "counts", "low", "high", "df"))]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                count += len(row[2]) // 8
                if count >= bucket:
                    yield handed()
                    count = 0
        if held:
            yield handed()

    dealt = rows.select("id", "n_shingles", "lowest").mapInArrow(deal, f"bucket int, {_FIELDS}")
    counts = dealt.groupBy("bucket").applyInPandas(lambda pdf: _counted(pdf, percent, 1 << bits), _COUNTS)
    return counts.groupBy("home").applyInPandas(lambda pdf: _enough(pdf, percent), "id long, size long")


def _candidates(texts: DataFrame, words: int, percent: int, total: int, bucket: int) -> DataFrame:
    """Of the sets of `texts`, in all `total` shingles, those that may have a partner: (id, size, most, tokens, df)."""
    bits = _bits(total, bucket)
    shift = np.uint64(64 - bits - _low(bits))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _batches(batch):
                sets = [(own, s) for s in shingle_sets(part.column(0).to_pylist(), words) if len(s)
                        for own in [_class_of(s)] if not (own in seen or seen.add(own))]
                sizes = [len(s) for _, s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own for own, _ in sets], pa.int64()), pa.array(sizes, pa.int64()), pa.array([n * 100 // percent for n in sizes], pa.int64()),
                     pa.array([(s >> shift).astype("<u8").tobytes() for _, s in sets], pa.binary()), pa.array([b""] * len(sets), pa.binary())],
                    ["id", "size", "most", "tokens", "df"])

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                tokens = [np.frombuffer(t, "<u8") for t in pdf["tokens"]]
                owner = np.repeat(np.arange(len(pdf)), [len(t) for t in tokens])
                ids, sizes, most = (pdf[c].to_numpy() for c in ("id", "size", "most"))
                yield pd.DataFrame(list(_dealt(ids, sizes, most, owner, np.concatenate(tokens).astype(np.uint64), bits)))

    sets = texts.select("text").mapInArrow(whole, _SET)
    left = None
    for _ in range(ROUNDS):
        sets = _round(sets.mapInPandas(again, f"bucket int, {_FIELDS}"), percent, bits)
        before, left = left, sets.count()
        if before is not None and left > 0.9 * before:
            break
    return sets


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, place, id, size, most, extra): each set's rarest shingles with their places in the order
    of all its shingles (those of no use come first), more of them where they are frequent;
    `extra` says how many of them a partner must share."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                tokens, df = np.frombuffer(r.tokens, "<u8"), np.frombuffer(r.df, "<u4").astype(np.int64)
                order = np.lexsort((tokens, df))
                need = int(_least(r.size, percent))
                met = np.cumsum(df[order] - 1)
                # Candidates come up at about the first `early + extra` places (see `_links`), and of those
                # met once so many are left with `extra` shingles shared.
                early = r.size - int(-(-2 * r.size * percent // (100 + percent))) - (r.size - len(tokens))
                cost = lambda x: met[min(max(early, 0) + x, len(met)) - 1] * (1 + VERIFY / x)
                extra = min((x for x in EXTRA if x == 1 or x <= need), key=cost)
                length = len(tokens) - need + extra
                out.append(pd.DataFrame({"token": tokens[order[:length]].astype(np.int64), "place": r.size - len(tokens) + np.arange(length),
                                         "id": r.id, "size": r.size, "most": r.most, "extra": extra}))
            if out:
                yield pd.concat(out)

    return sets.mapInPandas(choose, "token long, place int, id long, size long, most long, extra int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked, by their whole intersection."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            shared = np.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                               for x, y in zip(pdf["x"], pdf["y"])], np.int64)
            yield pdf.loc[100 * shared >= percent * (pdf["m"].to_numpy() + pdf["n"].to_numpy() - shared), ["a", "b"]]

    one = sets.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("tokens").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y").mapInPandas(count, "a long, b long")


def _fits(a: str, b: str, percent: int):
    sized = lambda p, q: (F.col(f"{q}.size") <= F.col(f"{p}.most")) & (F.col(f"{q}.size") * 100 >= F.col(f"{p}.size") * percent)
    return sized(a, b) & sized(b, a)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between linked sets that connect all that links connect."""
    prefixes = cut(_prefixes(sets, percent))
    # One hub per shingle (the set with the most room for partners), one of these per set.
    rank = F.struct("most", "size", "id")
    # Written, so that the join with a frequent shingle's rows can be split.
    hubs = cut(prefixes.groupBy("token").agg(F.max(rank).alias("h")).select(
        "token", F.col("h.id").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.most").alias("hub_most")))
    met = prefixes.join(hubs, "token").where("id <> hub and hub_size <= most and size <= hub_most").groupBy("id", "hub").agg(F.count("*").alias("n"))
    star = met.groupBy("id").agg(F.max(F.struct("n", "hub")).alias("h")).select(F.col("id").alias("a"), F.col("h.hub").alias("b"))
    near = cut(_verified(star, sets, percent))
    found = components(near)
    rows = cut(prefixes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    # Of each shingle, the sets outside its largest component meet all sets of other components.
    sizes = rows.groupBy("token", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("n", "root")).alias("h"), F.count("*").alias("roots")).where("roots > 1").select(
        "token", F.col("h.root").alias("main"))
    rows = cut(rows.join(cut(largest), "token").withColumn("outside", F.col("root") != F.col("main")))
    a, b = rows.where("outside").alias("a"), rows.alias("b")
    extra = F.least("a.extra", "b.extra")
    mixed = (F.col("a.root") != F.col("b.root")) & (~F.col("b.outside") | (F.col("a.id") < F.col("b.id"))) & _fits("a", "b", percent)
    # Before the k-th shingle that two linked sets share, all others are in one of them only: their
    # places tell whether there are too many. The first `extra` shared ones pass.
    total = F.col("a.size") + F.col("b.size")
    need = F.ceil(total * percent / (100 + percent) - F.lit(1e-9))
    early = (F.col("a.place") <= F.col("a.size") - need + extra - 1) & (F.col("b.place") <= F.col("b.size") - need + extra - 1) & (
        F.col("a.place") + F.col("b.place") <= total - 2 * need + 2 * (extra - 1))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & mixed & early)
    pairs = pairs.groupBy(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).agg(
        F.count("*").alias("n"), F.min(extra).alias("extra")).where("n >= extra").select("a", "b")
    return near.unionByName(_verified(cut(pairs), sets, percent))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90,
           row: str | None = None, bucket: int = BUCKET, group: bool = False) -> DataFrame:
    """(key[, row], n_shingles, component_id[, group]) for every row of `docs`; `row` names a column
    of numbers to know rows by, and `group` adds the component's own number (null for an empty set).

    Words are runs of characters other than the six ASCII white-space characters, A-Z lower-cased.
    A text's set holds its distinct runs of `words` words; a text with fewer words is one shingle;
    a null text or one without words has an empty set and is linked with nothing. Two rows are
    linked when their sets' intersection is at least `percent` hundredths of their union;
    `component_id` is the smallest key that links reach (the row's own key for an empty set, null if
    all keys are null). Repeated rows and keys are rows of their own.

    Shingles are known by 64-bit hashes, in the search by their first 48 bits and one more for
    every doubling of the table over `bucket` shingles, which one task compares.
    """
    kept = [F.col(f"`{row}`").alias("row")] if row else []
    own = docs.select(F.col(f"`{key}`").cast("long").alias("key"), *kept, F.col(f"`{text}`").cast("string").alias("text"))

    more = len(kept)

    # Smaller sets can have no larger partner, and of equal size only equal sets are linked then.
    smallest = next((n for n in range(1, 101) if n * 100 // percent > n), 1 << 62)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _batches(batch):
                sets = shingle_sets(part.column(more + 1).to_pylist(), words)
                ids = [_class_of(s) if len(s) else None for s in sets]
                # The lowest shingles once per task and set.
                lowest = [s[:len(s) - _least(len(s), percent) + _spare(len(s))].astype("<u8").tobytes()
                          if len(s) >= smallest and not (own in seen or seen.add(own)) else None for own, s in zip(ids, sets)]
                columns = [*part.columns[:more + 1], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(lowest, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", *["row"] * more, "n_shingles", "id", "lowest"])

    all_ = cut(own.mapInArrow(known, "key long, " + "row long, " * more + "n_shingles long, id long, lowest binary"))
    rows = all_.drop("lowest")
    classes = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("key").alias("least"))
    # One row of each set that is left, by its number or else its key (other rows of the key do no harm).
    name = "row" if row else "key"
    open_ = cut(_open(all_.where("lowest IS NOT NULL"), percent, bucket))
    firsts = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(name).alias("wanted")).join(open_, "id")
    total = open_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = cut(firsts.select("wanted").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    sets = _candidates(own.join(wanted, F.col(name).eqNullSafe(F.col("wanted")), "left_semi"), words, percent, total, bucket)
    found = components(_links(sets, percent)).withColumnRenamed("node", "id")
    grouped = cut(classes.join(found, "id", "left").withColumn("root", F.coalesce("root", "id")))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("id", "component_id", F.col("root").alias("group"))
    out = rows.where("id IS NOT NULL").join(named, "id").unionByName(
        rows.where("id IS NULL").withColumn("component_id", F.col("key")).withColumn("group", F.lit(None).cast("long")))
    return out.drop("id", *[] if group else ["group"])
