"""Best-fit packing with a swap-based local search.

Pieces are dealt by hash into blocks of bounded size, so that every block is a fair sample of
the lengths whatever length is frequent. Inside a block a best-fit start is improved by local
search: documents move between underfull bins, or are exchanged one for one or two for one,
whenever that raises the sum of squared fills; it empties bins, which is what saves sequences.
The bins that stay underfull are dealt into new blocks and searched once more together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import cut, fresh

#: Pieces that one task packs together.
BLOCK = 32_768


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # bins by the room they have
    present = 0  # bit r is set when a bin with room r is open
    bins: list[list[int]] = []
    for i in order.tolist():
        n = int(lengths[i])
        fitting = present >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                present ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            open_bins[room - n].append(b)
            present |= 1 << (room - n)
    return bins


def search(bin_of: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Local search over the underfull bins of an assignment; returns the new assignment.

    The emptiest bin gives, bins that are at least as full take. A step moves tokens from the
    giver to a taker, which raises the sum of squared fills, so the search ends: a document is
    moved, or exchanged for one of the taker's, or two of the giver's for one of the taker's.
    Of all steps the one that moves most tokens is taken. Equal pieces are tried once, and as many
    as fit are moved together, which is what single steps would come to. The number of bins never rises; the
    search stops when the takers have less room than the next giver holds.
    """
    bin_of = bin_of.copy()
    fill = np.bincount(bin_of, weights=lengths).astype(np.int64)
    members: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of.tolist()):
        members.setdefault(b, []).append(i)
    givers = [b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < size]
    for g in givers:
        if not 0 < fill[g] < size:
            continue
        taking = (fill < size) & (fill >= fill[g])
        taking[g] = False
        if (size - fill[taking]).sum() < fill[g]:
            break
        near = np.flatnonzero(taking[bin_of])
        near_length, near_bin = lengths[near], bin_of[near]
        while members[g]:
            equal: dict[int, list[int]] = {}
            for i in sorted(members[g], key=lambda i: lengths[i]):
                equal.setdefault(int(lengths[i]), []).append(i)
            room = size - fill
            pairs: dict[int, tuple[int, int]] = {}
            kinds = list(equal)
            for k, a in enumerate(kinds):
                if len(equal[a]) > 1:
                    pairs.setdefault(2 * a, (equal[a][0], equal[a][1]))
                for b in kinds[k + 1:]:
                    pairs.setdefault(a + b, (equal[a][0], equal[b][0]))
            gives = [(same[0],) for same in equal.values()] + list(pairs.values())
            weights = kinds + list(pairs)
            least = int(near_length.min()) if len(near) else size
            best, most = None, 0
            open_bins = np.flatnonzero(taking & (room > 0))
            for given, n in zip(gives, weights):
                if len(given) == 1 and n > most:
                    fits = open_bins[room[open_bins] >= n]
                    if len(fits):
                        best, most = (given, -1, int(fits[np.argmin(room[fits])])), n
                if n - least <= most:
                    continue
                gain = n - near_length
                ok = np.flatnonzero((gain > most) & (gain <= room[near_bin]))
                if len(ok):
                    k = ok[np.argmax(gain[ok])]
                    best, most = (given, int(k), int(near_bin[k])), int(gain[k])
            if best is None:
                break
            given, k, t = best
            if k < 0:  # nothing but what equals it can be as good until it is used up or the taker full
                given = tuple(equal[most][:int(room[t]) // most])
                most *= len(given)
            gone = set(given)
            members[g] = [i for i in members[g] if i not in gone]
            members[t].extend(given)
            bin_of[list(given)] = t
            if k >= 0:
                i = int(near[k])
                members[t].remove(i)
                members[g].append(i)
                bin_of[i] = g
                near_bin[k] = g
            fill[g] -= most
            fill[t] += most
            # The giver's returns are its own now; what it gave can be had back only by a later search.
            taking[t] = fill[t] < size
            if k >= 0:
                keep = np.ones(len(near), bool)
                keep[k] = False
                near, near_length, near_bin = near[keep], near_length[keep], near_bin[keep]
    return bin_of


def _pack(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Adds `bin` and `offset`; rows of a bin that came packed together start together."""
    lengths = pdf["length"].to_numpy(np.int64)
    if (pdf["bin"] < 0).all():
        start = np.zeros(len(pdf), np.int64)
        for k, members in enumerate(best_fit(lengths, size)):
            start[members] = k
    else:
        start = pdf.groupby(["block", "bin"], sort=True).ngroup().to_numpy(np.int64)
    found = search(start, lengths, size)
    order = np.argsort(found, kind="stable")
    ends = np.cumsum(lengths[order])
    begins = ends - lengths[order]
    first = np.r_[True, found[order][1:] != found[order][:-1]]
    offset = np.zeros(len(pdf), np.int64)
    offset[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
    return pdf.assign(bin=found, offset=offset)


def packed(pieces: DataFrame, size: int, block: int = BLOCK, rounds: int = 2) -> DataFrame:
    """`pieces`, which need a bigint `length` of 1 to `size`, with `sequence_id` and `offset` (columns of
    these names are replaced).

    Every row is placed once; a sequence's pieces lie one after the other from 0. A piece as long
    as a sequence is one by itself. The bound of memory is `block` rows a task, whatever the
    lengths; equal rows, ties and an empty table are ordinary cases. Keep only small columns
    (digests, not ids) in `pieces`; sequence ids join the rest.
    """
    own = fresh("row", pieces)
    rows = cut(pieces.drop("offset", "sequence_id").withColumn(own, F.monotonically_increasing_id()))
    full = rows.where(F.col("length") >= size).withColumn("offset", F.lit(0).cast("long")).withColumn(
        "sequence_id", -1 - F.col(own))
    short = rows.where(F.col("length") < size).select(F.col(own).alias("piece_row"), "length")
    blocks = max(1, -(-short.count() // block))
    state = short.withColumn("bin", F.lit(-1).cast("long")).withColumn("offset", F.lit(0).cast("long")).withColumn(
        "block", F.lit(0).cast("long")).withColumn("to", F.pmod(F.xxhash64("piece_row"), F.lit(blocks)))
    schema = "piece_row long, length long, bin long, offset long, block long, to long"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf.sort_values("piece_row", kind="stable").reset_index(drop=True), size)

    done = []
    for k in range(rounds):
        state = cut(state.groupBy("to").applyInPandas(pack, schema))
        state = state.drop("block").withColumnRenamed("to", "block").withColumn("turn", F.lit(k))
        if k + 1 == rounds or blocks == 1:
            done.append(state)
            break
        # Bins with room go on, several blocks' worth of them together.
        fills = state.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        open_bins = cut(fills.where(F.col("fill") < size).drop("fill"))
        left = state.join(open_bins, ["block", "bin"], "left_semi")
        done.append(state.join(open_bins, ["block", "bin"], "left_anti"))
        blocks = max(1, -(-left.count() // block))
        state = left.drop("turn").withColumn("to", F.pmod(F.xxhash64("block", "bin"), F.lit(blocks))).select(
            "piece_row", "length", "bin", "offset", "block", "to")
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    # Blocks, bins and rounds are small numbers, and so is what tells their sequences apart.
    places = places.select(F.col("piece_row").alias(own), "offset", ((F.col("block") * F.lit(1 << 32) + F.col("bin")) * rounds + F.col("turn")).alias("sequence_id"))
    return rows.join(places, own).unionByName(full).drop(own)
