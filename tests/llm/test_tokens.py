"""Token ids, packing and training order: against the public library, and as exact round trips."""

import functools
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sievelake.llm import ordering, packing, tokens
from sievelake.llm.common import new_folder

PATH = tokens.vocabulary()
TEXTS = [None, "", " ", "Hello, world!", "the  of\n\n\tend ", "é€😀 naïve ñandú", "<|endoftext|> inside <|endoftext|>", "a" * 3000, "x y " * 2000,
         "1234567 don't we'll\u00a0\u2003z", "\x00\x01\x7f", "日本語のテキスト", "Hello, world!"]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def all_ids(text, end=2):
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def test_ids_equal_the_library(spark):
    rng = random.Random(5)
    alphabet = "aeiou thn. ,'%#\n\t éß1290-<|>😀"
    encode = tokens.encoder(PATH)
    for text in [*filter(None, TEXTS), *("".join(rng.choices(alphabet, k=200)) for _ in range(200))]:
        assert [*encode(text), 2] == all_ids(text)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n\u3000"])
def test_ids_of_very_long_blank_runs(blank):
    run = blank * (1_100_000 // len(blank))
    for text in (run, f"the{run}end", f"a{run}<|endoftext|>{run}.\n"):
        assert [*tokens.encoder(PATH)(text), 2] == all_ids(text)


def test_ids_around_cut_blanks(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_BLANK", 5)
    rng = random.Random(3)
    parts = ["a", "b's", " ", "\n", "\t", "\u3000", "\x1c", "\x85", "\xa0", "1", ".", "<|endoftext|>", " " * 9, "\n" * 9, " \n" * 5]
    encode, own = tokens.encoder(PATH), library()
    for text in ("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)):
        assert encode(text) == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n,expected", [(0, [(0, 0)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]), (25, [(0, 5), (5, 10), (15, 10)])])
def test_cut_places(n, expected):
    assert tokens.cut_places(n, 10) == expected


def documents(spark):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)] + [(3, "again", "e"), (None, "no id", "e")],
                                 "doc_id long, text string, offset string")


def test_packed_sequences_are_gapless_and_whole(spark):
    got = packing.packed(tokens.pieces(documents(spark), PATH, 64, 2), 64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        own = np.frombuffer(r["ids"], "<u4")
        assert len(own) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["key"], []).append((r["start"], own.tolist()))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    for i, t in enumerate(TEXTS):
        if i != 3:
            assert sum((ids for _, ids in sorted(by_doc[i])), []) == all_ids(t)
    assert packing.packed(tokens.pieces(documents(spark).limit(0), PATH, 64, 2), 64).collect() == []


@pytest.mark.parametrize("draw", ["uniform", "hot", "small", "large", "ties"])
def test_search_never_needs_more_bins(draw):
    rng = np.random.default_rng(7)
    lengths = {"uniform": rng.integers(1, 100, 3000), "hot": np.where(rng.random(3000) < .4, 60, rng.integers(1, 100, 3000)),
               "small": rng.integers(1, 12, 3000), "large": rng.integers(40, 100, 2000), "ties": np.full(1000, 34)}[draw]
    start = np.zeros(len(lengths), np.int64)
    for k, members in enumerate(packing.best_fit(lengths, 100)):
        start[members] = k
    for first in (start, np.arange(len(lengths))):
        found = packing.search(first, lengths, 100)
        fill = np.bincount(found, weights=lengths)
        assert fill.max() <= 100 and fill.sum() == lengths.sum()
        assert (fill > 0).sum() <= first.max() + 1
        assert (fill ** 2).sum() >= (np.bincount(first, weights=lengths) ** 2).sum()
    if draw == "small":
        assert len(np.unique(packing.search(start, lengths, 100))) <= -(-lengths.sum() // 100) + 1


def test_search_over_many_equal_pieces_ends():
    bins, began = np.repeat(np.arange(4), 250), time.monotonic()
    found = packing.search(bins, np.ones(1000, np.int64), 1024)
    assert time.monotonic() - began < 5
    assert np.bincount(found).max() <= 1024 and len(np.unique(found)) < 4


def test_several_rounds_of_blocks(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 100)) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "key long, length long")
    got = packing.packed(pieces, 100, block=500).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sorted((r["key"], r["length"]) for r in got) == rows and max(fill.values()) <= 100
    assert len(fill) <= 1.03 * -(-sum(n for _, n in rows) // 100)


@pytest.mark.parametrize("domain", [1, 2, 3, 100, 1000, 4097])
def test_permutation(domain):
    one = ordering.permuted(np.arange(domain, dtype=np.uint64), domain, 1)
    assert sorted(one.tolist()) == list(range(domain))
    if domain > 10:
        assert one.tolist() != ordering.permuted(np.arange(domain, dtype=np.uint64), domain, 2).tolist()


def test_training_order_round_trip(spark):
    docs, folder = documents(spark), new_folder(spark, "order")
    manifest = ordering.written(docs, folder, PATH, length=32, shard_bytes=4000).orderBy("shard").collect()
    assert len(manifest) > 2
    rows = sorted(ordering.read(spark, folder).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows))) and {len(r["ids"]) for r in rows} == {64}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], np.frombuffer(r["ids"], "<u2")[:r["n"]].tolist()))
    for i, t in enumerate(TEXTS):
        if i != 3:
            assert sum((ids for _, ids in sorted(by_doc[i])), []) == all_ids(t, 50256)
    part = ordering.read(spark, folder, 17, 40).collect()
    assert sorted(map(str, part)) == sorted(str(r) for r in rows if 17 <= r["slot"] < 57)
    other = new_folder(spark, "order")
    ordering.written(docs.repartition(7), other, PATH, length=32, shard_bytes=4000)
    key = lambda r: (r["slot"], r["doc_id"], r["piece"])
    assert [key(r) for r in sorted(ordering.read(spark, other).collect(), key=lambda r: r["slot"])] == [key(r) for r in rows]


def test_training_order_of_far_ids_and_of_nothing(spark):
    folder = new_folder(spark, "order")
    far = spark.createDataFrame([(-2**62, "a b"), (2**62, "c d")], "doc_id long, text string")
    ordering.written(far, folder, PATH)
    assert sorted((r["slot"], r["doc_id"]) for r in ordering.read(spark, folder).collect())[0][0] == 0
    empty = new_folder(spark, "order")
    assert ordering.written(far.limit(0), empty, PATH).collect() == []


def test_training_order_of_one_hot_id(spark, monkeypatch):
    """A third of the rows without id, a third equal rows; keys and slots are computed again for every record."""
    monkeypatch.setattr(ordering, "COPIES", 7)
    rows = [(None, f"no id {i} " + "word " * (i % 50)) for i in range(1000)] + [(5, "the same " * 40)] * 1000
    rows += [(i, f"own {i} " + "text " * (i % 50)) for i in range(100, 1100)]
    rows += [(3, None), (3, ""), (3, "x"), (None, None)]
    docs, folder = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), new_folder(spark, "order")
    manifest = ordering.written(docs, folder, PATH, length=32, shard_bytes=10_000).collect()
    counts = sorted(r["records"] for r in manifest)
    assert len(counts) > 30 and counts[-1] < 2 * counts[len(counts) // 2]
    got = sorted(ordering.read(spark, folder).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got)))
    assert [r["key"] for r in got] == sorted(r["key"] for r in got) and len({r["key"] for r in got}) == len(got)
    made = Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u2")[:r["n"]].tolist())) for r in got)
    want = Counter()
    for d, t in rows:
        ids = all_ids(t, 50256)
        want.update((d, k, s, tuple(ids[s:s + n])) for k, (s, n) in enumerate(tokens.cut_places(len(ids), 32)))
    assert made == want
    other = new_folder(spark, "order")
    monkeypatch.setattr(ordering, "COPIES", 100)
    ordering.written(docs.repartition(3, "text"), other, PATH, length=32, shard_bytes=10_000)
    again = sorted(ordering.read(spark, other, 100, 500).collect(), key=lambda r: r["slot"])
    seen = lambda r: (r["slot"], r["key"], r["doc_id"], r["piece"], r["ids"])
    assert [seen(r) for r in again] == [seen(r) for r in got[100:600]]


def test_training_order_is_the_rank_of_permuted_indexes(spark):
    """Keys by hand, where ids are unique."""
    docs, folder = spark.createDataFrame([(i, "a b c d e " * i) for i in range(2, 40)], "doc_id long, text string"), new_folder(spark, "order")
    ordering.written(docs, folder, PATH, length=32, seed=9, shard_bytes=500)
    most = (10 * 39 + 32) // 32
    records = [(i, k) for i in range(2, 40) for k in range(len(tokens.cut_places(len(all_ids("a b c d e " * i, 50256)), 32)))]
    keys = ordering.permuted(np.array([(i - 2 + 1) * most + k for i, k in records], np.uint64), (39 - 2 + 2) * most, 9).tolist()
    want = [(slot, *r) for slot, (_, r) in enumerate(sorted(zip(keys, records)))]
    assert sorted((r["slot"], r["doc_id"], r["piece"]) for r in ordering.read(spark, folder).collect()) == want
