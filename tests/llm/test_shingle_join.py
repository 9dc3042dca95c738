"""The similarity join against all pairs."""

import random
import re

import numpy as np
import pytest

from sievelake.llm import shingle_join as join
from sievelake.llm.components import components

VOCABULARY = [f"w{i}" for i in range(300)]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[at] = rng.choice(VOCABULARY)
        elif kind < 0.7:
            words.insert(at, rng.choice(VOCABULARY))
        elif len(words) > 3:
            del words[at]
    return words


def made(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "A b", "a B", "A", "a", "a b c", "x é😀 ñ", "X é😀 ñ", "a  b\x0bc", "É x y", "é x y"]
    for _ in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([5, 12, 20, 40, 80, 200, 400]))]
        texts += [" ".join(edited(rng, base, rng.randrange(8))) for _ in range(rng.randrange(1, 30))] + [" ".join(base)] * rng.randrange(3)
    rng.shuffle(texts)
    return texts


def brute(texts, words, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed,words,percent,bucket", [(1, 3, 90, 4_000_000), (2, 3, 90, 3000), (3, 5, 80, 4_000_000), (4, 2, 100, 5000)])
def test_components_of_all_pairs(spark, seed, words, percent, bucket):
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, id string, token int").repartition(6)
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in join.linked(docs, words=words, percent=percent, bucket=bucket).collect()}
    assert got == brute(texts, words, percent)


def test_repeated_and_missing_keys_and_no_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A B C D"), (None, None), (9, ""), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, join.linked(docs).collect()))
    want = [(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 2, 5), (None, 0, None), (9, 0, 9), (None, 1, None)]
    assert got == sorted(f"Row(key={a}, n_shingles={b}, component_id={c})" for a, b, c in want)
    assert join.linked(docs.limit(0)).collect() == []


def test_very_long_texts(spark):
    words = [f"v{i}" for i in range(400_000)]  # longer than a stretch
    one = " ".join(words)
    texts = [one, one.replace("v7 ", "changed "), "y" * (1 << 22), "Y" * (1 << 22), "y" * (1 << 22) + "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in join.linked(docs).collect()}
    assert got == {0: (399_998, 0), 1: (399_998, 0), 2: (1, 2), 3: (1, 2), 4: (1, 4)}


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(8)
    word = "needleé"
    for _ in range(50):
        text = " ".join(rng.choices(VOCABULARY, k=rng.randrange(1, 30)))
        data = np.frombuffer(f"{text} {word}\n{text}".encode(), np.uint8)
        starts, hashes = join.word_hashes(data)
        assert hashes[starts == len(text) + 1].tolist() == join.word_hashes(np.frombuffer(word.encode(), np.uint8))[1].tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(3000, 4000), rng.randrange(3000, 4000)) for _ in range(600)] + [(5, 5), (2, 1)]
    rng.shuffle(edges)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
