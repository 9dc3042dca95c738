"""Language identification: sparse multinomial logistic regression on character n-grams.

A text is lower-cased, all but letters become single spaces, and its 1- to 3-grams of characters
are hashed to features. Their weights are (1 + log tf) * idf, scaled to length 1; document
frequencies come from all learning texts. The model is trained online with follow the
regularised leader (L1 keeps it sparse, L2 keeps it small) on a bounded sample of labelled
rows, and a temperature fitted on rows left out of that training makes its scores probabilities.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import cut

UNKNOWN = "und"
BITS = 15


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed 1- to 3-grams of the letters of a text, words set off by spaces; with repeats."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    spaced = np.r_[np.uint32(32), np.where(letter, codes, np.uint32(32)), np.uint32(32)]
    c = spaced[np.r_[True, (spaced[1:] != 32) | (spaced[:-1] != 32)]].astype(np.uint64)
    if len(c) < 2:
        return np.zeros(0, np.int64)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + c[2:]
    every = np.r_[one[c != 32], two, three] * np.uint64(0xD6E8FEB86659FD93)
    return (every >> np.uint64(64 - bits)).astype(np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their TF-IDF weights, scaled to length 1."""
    counts = np.bincount(grams(text), minlength=len(idf))
    found = np.flatnonzero(counts)
    weights = (1 + np.log(counts[found])) * idf[found]
    return found, weights / max(math.sqrt(float(weights @ weights)), 1e-12)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, epochs: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 0) -> np.ndarray:
    """Weights (features + 1 bias, classes) of the follow-the-regularised-leader learner."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            found, x, label = rows[k]
            found, x = np.r_[found, features], np.r_[x, 1.0]
            w = weights(found)
            error = softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            grown = n[found] + g * g
            z[found] += g - (np.sqrt(grown) - np.sqrt(n[found])) / alpha * w
            n[found] = grown
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes the labels most likely (golden-section search).

    One row's worth of doubt is spread over all labels, so that rows without any error do not
    drive it to 0.
    """
    if not len(labels):
        return 1.0
    aim = np.full(logits.shape, 1.0 / (len(labels) + 1) / logits.shape[1])
    aim[np.arange(len(labels)), labels] += len(labels) / (len(labels) + 1)

    def loss(log_t: float) -> float:
        return -float((aim * np.log(np.maximum(softmax(logits / math.exp(log_t)), 1e-12))).sum())

    low, high, step = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - step * (high - low), low + step * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        found, x = vector(text, self.idf)
        p = softmax((x @ self.weights[found] + self.weights[-1]) / self.temperature)
        k = int(np.argmax(p))
        return self.labels[k], float(p[k])


def fitted(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = 4000,
           seed: int = 0) -> Model | None:
    """Learn from the rows of `docs` with a label and a letter in their text; None if there are none.

    Document frequencies count every such row. The classifier is fitted on at most `rows` of
    them, the same number of each label (or all it has), drawn by a hash of the key; one fifth
    of these serves the temperature. That sample is the only bound; one task holds it.
    """
    usable = docs.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).where(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << BITS, np.int64)
        total = 0
        for pdf in frames:
            for t in pdf["text"]:
                flags = np.zeros(1 << BITS, bool)
                flags[grams(t)] = True
                seen += flags
                total += 1
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.r_[found, -1], "n": np.r_[seen[found], total]})

    counted = usable.select("text").mapInPandas(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counts = {r["feature"]: r["n"] for r in counted.collect()}  # one number per feature at most
    total = counts.pop(-1, 0)
    if not total:
        return None
    df = np.zeros(1 << BITS)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    # Rows of a label with a low draw, some more than are wanted, and of these the lowest: a label that
    # most rows have sends no more of them to one task than another.
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    each = max(5, rows // len(labels))
    shares = F.create_map(*[F.lit(x) for y in labels for x in (y, min(1.0, (4 * each + 100) / sizes[y]))])
    low = usable.select("key", "label", F.xxhash64(F.lit(seed), "key").alias("draw")).where(
        "key IS NOT NULL").where(F.col("draw") / 2.0**64 + 0.5 <= F.element_at(shares, F.col("label")))
    drawn = F.row_number().over(Window.partitionBy("label").orderBy("draw", "key"))
    sample = low.distinct().withColumn("k", drawn).where(F.col("k") <= each)
    sample = sample.groupBy("key").agg(F.min("k").alias("k"))  # at most `rows` keys
    chosen = usable.join(F.broadcast(sample), "key").groupBy("key", "label").agg(F.first("k").alias("k"), F.min("text").alias("text"))

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [vector(t, idf) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "k": pdf["k"], "found": [f.astype("<i4").tobytes() for f, _ in made],
                                "x": [x.astype("<f4").tobytes() for _, x in made]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "k", "found"])
        data = [(np.frombuffer(f, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), labels.index(y))
                for f, x, y in zip(pdf["found"], pdf["x"], pdf["label"])]
        held = (pdf["k"] % 5 == 0).to_numpy()
        learn = [d for d, h in zip(data, held) if not h] or data
        w = ftrl(learn, 1 << BITS, len(labels), seed=seed)
        rest = [d for d, h in zip(data, held) if h]
        logits = np.array([x @ w[f] + w[-1] for f, x, _ in rest]).reshape(len(rest), len(labels))
        t = temperature(logits, np.array([y for *_, y in rest], np.int64))
        return pd.DataFrame({"weights": [w.astype("<f8").tobytes()], "t": [t]})

    vectors = cut(chosen.mapInPandas(featured, "label string, k int, found binary, x binary"))
    learnt = vectors.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, "weights binary, t double").first()
    if learnt is None:  # labelled rows, but none with a key
        return None
    weights = np.frombuffer(learnt["weights"], "<f8").reshape((1 << BITS) + 1, len(labels))
    return Model(labels, idf, weights, learnt["t"])


def predicted(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` with a struct `out`: `lang` and `score`, the probability the model gives to it.

    A null text, one without a letter, and every text if there is no model have `und` and 0.
    A column named `out` is replaced; all others and repeated rows come through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: features x labels

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in texts:
            found = [m.predict(t) if t is not None and m else (UNKNOWN, 0.0) for t in batch]
            yield pd.DataFrame(found, columns=["lang", "score"])

    value: Column = F.col(f"`{text}`").cast("string")
    has_letter = F.coalesce(value.rlike(r"\p{L}"), F.lit(False))
    got = predict(F.when(has_letter, value))
    return docs.withColumn(out, got).withColumn(out, F.when(F.col(f"{out}.score") > 0, F.col(out)).otherwise(
        F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))))


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
