"""Toxicity: FTRL-proximal logistic regression over hashed word features.

A text's features are the hashes of its words, of its pairs of neighbouring
words and of its skip-grams (pairs with one word between), each once however
often it occurs. FTRL keeps a learning rate per coordinate and its L1 term
leaves most weights at exactly zero, so the model is a short list of
(coordinate, weight) that is broadcast to score every text.

Training reads at most about ``SAMPLE`` labelled documents (every labelled
one while there are fewer), chosen by a hash of their id, and learns from
them in one streaming task in the order of that hash, so that the model is
the same whatever the partitioning.

Defined cases: a null or word-free text has the bias alone as its evidence;
null labels and labels of unknown documents are not learned from; of several
labels of one document the largest counts; without any label every score is
0.5; texts of any length are read whole; repeated documents each get the same
score; other columns are kept and may have any name but ``out``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import small_batches

# Bound of the labelled documents learned from.
SAMPLE = 32_768
BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.0, 3
# Words whose hashes a worker remembers.
REMEMBERED = 100_000
# Coordinate of the bias: the one above all hashes.
BIAS = 1 << BITS

_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Features:
    """Texts to sorted coordinates; remembers the hashes of words seen."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift = np.uint64(64 - bits)
        self.hashes: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.int64)
        known = self.hashes
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            b = w.encode()
            known[w] = crc32(b) << 32 | crc32(b, len(b))  # unlike hash(), the same in every process
        h = np.array([known[w] for w in words], np.uint64)
        grams = [h, h[:-1] * _ODD + h[1:], h[:-2] * _MIX + h[2:]]
        mixed = np.concatenate(grams)
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _MIX
        return np.unique((mixed ^ (mixed >> np.uint64(29))) * _ODD >> self.shift).astype(np.int64)


def train(rows: Iterator[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS) -> dict[int, float]:
    """Weights other than zero, by coordinate; the bias at 1 << bits."""
    features, bias = Features(bits), 1 << bits
    # Coordinates of all rows in a few large arrays.
    labels, ends, blocks, block = [], [0], [], []
    for text, y in rows:
        block.append(np.append(features(text), bias).astype(np.int32))
        labels.append(float(y))
        ends.append(ends[-1] + len(block[-1]))
        if len(block) == 1000:
            blocks.append(np.concatenate(block))
            block = []
    flat = np.concatenate([*blocks, *block, np.zeros(0, np.int32)])
    blocks = block = None
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(i):
        zi = z[i]
        l1 = np.where(i == bias, 0.0, L1)
        w = (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for k, y in enumerate(labels):
            i = flat[ends[k]:ends[k + 1]]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    some = np.flatnonzero(n)
    w = weights(some)
    return {int(i): float(x) for i, x in zip(some[w != 0], w[w != 0], strict=True)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id",
        learn: Column | None = None, sample: int = SAMPLE) -> dict[int, float]:
    """Weights learned from the labelled documents; learn: which keys may be
    learned from (over a column named as key)."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(key), F.col(label).cast("int").alias("_y")).dropna()
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(key).agg(F.max("_y").alias("_y"))
    count = known.count()
    if not count:
        return {}
    order = F.xxhash64(F.lit("toxicity"), F.col(key))
    if count > sample:
        known = known.where(order <= F.lit(int((2 * sample / count - 1) * 2**63)))
    known = known.withColumn("_o", order)
    # At most about `sample` rows of 20 bytes.
    rows = (docs.select(F.col(key), F.col(text).alias("_t")).join(F.broadcast(known), key)
            .select("_o", "_t", "_y").repartition(1).sortWithinPartitions("_o", "_t"))

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = train((row for b in batches for row in zip(b["_t"], b["_y"], strict=True)))
        yield pd.DataFrame({"i": list(model.keys()), "w": list(model.values())}).astype({"i": "int64", "w": "float64"})

    return {r.i: r.w for r in rows.mapInPandas(learned, "i long, w double").collect()}


def score(docs: DataFrame, weights: dict[int, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column ``out``: probability (0 to 1) that a text is toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((np.array(list(weights.keys()), np.int64), np.array(list(weights.values()))))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(BIAS + 1)
        dense[shared.value[0]] = shared.value[1]
        features = Features()
        for texts in batches:
            logits = np.array([dense[BIAS] + dense[features(t)].sum() for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -35, 35))))

    return docs.withColumn(out, run(F.col(text)))
