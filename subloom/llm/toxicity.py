"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams of the lower-cased text's characters
(code points), padded by a space at both ends.  A feature's value is its log-count ratio
between toxic and other training texts; a logistic regression is fitted on the
scaled features.

Only fitting uses a sample: at most ``POSITIVE`` toxic and ``NEGATIVE`` other
labelled ids, those of the least hash, with a whole text each: of rows that
repeat an id the text of the least hash.  A score
of 0.5 is where the sample's classes part with least error, weighted by the
share of toxic rows among all training labels.

Defined results.  Null and empty texts get the score of a text without n-grams.
Where the training rows lack one of the two classes, the score is the share of
toxic training rows (0 without any).  Labels that are null don't count; a
``doc_id`` labelled twice counts as labelled with the larger value.  Rows are
scored one by one: repeated rows and null ids each give a row, and a null id is
not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, plain, rows_of

BITS = 19
SIZES = (3, 4, 5, 6)
POSITIVE, NEGATIVE = 1500, 3000
_BASE, _ODD = np.uint64(1_114_123), np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Distinct hashed n-grams of texts; scratch memory is reused."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def of(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        found = []
        for at in range(0, max(1, len(data) - SIZES[0] + 1), 1 << 18):  # long texts in overlapping stretches
            part = data[at : at + (1 << 18) + SIZES[-1] - 1]
            rolled, n = part, 1
            for size in SIZES:
                while n < size and len(rolled) > 1:
                    rolled = rolled[:-1] * _BASE + part[n:]
                    n += 1
                if n == size:
                    found.append((((rolled + np.uint64(size)) * _ODD) >> np.uint64(64 - BITS)).astype(np.int32))
        if not found:
            return np.empty(0, np.int32)
        all_of = np.concatenate(found)
        at = np.arange(len(all_of), dtype=np.int32)
        self.last[all_of] = at
        return all_of[self.last[all_of] == at]


@dataclass
class Model:
    """Weights of the hashed n-grams, already times their log-count ratios."""

    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        z = float(self.weights[features].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def log_count_ratios(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Naive Bayes log-count ratio of every bucket; those of one or two texts tell nothing and have 0."""
    positive = sum(label for label, _ in rows)
    counts = np.ones((2, 1 << BITS))
    for label, features in rows:
        counts[label, features] += 1
    ratio = np.log(counts[1] / (positive + 2)) - np.log(counts[0] / (len(rows) - positive + 2))
    ratio[(counts.sum(0) - 2) < 3] = 0
    return ratio


def fit(rows: list[tuple[int, np.ndarray]], share: float, epochs: int = 4, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """Naive Bayes ratios, then logistic regression by stochastic gradients with adaptive rates."""
    size = 1 << BITS
    y = np.array([label for label, _ in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(share, 0.0), 1.0)
        return Model(np.zeros(size, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    ratio = log_count_ratios(rows)
    kept = [(label, features[ratio[features] != 0]) for label, features in rows]
    w, square, bias = np.zeros(size), np.full(size, 1e-6), 0.0
    draw = np.random.default_rng(7)
    scale = 1 / np.sqrt(max(1.0, float(np.mean([(ratio[f] ** 2).sum() for _, f in kept]))))
    for _ in range(epochs):
        for k in draw.permutation(len(kept)):
            label, f = kept[k]
            x = ratio[f] * scale
            z = float(w[f] @ x) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - label
            step = error * x + decay * w[f]
            square[f] += step * step
            w[f] -= rate * step / np.sqrt(square[f])
            bias -= rate * error * 0.1
    z = np.array([float(w[f] @ (ratio[f] * scale)) for _, f in kept])
    return Model((w * ratio * scale).astype(np.float32), -_cut(z, y, min(max(share, 1e-6), 1 - 1e-6)))


def _cut(z: np.ndarray, y: np.ndarray, share: float) -> float:
    """The middle of the gap that parts the classes with least error, classes weighted as in all training labels."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    missed = np.concatenate(([0.0], np.cumsum(y))) / max(1.0, y.sum()) * share  # toxic below the cut
    wrong = (1 - np.concatenate(([0.0], np.cumsum(1 - y))) / max(1.0, (1 - y).sum())) * (1 - share)  # others above it
    k = int(np.argmin(missed + wrong))
    low, high = z[k - 1] if k else z[0] - 1, z[k] if k < len(z) else z[-1] + 1
    return float(low + high) / 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    """A model from the labelled rows that ``training``, a condition on doc_id, admits."""
    known = plain(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    least = lambda is_toxic, n: known.where((F.col("toxic") == 1) == is_toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = least(True, POSITIVE).unionByName(least(False, NEGATIVE))  # at most POSITIVE + NEGATIVE rows, so it can be broadcast
    schema = pa.schema([("toxic", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        return batched(((int(t == 1), features.of(text).tobytes()) for t, text in rows_of(batches, "toxic", "text")), schema, 64)

    # of rows that repeat a sampled id the one of the least hash of its text
    texts = plain(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    rows = texts.select("toxic", "row.text").mapInArrow(run, "toxic int, features binary")
    found = sorted((r[0], bytes(r[1])) for r in rows.toLocalIterator())
    return fit([(t, np.frombuffer(f, np.int32)) for t, f in found], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.bias))  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = Model(*sent.value), Features()
        return batched(((doc, own.score(features.of(text))) for doc, text in rows_of(batches, "doc_id", "text")), schema)

    out = plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels, ~held_out(F.col("doc_id"))))
