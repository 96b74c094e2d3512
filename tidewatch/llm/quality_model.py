"""Supervised subword embeddings for quality.

Words, pairs of neighbouring words and character n-grams are hashed to learned
vectors; a document is their mean, and a softmax layer reads the classes. Since
everything after the vectors is linear, a trained model also gives each feature
a number, and scoring adds numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_slices
from tidewatch.llm.langid import in_training
from tidewatch.llm.ngrams import buckets, folded, gram_buckets, word_hashes
from tidewatch.operators.ranking import top_n

#: Labelled documents of each class that the vectors are trained on.
PER_CLASS = 1_500
BITS, DIM = 15, 12
BUCKETS, SHAPES = 1 << BITS, 64 * 32
FEATURES = 3 * BUCKETS + SHAPES


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(word and n-gram features, shape features) of a text.

    Words, neighbouring pairs and character n-grams of three and four bytes have
    buckets of their own. Shapes say how the words relate: how many repeat the
    word before, and how many differ, each also for the length."""
    raw = folded(text)
    words = word_hashes(raw)
    pairs = (words[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ words[1:]
    inner = np.concatenate((buckets(words, BITS), BUCKETS + buckets(pairs * np.uint64(0x9E3779B97F4A7C15), BITS), 2 * BUCKETS + gram_buckets(raw, (3, 4), BITS)))
    n = len(words)
    repeats = int((words[1:] == words[:-1]).sum())
    distinct = len(np.unique(words))
    scale, share = min(n.bit_length(), 20), lambda x: x * 20 // max(1, n)
    shape = 3 * BUCKETS + np.array([share(repeats), 32 + share(distinct), 64 + scale, 96 + scale * 32 + share(distinct), 96 + (21 + scale) * 32 + share(repeats)])
    return inner, shape


@dataclass
class SubwordModel:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    prior: float = 0.0

    def __post_init__(self):
        self.numbers = (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float64)

    def score(self, text: str | None) -> float:
        inner, shape = features(text or "")
        z = float(self.numbers[shape].mean()) + self.bias[1] - self.bias[0] + self.prior
        if inner.size:
            z += float(self.numbers[inner].mean())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def mixture(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their weights: the mean over words and n-grams
    plus the mean over shapes."""
    inner, shape = features(text)
    ids, n = np.unique(inner, return_counts=True)
    return np.concatenate((ids, shape)), np.concatenate((n / max(1, len(inner)), np.full(len(shape), 1 / len(shape)))).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list:
    """At most ``per_class`` labelled documents of each class, chosen by the hash
    of the id among the labels, then looked up in one pass over the texts. A
    label that is null, or differs between rows of one id, is not used."""
    known = labels.filter(F.col("doc_id").isNotNull() & in_training(F.col("doc_id")) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").drop("_most")
    chosen = top_n(known, ["quality"], [F.xxhash64("doc_id"), F.col("doc_id")], per_class)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return picked.groupBy("doc_id", "quality").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).orderBy("doc_id").collect()


def class_balance(labels: DataFrame) -> float:
    """Log odds of class 1 over all usable labels of the training part."""
    known = labels.filter(F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    n = known.agg(F.count_if(F.col("quality") == 1).alias("one"), F.count_if(F.col("quality") == 0).alias("zero")).first()
    return float(np.log((n.one + 1) / (n.zero + 1)))


def fit(rows: list, log_odds: float = 0.0, steps: int = 16_000, rate: float = 1.0, seed: int = 5) -> SubwordModel:
    """Stochastic gradient descent, one document at a time, drawn from both
    classes in turn. Without rows of both classes the score is the share of class 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (FEATURES, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    of_class = [[i for i, r in enumerate(rows) if r.quality == c] for c in (0, 1)]
    if not all(of_class):
        return SubwordModel(vectors, layer, bias, log_odds)
    data = [mixture(r.text) for r in rows]
    for step in range(steps):
        y = step % 2
        ids, w = data[of_class[y][int(rng.integers(len(of_class[y])))]]
        lr = rate * (1 - step / steps)
        hidden = w @ vectors[ids]
        z = layer @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = layer.T @ p
        layer -= lr * 0.05 * np.outer(p, hidden)
        bias -= lr * 0.01 * p
        vectors[ids] -= lr * np.outer(w, back)
    return SubwordModel(vectors, layer, bias)


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id and score, the probability of quality 1. Null and empty texts are
    texts without words: they get a score from their shape alone. One pass, no
    shuffle; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shared.value.score(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(by_slices(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
