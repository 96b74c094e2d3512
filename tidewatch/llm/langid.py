"""Language identification with error-correcting output codes.

Every language has a codeword; each bit is predicted by a binary classifier on
hashed character n-grams of words. A text gets the language whose codeword costs
the least loss, and is ambiguous where two codewords cost nearly the same."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_slices
from tidewatch.llm.ngrams import folded, gram_buckets
from tidewatch.operators.ranking import top_n

#: Labelled documents per language that the classifiers are fitted on.
PER_LANGUAGE = 400
BITS = 13
BUCKETS = 1 << BITS
UNKNOWN = "und"
#: Below this share of the two best languages' probability the text is ambiguous.
CLEAR = 0.6


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def counts(text: str) -> np.ndarray:
    """Share of each bucket among the n-grams of one to four bytes."""
    found = np.bincount(gram_buckets(folded(text), (1, 2, 3, 4), BITS), minlength=BUCKETS)
    return (found / found.sum()).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1/+1. Up to five classes: every split of the classes (each
    pair of rows then differs in over half the bits). More: the best of some
    random codes by the least distance of two rows."""
    if k == 1:
        return np.ones((1, 1), dtype=np.int8)
    if k <= 5:
        splits = [set(c) for n in range(1, k) for c in combinations(range(k), n) if 0 in c]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(k)], dtype=np.int8)
    rng, best, bits = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        gap = min(((code[i] != code[i + 1:]).sum(1).min() for i in range(k - 1)))
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        return counts(text) @ self.weights + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """The language of least weighted logistic loss, its probability and
        whether the runner-up comes close."""
        loss = (np.logaddexp(0, -self.code * margins) * self.trust).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmin(loss))
        second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] < CLEAR * (p[best] + second))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        return self.decode(self.margins(text))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list:
    """At most ``per_language`` documents of each language, by the hash of the
    id; ids come first and narrow, then the texts of the chosen ones."""
    known = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    chosen = top_n(known.dropDuplicates(["doc_id", "lang"]).select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_language)
    picked = docs.select("doc_id", "lang", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "lang"])
    return picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").collect()


def fit(rows: list, rounds: int = 80, rate: float = 60.0, decay: float = 1e-5) -> CodeModel:
    """Logistic classifiers for all bits at once, full-batch descent in numpy."""
    languages = sorted({r.lang for r in rows})
    if not languages:
        return CodeModel([UNKNOWN], np.ones((1, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    code = codewords(len(languages))
    y = code[[languages.index(r.lang) for r in rows]].astype(np.float32)
    x = np.stack([counts(r.text) for r in rows])
    balance = np.array([1 / sum(r.lang == x for r in rows) for x in languages], dtype=np.float32)[[languages.index(r.lang) for r in rows]]
    balance /= balance.sum()
    scale = 1 / np.sqrt(x.mean(0) + 1e-4)  # rare n-grams may move as far as frequent ones
    x *= scale
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    for _ in range(rounds):
        pull = y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * balance[:, None]
        w += rate * (x.T @ pull) - decay * w
        b += pull.sum(0)
    right = ((x @ w + b) * y > 0).T @ balance
    trust = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)
    return CodeModel(languages, code, w * scale[:, None], b, trust)


def identify(docs: DataFrame, model: CodeModel) -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1) and ambiguous. Null texts and
    texts without a letter are ``und`` with score 0; every other text gets a
    learned language. One pass, no shuffle; the model has a fixed size."""
    added = ("lang_pred", "score", "ambiguous")
    names = [c for c in docs.columns if c not in added]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in added)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())], names=[*names, *added])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(by_slices(run), f"{ddl}, lang_pred string, score double, ambiguous boolean")
