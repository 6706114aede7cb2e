"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import carried, hash_words, joined, map_batches, mix, put_back, slices, text_bytes
from courtside.llm.linear import fit_in_task, training_sample

DIMENSIONS = 1 << 20
#: Labelled documents learnt from, per class: the bound of the training sample.
PER_CLASS = 4000
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 16.0, 0.1, 6

# Letters, digits and all beyond ASCII make words; upper case counts as lower case.
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text each belongs to: every word, pair of neighbours and
    pair with one word between, hashed into the table's dimensions. May repeat."""
    data, starts = joined([t.translate(_LOWER) for t in texts])
    word, offset = hash_words(data, _IS_WORD)
    owner = np.searchsorted(starts, offset, "right") - 1
    numbers, owners = [word], [owner]
    for gap in (1, 2):
        same = np.flatnonzero(owner[gap:] == owner[:-gap])
        numbers.append(mix(word[same] * np.uint64(2 * gap + 1) ^ mix(word[same + gap])))
        owners.append(owner[same])
    return (np.concatenate(numbers) % np.uint64(DIMENSIONS)).astype(np.int64), np.concatenate(owners)


class FTRL:
    """Per-coordinate learning rates, L1 shrinkage to exact zeros. Features are binary and
    the last coordinate is the bias, which is not shrunk."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == DIMENSIONS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, at: np.ndarray, label: int, importance: float = 1.0) -> None:
        w = self.weights(at)
        gradient = importance * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label)
        step = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - step * w
        self.n[at] += gradient**2


def train(texts: list[str], labels: list[int]) -> bytes:
    """The non-zero weights as bytes. The rarer class counts by the root of what it lacks;
    without documents of both classes only a bias is left."""
    model, seen = FTRL(), []
    for start in range(0, len(texts), 256):
        part = [t.encode() for t in texts[start : start + 256]]
        number, owner = features(part)
        key = np.unique(owner * DIMENSIONS + number)  # each feature once per text
        cut = np.searchsorted(key // DIMENSIONS, np.arange(len(part) + 1))
        seen += [np.append(key[a:b] % DIMENSIONS, DIMENSIONS) for a, b in zip(cut, cut[1:])]
    order, toxic = np.random.default_rng(7), sum(labels)
    lack = max(1, len(labels) - toxic) / max(1, toxic)
    importance = max(1.0, lack**-0.5), max(1.0, lack**0.5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(seen)):
            model.update(seen[i], labels[i], importance[labels[i]])
    weights = model.weights(np.arange(DIMENSIONS + 1)).astype(np.float32)
    at = np.flatnonzero(weights)
    out = io.BytesIO()
    np.savez(out, at=at.astype(np.int32), weight=weights[at])
    return out.getvalue()


class Scorer:
    def __init__(self, model: bytes):
        with np.load(io.BytesIO(model)) as stored:
            self.weight = np.zeros(DIMENSIONS + 1, np.float32)
            self.weight[stored["at"]] = stored["weight"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        number, owner = features(texts)
        # Few weights are left: only their occurrences are made distinct.
        live = self.weight[number] != 0
        key = np.unique(owner[live] * DIMENSIONS + number[live])
        sums = np.bincount(key // DIMENSIONS, self.weight[key % DIMENSIONS], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.weight[DIMENSIONS], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> bytes:
    """A model from the labelled rows that are not held out."""
    return fit_in_task(training_sample(docs, labels, "toxic", per_class), train)


def score(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of toxicity, from the whole text. Null and empty texts
    get the bias alone. Rows keep their number and columns; an input column of that
    name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work():
        scorer = Scorer(shared.value)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = text_bytes(batch.column(at))
            parts = [scorer.scores(texts[a:b]) for a, b in slices(texts)]
            return [pa.array(np.concatenate(parts) if parts else np.empty(0))]

        return compute

    return map_batches(docs, work, [T.StructField("score", T.DoubleType())])


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS, text: str = "text") -> DataFrame:
    """The documents scored below the threshold; columns as given."""
    model = fit(docs, labels, per_class)
    return put_back(score(carried(docs, text), model).where(F.col("score") < threshold), docs, text)
