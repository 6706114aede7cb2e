"""Quality: a byte-level convolutional network in numpy."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from courtside.llm.common import map_batches, text_bytes
from courtside.llm.linear import fit_in_task, training_sample

#: Labelled documents learnt from, per class, and bytes of each that training looks at in
#: chunks spread over the whole text: the bound of the training sample. Scoring reads all.
PER_CLASS = 1500
TRAIN_CHUNKS = 6
CHUNK, OVERLAP = 512, 64
EMBED, WIDTH, STRIDE, FILTERS = 4, 8, 4, 16
EPOCHS, RATE, BATCH = 12, 0.01, 64
THRESHOLD = 0.5
PAD = 256  # the number of the padding symbol


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that together cover every byte; the last one is padded."""
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.full((count - 1) * step + CHUNK, PAD, np.int16)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class Network:
    """Byte embeddings, one convolution, ReLU, maximum over each chunk. A document's feature
    is the mean and the maximum of its chunks' maxima; a logistic unit combines them."""

    NAMES = ("embed", "filters", "shift", "weight", "bias")

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def windows(self, chunk: np.ndarray) -> np.ndarray:
        """The embedded bytes of every filter place: (chunks, places, WIDTH * EMBED)."""
        vectors = self.embed[chunk].reshape(len(chunk), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def pooled(self, chunk: np.ndarray) -> np.ndarray:
        """Per chunk and filter the largest response."""
        out = np.empty((len(chunk), FILTERS), np.float32)
        for at in range(0, len(chunk), 128):
            windows = self.windows(chunk[at : at + 128])
            response = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.filters
            out[at : at + 128] = response.reshape(windows.shape[0], windows.shape[1], FILTERS).max(axis=1)
        return np.maximum(out + self.shift, 0)

    def probability(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(starts, append=len(pooled))[:, None]
        features = np.hstack([np.add.reduceat(pooled, starts) / sizes, np.maximum.reduceat(pooled, starts)])
        return 1 / (1 + np.exp(-np.clip(features @ self.weight + self.bias[0], -30, 30)))

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over some documents."""
        chunk, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(docs)), sizes)
        windows = self.windows(chunk)
        response = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.filters
        response = response.reshape(windows.shape[0], windows.shape[1], FILTERS)
        best = response.argmax(axis=1)
        top = np.maximum(np.take_along_axis(response, best[:, None], 1)[:, 0] + self.shift, 0)
        mean = np.add.reduceat(top, starts) / sizes[:, None]
        most = np.maximum.reduceat(top, starts)
        features = np.hstack([mean, most])
        error = (1 / (1 + np.exp(-np.clip(features @ self.weight + self.bias[0], -30, 30))) - labels) / len(docs)
        back = error[:, None] * self.weight
        to_top = back[owner, :FILTERS] / sizes[owner, None]
        is_most = top == most[owner]
        share = np.add.reduceat(is_most.astype(np.float32), starts)[owner]
        to_top = (to_top + back[owner, FILTERS:] * is_most / share) * (top > 0)
        chosen = windows[np.arange(len(chunk))[:, None], best]  # (chunks, FILTERS, WIDTH * EMBED)
        to_window = to_top[..., None] * self.filters.T
        embed = np.zeros_like(self.embed)
        symbols = chunk[np.arange(len(chunk))[:, None, None], best[..., None] * STRIDE + np.arange(WIDTH)]
        np.add.at(embed, symbols.reshape(-1), to_window.reshape(-1, EMBED))
        embed[PAD] = 0
        return {"embed": embed, "filters": np.einsum("cf,cfw->wf", to_top, chosen), "shift": to_top.sum(0),
                "weight": features.T @ error + 1e-3 * self.weight, "bias": np.array([error.sum()])}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, model: bytes) -> Network:
        network = cls()
        with np.load(io.BytesIO(model)) as stored:
            for n in cls.NAMES:
                setattr(network, n, stored[n])
        return network


def _spread(pieces: np.ndarray) -> np.ndarray:
    """First, last and evenly spaced chunks between them."""
    return pieces[np.unique(np.linspace(0, len(pieces) - 1, TRAIN_CHUNKS).astype(int))]


def train(texts: list[str], labels: list[int]) -> bytes:
    """Adam over shuffled batches, classes weighing alike. No documents: the first weights."""
    network, rng = Network(), np.random.default_rng(5)
    docs, y = [_spread(chunks(t.encode())) for t in texts], np.array(labels, np.float32)
    by_class = [np.flatnonzero(y == v) for v in (0, 1)]
    if min(map(len, by_class)):
        size = max(map(len, by_class))
        first = {n: np.zeros_like(getattr(network, n)) for n in Network.NAMES}
        second, step = {n: v.copy() for n, v in first.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(np.concatenate([rng.permutation(np.resize(c, size)) for c in by_class]))
            for at in range(0, len(order), BATCH):
                part, step = order[at : at + BATCH], step + 1
                for n, g in network.gradients([docs[i] for i in part], y[part]).items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(network, n, (getattr(network, n) - RATE * move).astype(np.float32))
    elif len(y):
        network.weight[:] = 0
        network.bias[:] = 4.0 if y[0] else -4.0
    return network.dump()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> bytes:
    """A model from the labelled rows that are not held out."""
    return fit_in_task(training_sample(docs, labels, "quality", per_class), train)


def score(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of good quality, from every byte of the text. Null and
    empty texts are one chunk of padding. Rows keep their number and columns; an input
    column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work():
        network = Network.load(shared.value)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out, pieces, size = [], [], 0

            def flush() -> None:
                sizes = np.array([len(p) for p in pieces])
                out.append(network.probability(network.pooled(np.concatenate(pieces)), np.cumsum(sizes) - sizes))

            for text_ in text_bytes(batch.column(at)):
                pieces.append(chunks(text_))
                size += len(pieces[-1])
                if size >= 2048:
                    flush()
                    pieces, size = [], 0
            if pieces:
                flush()
            return [pa.array(np.concatenate(out).astype(np.float64) if out else np.empty(0))]

        return compute

    return map_batches(docs, work, [T.StructField("score", T.DoubleType())])
