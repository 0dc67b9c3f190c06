"""Quality classifier: a byte-level convolutional network in numpy (operator 9).

The text's UTF-8 bytes, padded with zeros to whole strides, are cut into overlapping chunks that cover the whole document. Learned filters (one weight for
each filter, tap and byte value) slide over each chunk by STRIDE bytes; rectified responses are max-pooled over the chunk and combined
into a chunk logit, and the mean, least and greatest chunk logits of a document into one probability.

Fitting: at most PER_CLASS labelled documents of each class (a documented bound: the first ones by the hash of doc_id,
outside the held-out fold), of which at most MAX_BYTES of text; the classes' true shares come from all labels.

Null and empty texts are one chunk of padding and get a score like any other; held_out is false for a null doc_id.
Labels that are null or neither 0 nor 1 are ignored; without labels of both classes the score is the smoothed share of
label 1. Repeated rows give repeated results; an empty table an empty one; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, documents, fold, labelled_sample, sigmoid, table

TAPS, FILTERS, STRIDE = 6, 32, 2
CHUNK = 512  # bytes; chunks overlap by TAPS - STRIDE, so that every window lies in one
PER_CLASS, MAX_BYTES = 2_500, 64 << 20
STEPS, CROPS, RATE, SEED = 1_500, 64, 0.01, 7
FOLDS, HELD = 3, 1


def padded(text: str | None) -> np.ndarray:
    """The text's bytes, with zeros at the end up to whole strides, so that some window holds the last byte too."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return np.pad(raw, (0, max(TAPS - len(raw), (TAPS - len(raw)) % STRIDE)))


def responses(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter responses at every STRIDE-th position of the byte array x (last axis)."""
    n = (x.shape[-1] - TAPS) // STRIDE + 1
    out = np.take(w[0], x[..., : (n - 1) * STRIDE + 1 : STRIDE], axis=0)
    for k in range(1, TAPS):
        out += np.take(w[k], x[..., k : k + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
    return out


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = (r.standard_normal((TAPS, 256, FILTERS)) * 0.1).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = (r.standard_normal(FILTERS) * 0.1).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.combine = np.array([0.0, 1.0, 0.0, 0.0])  # of the mean, least and greatest logit; first a constant

    def chunk_logits(self, raw: np.ndarray) -> np.ndarray:
        """A logit for each chunk; windows are computed once, as chunks share none."""
        each = (CHUNK - TAPS) // STRIDE + 1
        total = (len(raw) - TAPS) // STRIDE + 1
        out = []
        for a in range(0, total, 64 * each):  # bounded memory for texts of any length
            r = responses(self.w, raw[a * STRIDE : (min(total, a + 64 * each) - 1) * STRIDE + TAPS])
            pooled = np.maximum.reduceat(r, np.arange(0, len(r), each), axis=0)
            out.append(np.maximum(pooled + self.b, 0) @ self.v + self.c)
        return np.concatenate(out)

    def features(self, text: str | None) -> np.ndarray:
        z = self.chunk_logits(padded(text)).astype(np.float64)
        return np.array([1.0, z.mean(), z.min(), z.max()])

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.features(text) @ self.combine))

    def fit(self, texts: list[str], labels: np.ndarray, prior: float, steps: int = STEPS, seed: int = SEED) -> Network:
        """Adam on random chunks of balanced documents, then a logistic fit over whole documents; prior is label 1's true share."""
        r = np.random.default_rng(seed)
        raws = [padded(t) for t in texts]
        by = [np.flatnonzero(labels == y) for y in (0, 1)]
        params = [self.w, self.b, self.v, self.c]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        y = np.repeat([0.0, 1.0], CROPS // 2).astype(np.float32)
        for step in range(1, steps + 1):
            x = np.zeros((CROPS, CHUNK), np.uint8)
            for row, d in enumerate(np.concatenate([r.choice(by[0], CROPS // 2), r.choice(by[1], CROPS // 2)])):
                a = r.integers(0, max(1, len(raws[d]) - CHUNK + 1))
                part = raws[d][a : a + CHUNK]
                x[row] = np.resize(part, CHUNK) if len(part) < CHUNK else part
            z = responses(self.w, x)
            at = z.argmax(axis=1)
            pooled = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.b
            h = np.maximum(pooled, 0)
            g = (sigmoid(h @ self.v + self.c) - y)[:, None] / CROPS
            dh = np.where(pooled > 0, g * self.v, 0).astype(np.float32)
            dw = np.zeros_like(self.w)
            rows, filters = np.arange(CROPS)[:, None], np.arange(FILTERS)[None]
            for k in range(TAPS):
                np.add.at(dw[k], (x[rows, at * STRIDE + k], filters), dh)
            grads = [dw, dh.sum(0), (h * g).sum(0), g.sum(0)]
            rate = RATE * (1 - 0.9 * step / steps)
            for p, d, m, s in zip(params, grads, first, second):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        f = np.array([self.features(t) for t in texts])
        self.combine = logistic(f, labels)
        share = float(labels.mean())
        self.combine[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
        return self


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; the ridge leaves the first column, a constant, alone."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return w


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Network:
    sample, (n0, n1) = labelled_sample(spark, docs, labels, "quality", FOLDS, HELD, per_class)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    total, texts, ys = 0, [], []
    for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        total += len((r["text"] or "").encode())
        if total > max_bytes:
            break
        texts.append(r["text"])
        ys.append(r["y"])
    net, y = Network(), np.array(ys, np.float64)
    if 0 < y.sum() < len(y):
        return net.fit(texts, y, prior)
    net.combine = np.array([math.log(prior / (1 - prior)), 0.0, 0.0, 0.0])
    return net


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs. The network (200 KB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        n = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            s = [n.score(t) for t in batch.column(2).to_pylist()]
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": [int(x >= 0.5) for x in s]}

        return step

    return by_batch(docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "text"), "doc_id long, held_out boolean, score double, predicted int", make)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(spark, docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
