"""Document quality from random-indexing word vectors and a two-layer network.

Tokens are runs of letters and runs of other visible characters, as written.
Every token has a sparse index vector (``NONZERO`` signed ones among ``DIM``,
from its hash); a word's vector is the sum of the index vectors of its
neighbours, two on either side, over the whole corpus.  Words share
``BUCKETS`` rows by hash, so the table has a fixed size; tasks add up their own
table, Spark adds the tables block by block.  A document is the mean and the
spread of its words' unit vectors (a text of few repeated words has no spread)
and its length; a network with one hidden layer is fitted in numpy on a bounded
labelled sample, and a temperature on rows kept back from fitting brings its
probabilities to the observed shares.

Labels come only from rows outside the held fold; the word vectors use texts
alone.  Null or empty text: no tokens, all features zero, a defined score.  Rows
without id are scored and held out.  Without labels of both classes every score
is the share of good labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.llm import labelled
from srcframe.llm.text import NOT_LETTER, Words, _SPACE, buffers, chunks, run_over

PER_CLASS = 1500
BUCKETS = 1 << 14
DIM = 64
NONZERO = 2
REACH = 2
BLOCKS = 64
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.7
CHUNK = 1 << 19
_OTHER = ~(NOT_LETTER & ~_SPACE)  # separates runs of visible non-letters


def tokens(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of rows i..j-1 in reading order, and row bounds."""
    a = Words(data, off, i, j, lower=False, between=NOT_LETTER)
    b = Words(data, off, i, j, lower=False, between=_OTHER)
    start = np.concatenate([a.start, b.start])
    order = np.argsort(start, kind="stable")
    return np.concatenate([a.hash, b.hash])[order], a.bounds + b.bounds


def _index_vectors(h: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Positions and signs of the index vectors."""
    place, sign = [], []
    for k in range(NONZERO):
        part = (h >> np.uint64(16 * k + 8)).astype(np.int64)
        place.append(part & (DIM - 1))
        sign.append(1.0 - 2.0 * ((part >> 7) & 1))
    return place, sign


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM unit rows over all texts of ``docs(text)``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        for whole in batches:
            data, off = buffers(whole.column(0))
            for i, j in chunks(off, CHUNK):
                h, bounds = tokens(data, off, i, j)
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                at = _bucket(h) * DIM
                place, sign = _index_vectors(h)
                cell, value = [], []
                for d in range(1, REACH + 1):
                    same = np.flatnonzero(row[d:] == row[:-d])
                    for p, s in zip(place, sign, strict=True):
                        cell += [at[same] + p[same + d], at[same + d] + p[same]]
                        value += [s[same + d], s[same]]
                if cell:
                    total += np.bincount(np.concatenate(cell), np.concatenate(value), len(total))
        size = len(total) // BLOCKS
        table = total.astype(np.float32)
        yield pa.record_batch({"block": pa.array(np.arange(BLOCKS, dtype=np.int32)), "cells": pa.array(
            [table[b * size:(b + 1) * size].tobytes() for b in range(BLOCKS)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # this task's blocks
        for t in batches:
            for b, cells in zip(t.column("block").to_pylist(), t.column("cells"), strict=True):
                v = np.frombuffer(cells.as_buffer(), np.float32).astype(np.float64)
                sums[b] = sums[b] + v if b in sums else v
        yield pa.record_batch({"block": pa.array(list(sums), pa.int32()),
                               "cells": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    found = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(part, "block int, cells binary")
             .repartition(BLOCKS // 4, "block").mapInArrow(add, "block int, cells binary").collect())
    out = np.zeros(BUCKETS * DIM)
    size = len(out) // BLOCKS
    for r in found:
        out[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["cells"])
    out = out.reshape(BUCKETS, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of whole texts: mean and spread of word vectors, number of tokens
    and of different ones, share of tokens that repeat the one before."""
    data, off = buffers(column)
    out = np.zeros((len(off) - 1, 2 * DIM + 4))
    for i, j in chunks(off, CHUNK):
        h, bounds = tokens(data, off, i, j)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        at, m = bounds[some], n[some][:, None]
        bucket = _bucket(h)
        mean = np.empty((len(some), DIM))
        square = np.empty((len(some), DIM))
        for a in range(0, len(some), 64):  # a few rows at a time keep the gathered vectors small
            z = min(a + 64, len(some))
            lo, hi = at[a], at[z] if z < len(some) else len(h)
            v = vectors[bucket[lo:hi]]
            mean[a:z] = np.add.reduceat(v, at[a:z] - lo)
            square[a:z] = np.add.reduceat(v * v, at[a:z] - lo)
        mean /= m
        spread = np.sqrt(np.maximum(square / m - mean * mean, 0))
        row = np.repeat(np.arange(j - i), n)
        again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=j - i)[some]
        order = np.lexsort((h, row))
        k, r = h[order], row[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        kinds = np.bincount(r[new], minlength=j - i)[some]
        out[i + some] = np.concatenate(
            [mean, spread, np.log1p(m), np.linalg.norm(mean, axis=1, keepdims=True),
             np.log1p(kinds[:, None]), again[:, None] / m], axis=1)
    return out


def crops(texts: list, seed: int = 7) -> list[str]:
    """A short passage of every text (1 to 64 words, short ones more often), so
    that the network also learns what short texts look like."""
    rng = np.random.default_rng(seed)
    out = []
    for t in texts:
        words = (t or "").split()
        n = min(len(words), int(2 ** rng.uniform(0, 6)))
        a = int(rng.integers(0, len(words) - n + 1))
        out.append(" ".join(words[a:a + n]))
    return out


class Network:
    """tanh hidden layer, logistic output, temperature."""

    def __init__(self, rate: float = 0.0):
        self.rate, self.layers, self.temperature = rate, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, shift, scale = self.layers
        return np.tanh((x - shift) / scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, sizes: dict, seed: int = 5) -> Network:
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    net = Network(rate)
    if not len(y) or y.min() == y.max():
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, on = order[:len(y) // 5], order[len(y) // 5:]
    if y[on].min() == y[on].max():
        on = order
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))  # to the shares of all labels
    shift, scale = x[on].mean(0), x[on].std(0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(on)
        for a in range(0, len(shuffled), 64):
            k = shuffled[a:a + 64]
            z = (x[k] - shift) / scale
            h = np.tanh(z @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            g = weight[k] * (out - y[k]) / len(k)
            back_h = np.outer(g, p[2]) * (1 - h * h)
            grads = [z.T @ back_h + 1e-4 * p[0], back_h.sum(0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
            step += 1
            for q in range(4):
                m[q] = 0.9 * m[q] + 0.1 * grads[q]
                v[q] = 0.999 * v[q] + 0.001 * grads[q] ** 2
                p[q] = p[q] - 3e-3 * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    net.layers = (*p, shift, scale)
    if len(back):
        z = net.logits(x[back])
        temps = np.exp(np.linspace(-1.0, 2.0, 61))
        loss = [np.sum(weight[back] * np.logaddexp(0, np.where(y[back] == 1, -z, z) / t)) for t in temps]
        net.temperature = float(temps[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, network from labels outside the held fold."""
    vectors = word_vectors(docs)
    found, sizes = labelled.sample(docs, labels, "quality", per_class)
    texts, y = found["text"].tolist(), found["y"].to_numpy().astype(float)
    x = pool(pa.array(texts + crops(texts), pa.string()), vectors)
    return vectors, fit(x, np.concatenate([y, y]), sizes)


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of ``docs(doc_id, held_out, text)``."""
    bc = docs.sparkSession.sparkContext.broadcast((vectors, net))  # BUCKETS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = bc.value
        for whole in batches:
            for t in run_over(whole):
                yield pa.record_batch({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"),
                                       "score": pa.array(model.probabilities(pool(t.column("text"), table)))})

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Scores of all documents."""
    return score(labelled.texts(docs), *train(docs, labels, per_class))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, in all their columns, that are not rejected.  Without
    labels of both classes nothing is rejected."""
    vectors, net = train(docs, labels, per_class)
    bc = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = bc.value
        for whole in batches:
            for t in run_over(whole):
                good = model.probabilities(pool(t.column("text"), table)) >= THRESHOLD
                yield t.filter(pa.array(good))

    return docs if net.layers is None else docs.mapInArrow(run, docs.schema)
