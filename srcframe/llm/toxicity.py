"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of letters, lower-cased.  Document labels become token labels:
in toxic documents, tokens with a feature (the word or a prefix) whose documents
are nearly all toxic, beyond chance, are tagged T; all other tokens O.  The field
has weights on the word, its prefixes and its suffix (features seen in enough
documents; others weigh 0) and on tag transitions, fitted by gradient ascent on
the penalised log likelihood, with gradients from forward-backward marginals.
Over the corpus, every token's marginal P(T) comes from forward-backward over the
whole text; documents are scored by a logistic function of their marginals, and
runs of tokens with P(T) >= 0.5 are the offending spans (code-point offsets).

A two-tag chain is a sequence of 2x2 matrices, so forward and backward passes run
over blocks of a whole batch of documents at once; a document's first token resets
the chain.

Fitted on at most ``PER_CLASS`` documents of either label (outside the held
fold).  Null or empty text: no token; it gets the score of a text without toxic
tokens.  Rows without id are scored and held out.  Without labels of both classes
every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.llm import labelled
from srcframe.llm.text import NOT_LETTER, Words, distinct, mix, run_over, text_words

PER_CLASS = 1000
PREFIXES = (4, 5, 6, 7, 8)
MIN_DOCS = 4
EVIDENCE = 15.0     # log likelihood ratio that makes a feature a toxic one
PRECISION = 0.75
ROUNDS = 80
THRESHOLD = 0.3


def features(w: Words) -> list[np.ndarray]:
    """64-bit features of every token, an array for each kind; 0: none."""
    size = w.end - w.start
    out = [w.hash]
    for k in PREFIXES:
        h = w.part(w.start, np.minimum(w.start + k, w.end))
        out.append(np.where(size >= k, mix(h + np.uint64(k)), np.uint64(0)))
    h = w.part(np.maximum(w.end - 3, w.start), w.end)
    out.append(np.where(size >= 3, mix(h ^ np.uint64(0xABCDEF)), np.uint64(0)))
    return out


def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, length: int = 256) -> np.ndarray:
    """x[t] = (c + d x[t-1]) / (a + b x[t-1]) for all t, blocks side by side."""
    n = len(a)
    blocks = -(-n // length)
    pad = blocks * length - n

    def shaped(v, fill):
        return np.ascontiguousarray(np.concatenate([v, np.full(pad, fill)]).reshape(blocks, length).T)

    a, b, c, d = shaped(a, 1.0), shaped(b, 0.0), shaped(c, 0.0), shaped(d, 1.0)
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(length):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    enter, x = np.empty(blocks), 1.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        enter[k] = x
        x = (rk + sk * x) / (pk + qk * x)
    out, x = np.empty((length, blocks)), enter
    for t in range(length):
        x = (c[t] + d[t] * x) / (a[t] + b[t] * x)
        out[t] = x
    return out.T.reshape(-1)[:n]


class Field:
    """Weights of the fitted field and of the document score."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys                      # sorted features with a weight
        self.weight = np.zeros(len(keys) + 1)  # the last: no such feature
        self.bias, self.start = -4.0, 0.0
        self.move = np.zeros((2, 2))          # ln transition weights, from x to
        self.rate = 0.0
        self.final: np.ndarray | None = None
        self._near()

    def _near(self):
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "near"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._near()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Weight numbers of features."""
        out = np.full(len(h), len(self.keys), np.int32)
        maybe = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[k] == h[maybe], k, len(self.keys))
        return out

    def emissions(self, found: list[np.ndarray]) -> np.ndarray:
        return self.bias + sum(self.weight[f] for f in found)

    def messages(self, emit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward ratios, backward ratios, exp(emission)."""
        e = np.exp(np.clip(emit, -30, 30))
        m = np.exp(self.move)
        reset = np.zeros(len(e), bool)
        reset[first] = True
        s = np.exp(self.start)
        forward = chain(np.where(reset, 1.0, m[0, 0]), np.where(reset, 0.0, m[1, 0]),
                        np.where(reset, e * s, m[0, 1] * e), np.where(reset, 0.0, m[1, 1] * e))
        nxt = np.append(e[1:], 1.0)
        last = np.append(reset[1:], True)
        backward = chain(*(v[::-1] for v in (
            np.where(last, 1.0, m[0, 0]), np.where(last, 0.0, m[0, 1] * nxt),
            np.where(last, 1.0, m[1, 0]), np.where(last, 0.0, m[1, 1] * nxt))))[::-1]
        return forward, backward, e

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(emit):
            return np.zeros(0)
        f, b, _ = self.messages(emit, first)
        return f * b / (1 + f * b)

    def document(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Features of documents from the marginals of their tokens."""
        n = np.diff(bounds)
        top, total = np.zeros(len(n)), np.zeros(len(n))
        some = n > 0
        if some.any():
            top[some] = np.maximum.reduceat(p, bounds[:-1][some])
            total[some] = np.add.reduceat(p, bounds[:-1][some])
        top = np.clip(top, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(len(n)), np.log(top / (1 - top)), np.log1p(total),
                         np.log((total + 0.05) / (n + 20))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.final is None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(x @ self.final, -30, 30)))


def _adam(value, grad, state, k, rate):
    m, v = state
    m[...] = 0.9 * m + 0.1 * grad
    v[...] = 0.99 * v + 0.01 * grad * grad
    return value + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)


KINDS = len(PREFIXES) + 2  # of features


def _added(one: tuple, two: tuple) -> tuple:
    """Counts by feature of two parts together."""
    u, inv = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    return (u, *(np.bincount(inv, np.concatenate([a, b]), len(u)) for a, b in zip(one[1:], two[1:], strict=True)))


def fit(texts: list, y: np.ndarray, sizes: dict, rounds: int = ROUNDS) -> Field:
    """Field fitted on labelled documents; ``sizes``: labels by class overall."""
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not len(y) or y.min() == y.max():
        out = Field(np.zeros(0, np.uint64))
        out.rate = rate
        return out
    column = pa.array(texts, pa.string())

    # documents of either class that hold a feature; a document lies in one chunk, so chunks add up
    counts: list = [None] * KINDS
    for i, _, w in text_words(column, between=NOT_LETTER):
        doc = i + np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
        for k, f in enumerate(features(w)):
            by = np.lexsort((doc, f))
            fs, ds = f[by], doc[by]
            new = np.ones(len(fs), bool)
            new[1:] = (fs[1:] != fs[:-1]) | (ds[1:] != ds[:-1])
            u, inv = np.unique(fs[new], return_inverse=True)
            here = u, np.bincount(inv, y[ds[new]], len(u)), np.bincount(inv, minlength=len(u))
            counts[k] = here if counts[k] is None else _added(counts[k], here)
    seen, pos, neg = [], [], []
    for got in counts:
        if got is not None:
            u, toxic, n = got
            on = (n >= MIN_DOCS) & (u != 0)
            seen.append(u[on])
            pos.append(toxic[on])
            neg.append((n - toxic)[on])
    del counts
    none = [np.zeros(0)]
    key, a, b = np.concatenate(seen or [np.zeros(0, np.uint64)]), np.concatenate(pos or none), np.concatenate(neg or none)
    base, share = y.mean(), a / (a + b)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(a > 0, a * np.log(share / base), 0) +
                    np.where(b > 0, b * np.log((1 - share) / (1 - base)), 0))
    toxic = distinct(key[(share >= PRECISION) & (gain >= EVIDENCE)])
    out = Field(distinct(key))
    out.rate = rate

    # second pass: tags and feature numbers, 32 bits each
    bounds, tags_, numbers = [np.zeros(1, np.int64)], [np.zeros(0, bool)], []
    for _, _, w in text_words(column, between=NOT_LETTER):
        feats = features(w)
        hit = np.zeros(len(w.start), bool)
        for f in feats[:-1]:
            hit |= np.isin(f, toxic)
        tags_.append(hit)
        numbers.append([out.find(f).astype(np.int32) for f in feats])
        bounds.append(w.bounds[1:] + bounds[-1][-1])
    at = np.concatenate(bounds)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(at))
    first = at[:-1][np.diff(at) > 0]
    tagged = np.concatenate(tags_) & (y[doc] == 1)
    found = [np.concatenate(x) for x in zip(*numbers, strict=True)] if numbers else [np.zeros(0, np.int32)] * KINDS
    del numbers, tags_

    inner = np.ones(len(doc), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)  # tokens with a predecessor in their document
    tags = tagged.astype(int)
    seen_moves = np.bincount(2 * tags[inner - 1] + tags[inner], minlength=4).reshape(2, 2)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in
             (("w", out.weight), ("m", out.move), ("s", np.zeros(2)))}
    scale = 1 / max(1, tagged.sum())
    for k in range(1, rounds + 1):
        f, b, e = out.messages(out.emissions(found), first)
        p = f * b / (1 + f * b)
        miss = tagged - p
        gw = sum(np.bincount(x, miss, len(out.weight)) for x in found)
        gw[-1] = 0
        left, right = f[inner - 1], e[inner] * b[inner]
        m = np.exp(out.move)
        xi = np.stack([np.full(len(inner), m[0, 0]), m[0, 1] * right, m[1, 0] * left, m[1, 1] * left * right], 1)
        xi /= xi.sum(1, keepdims=True)
        gm = seen_moves - xi.sum(0).reshape(2, 2)
        gs = np.array([miss.sum(), miss[first].sum()])
        out.weight = _adam(out.weight, gw * scale - 2e-4 * out.weight, state["w"], k, 0.15)
        out.move = _adam(out.move, gm * scale - 2e-4 * out.move, state["m"], k, 0.05)
        out.bias, out.start = _adam(np.array([out.bias, out.start]), gs * scale, state["s"], k, 0.05)

    x = out.document(out.marginals(out.emissions(found), first), at)
    # class weights bring the sample back to the shares of all labels
    wt = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    theta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(50):  # Newton steps of a ridge-penalised logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (wt * (y - q)) - ridge @ theta
        hess = (x * (wt * q * (1 - q))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        theta += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    out.final = theta
    return out


def _spans(w: Words, p: np.ndarray, a: int, z: int, begin: int) -> list[dict]:
    """Runs of offending tokens a..z-1 of one row as code-point ranges."""
    bad = np.flatnonzero(p[a:z] >= 0.5) + a
    if not len(bad):
        return []
    cut = np.flatnonzero(np.diff(bad) > 1)
    lo, hi = bad[np.append(0, cut + 1)], bad[np.append(cut, len(bad) - 1)]
    points = np.concatenate([[0], np.cumsum((w.data[begin:w.end[hi[-1]]] & 0xC0) != 0x80)])
    return [{"begin": int(points[w.start[x] - begin]), "end": int(points[w.end[y] - begin])}
            for x, y in zip(lo, hi, strict=True)]


def _marked(column: pa.Array, model: Field) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Words, marginals and document features, chunk by chunk."""
    for _, _, w in text_words(column, between=NOT_LETTER):
        first = w.bounds[:-1][np.diff(w.bounds) > 0]
        p = model.marginals(model.emissions([model.find(f) for f in features(w)]), first)
        yield w, p, model.document(p, w.bounds)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row of
    ``docs(doc_id, held_out, text)``."""
    bc = docs.sparkSession.sparkContext.broadcast(field)  # at most one weight for each feature of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        for whole in batches:
            for t in run_over(whole):
                got, spans = [], []
                for w, p, x in _marked(t.column("text"), model):
                    got.append(model.scores(x))
                    some = x[:, 1] >= 0
                    spans += [_spans(w, p, w.bounds[k], w.bounds[k + 1], w.rel[k]) if some[k] else []
                              for k in range(len(x))]
                yield pa.record_batch({
                    "doc_id": t.column("doc_id"), "held_out": t.column("held_out"),
                    "score": pa.array(np.concatenate(got)),
                    "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))})

    return docs.mapInArrow(
        run, "doc_id long, held_out boolean, score double, spans array<struct<begin: int, end: int>>") \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    return labelled.fitted(docs, labels, "toxic", per_class, fit)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fit on labelled documents outside the held fold and score all documents."""
    return score(labelled.texts(docs), train(docs, labels, per_class))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, in all their columns, that are not toxic.  Without
    labels of both classes nothing is rejected."""
    field = train(docs, labels, per_class)
    bc = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        for whole in batches:
            for t in run_over(whole):
                scores = np.concatenate([model.scores(x) for _, _, x in _marked(t.column("text"), model)])
                yield t.filter(pa.array(scores < THRESHOLD))

    return docs if field.final is None else docs.mapInArrow(run, docs.schema)
