"""Language identification: sparse multinomial logistic regression on TF-IDF
weights of character n-grams.

Texts are read as lower-cased bytes with every run of non-letters as one space;
their 1- to ``N_MAX``-grams are counted in ``BUCKETS`` hash buckets, the counts
damped, weighted by inverse document frequency over all training documents and
scaled to unit length.  Weights are trained online with follow-the-regularised-
leader (per-coordinate rates) under L1 and L2 penalties, which leaves most of
them zero; a temperature fitted on rows kept back calibrates the probabilities.

Trained on at most ``PER_LANG`` documents of each language (at most ``SAMPLE``),
chosen by a hash of the id, outside the held fold.  Null text or text without a
letter: ``und`` with score 0; so is every text if there is nothing to learn from.
Rows without id are scored and held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcframe.llm import labelled
from srcframe.llm.text import _LOWER, NOT_LETTER, buffers, chunks, run_over

BUCKETS = 1 << 14
N_MAX = 3
PER_LANG = 1000
SAMPLE = 8000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
EPOCHS = 3
CHUNK = 1 << 19
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def grams(data: np.ndarray, off: np.ndarray, i: int, j: int) -> Iterator[np.ndarray]:
    """Per row i..j-1 the buckets of all its n-grams (with repetitions)."""
    base = int(off[i])
    b = data[base:int(off[j])]
    rel = off[i:j + 1] - base
    gap = NOT_LETTER[b]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # the first byte of a run of non-letters
    first = rel[:-1][rel[:-1] < len(b)]
    keep[first] = True
    c = np.where(gap, np.uint8(32), _LOWER[b])[keep].astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(keep)])[rel].tolist()
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    window, found = c, []
    for n in range(1, N_MAX + 1):
        if n > 1:
            window = (window[:-1] << np.uint32(8)) | c[n - 1:] if len(c) >= n else c[:0]
        h = (window + np.uint32(n)) * _MULT[n - 1]
        found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift)
    for a, z in zip(at[:-1], at[1:], strict=True):
        yield np.concatenate([f[a:max(a, z - n)] for n, f in enumerate(found)])


def rows_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Bucket counts of every whole text."""
    data, off = buffers(column)
    for i, j in chunks(off, CHUNK):
        for g in grams(data, off, i, j):
            yield np.bincount(g, minlength=BUCKETS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of ``docs(text)`` that hold each bucket, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for whole in batches:
            n += whole.num_rows
            for counts in rows_of(whole.column(0)):
                total += counts > 0
        on = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(np.append(on, -1), pa.int32()),
                               "n": pa.array(np.append(total[on], n), pa.int64())})

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")) \
        .toPandas()  # BUCKETS + 1 rows at most
    out = np.zeros(BUCKETS, np.int64)
    k = found["bucket"].to_numpy()
    out[k[k >= 0]] = found["n"].to_numpy()[k >= 0]
    return out, int(found["n"].to_numpy()[k < 0].sum())


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf.astype(np.float32)
        self.weight = np.zeros((BUCKETS, len(langs)), np.float32)
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that occur and their weights."""
        k = np.flatnonzero(counts)
        x = np.log1p(counts[k]) * self.idf[k]
        return k, x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        k, x = self.features(counts)
        return x @ self.weight[k] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], df: np.ndarray, n_docs: int, seed: int = 3) -> Model:
    names = sorted(set(langs), key=lambda s: s.encode())
    model = Model(names, np.log((1 + n_docs) / (1 + df)) + 1)
    if len(names) < 2:
        return model
    y = np.array([names.index(s) for s in langs])
    x = [model.features(c) for c in rows_of(pa.array(texts, pa.string()))]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, on = order[:len(y) // 5], order[len(y) // 5:]
    c = len(names)
    z, n = np.zeros((BUCKETS + 1, c)), np.zeros((BUCKETS + 1, c))  # the last row: bias, not penalised

    def weights(k):
        w = -(z[k] - np.sign(z[k]) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2)
        return np.where(np.abs(z[k]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i in rng.permutation(on):
            k, v = x[i]
            k, v = np.append(k, BUCKETS), np.append(v, 1.0)
            w = weights(k)
            p = _softmax(v @ w)
            p[y[i]] -= 1
            g = np.outer(v, p)
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
            n[k] += g * g
    every = weights(np.arange(BUCKETS + 1))
    model.weight, model.bias = every[:-1].astype(np.float32), every[-1]
    if len(back):
        raw = np.stack([x[i][1] @ model.weight[x[i][0]] + model.bias for i in back])
        temps = np.exp(np.linspace(-2.5, 1.5, 81))
        loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(back)), y[back]], 1e-12)).sum() for t in temps]
        model.temperature = float(temps[int(np.argmin(loss))])
    return model


def sample(docs: DataFrame, per_lang: int, limit: int) -> tuple[list[str], list[str]]:
    """Texts and languages: about ``per_lang`` documents of each language."""
    spark = docs.sparkSession
    # a sample of ``limit`` rows cannot hold more languages than that
    share = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(limit)
    # a language's documents by hash below a bound that about twice per_lang pass, then the first per_lang
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = (docs.select("doc_id", "lang").join(F.broadcast(share), "lang").withColumn("h", spread)
            .filter(F.col("h") < F.col("n").cast("double") ** -1 * float(2 * per_lang * (1 << 30))))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = (some.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_lang)
           .orderBy("r", "lang").select("doc_id").limit(limit).distinct().collect())
    if not ids:
        return [], []
    few = spark.createDataFrame([(r[0],) for r in ids], "doc_id long")  # ``limit`` rows at most
    found = docs.join(F.broadcast(few), "doc_id").select("doc_id", "lang", "text").toPandas() \
        .sort_values(["doc_id", "lang", "text"], kind="stable")
    return found["text"].tolist(), found["lang"].tolist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of ``docs(doc_id, held_out, text)``."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        for whole in batches:
            for t in run_over(whole):
                names, scores = [], []
                for counts, letters in zip(rows_of(t.column("text")), t.column("letters").to_pylist(), strict=True):
                    if not letters or not m.langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    p = _softmax(m.logits(counts) / m.temperature)
                    k = int(p.argmax())
                    names.append(m.langs[k])
                    scores.append(float(p[k]))
                yield pa.record_batch({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"),
                                       "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
                       .alias("letters")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = PER_LANG, limit: int = SAMPLE) -> DataFrame:
    """Learn from ``docs(doc_id, text, lang)`` outside the held fold, predict all."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
    train = every.filter(labelled.fold(F.col("doc_id")) != 2).filter("lang is not null") \
        .filter(F.col("text").rlike(r"\p{L}"))
    df, n = document_frequencies(train)
    texts, langs = sample(train, per_lang, limit)
    return predict(labelled.texts(docs), fit(texts, langs, df, n))
