"""Bottom-k fingerprints of documents.

A fingerprint keeps the ``K`` smallest 48-bit hashes of a text's distinct word
shingles.  Fingerprints of parts merge (the K smallest of both), and estimate
resemblance, containment and the number of distinct shingles.  With K shingles or
fewer all estimates are exact.

Rules: null or empty text, or text without words: the empty fingerprint; two empty
ones resemble each other fully (1), an empty and another not at all (0).  Fewer
words than a shingle has: the whole sequence is the one shingle.  Documents are
ordered by id, rows without id first, equal ids by text.  A single row is its own
successor.  Extra columns are left alone.  Empty table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcframe.llm.text import distinct, run_over, text_words

K = 128
WORDS = 5
BITS = 48
GROUP = 64


def sketches(column: pa.Array, words: int = WORDS, k: int = K) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of every whole text, sorted."""
    return [distinct(s[:4 * k] >> np.uint64(64 - BITS))[:k] for _, _, w in text_words(column) for s in w.shingles(words)]


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return distinct(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    new = np.concatenate([[True], both[1:] != both[:-1]])
    at = np.flatnonzero(new)[:k]
    repeated = np.append(~new[1:], False)
    return float(repeated[at].sum() / len(at))


def size(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) + 1) * 2.0**BITS


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j, m, n = resemblance(a, b, k), size(a, k), size(b, k)
    return min(1.0, j / (1 + j) * (m + n) / m)


def merged(parts: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, sketch) of all rows of ``parts(by, sketch array<long>)`` with one
    ``by``: the k smallest hashes, kept k at a time before the shuffle."""
    rows = parts.select(F.col(by), F.explode("sketch").alias("_h")).distinct()
    w = Window.partitionBy(by).orderBy("_h")
    return (rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            .groupBy(by).agg(F.array_sort(F.collect_list("_h")).alias("sketch")))


def fingerprints(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """(doc_id, sketch array<long>) of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for t in run_over(whole):
                yield pa.record_batch({"doc_id": t.column("doc_id"), "sketch": pa.array(
                    [s.astype(np.int64) for s in sketches(t.column("text"), words, k)], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, sketch array<long>")


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, extra, id, text) such that, sorted by bucket, extra and id,
    every document stands before its successor: each bucket holds a range of ids
    and, as an extra row, the document that follows (after the last, the first).
    Only ids are read to place the borders."""
    ids = docs.select("id")
    cuts = sorted(set(ids.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) \
        if buckets > 1 else []
    cuts = [int(x) for x in cuts]
    coarse = F.array(*[F.lit(x).cast("long") for x in cuts[GROUP - 1::GROUP]]) if len(cuts) >= GROUP \
        else F.array().cast("array<long>")
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in cuts[a:a + GROUP]])
                     for a in range(0, len(cuts), GROUP)] or [F.array().cast("array<long>")],
                   F.array().cast("array<long>"))
    upper = F.size(F.filter(coarse, lambda x: x <= F.col("id")))
    lower = F.size(F.filter(F.get(fine, F.col("upper")), lambda x: x <= F.col("id")))

    def placed(d: DataFrame) -> DataFrame:
        return d.withColumn("upper", upper).withColumn("bucket", F.col("upper") * GROUP + lower).drop("upper")

    firsts = placed(ids).groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()  # a row a bucket
    before = [(r["id"], firsts[k - 1]["bucket"]) for k, r in enumerate(firsts)]
    follows = docs.sparkSession.createDataFrame(before, "id long, target int")
    rows = placed(docs).join(F.broadcast(follows), "id", "left")
    return rows.withColumn("to", F.explode(F.when(F.col("target").isNull(), F.array(F.struct(
        F.col("bucket").alias("bucket"), F.lit(0).alias("extra")))).otherwise(F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")),
            F.struct(F.col("target").alias("bucket"), F.lit(1).alias("extra")))))).select("to.*", "id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike it is
    to the edited text and to the next document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none).cast("long")).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = in_order(rows, 4 * parts).repartition(parts, "bucket") \
        .sortWithinPartitions("bucket", "extra", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its successor: (bucket, id, text, sketch)
        for whole in batches:
            for t in run_over(whole, 1 << 20):
                own = list(zip(t.column("bucket").to_pylist(), t.column("id").to_pylist(),
                               t.column("text").to_pylist(), sketches(t.column("text"), words, k), strict=True))
                ready = []
                for row, extra in zip(own, t.column("extra").to_pylist(), strict=True):
                    if last is not None:  # a bucket ends with its extra row
                        ready.append((last, row))
                    last = None if extra else row
                texts = [edited(a[2], b[2]) for a, b in ready]
                other = sketches(pa.array(texts, pa.large_string()), words, k)
                yield pa.record_batch({
                    "doc_id": pa.array([None if a[1] == none else a[1] for a, _ in ready], pa.int64()),
                    "n_chars": pa.array([len(a[2]) for a, _ in ready], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                    "fingerprint": pa.array([to_text(a[3]) for a, _ in ready], pa.string()),
                    "edited_fingerprint": pa.array([to_text(x) for x in other], pa.string()),
                    "near_edited": pa.array([resemblance(a[3], x, k) for (a, _), x in zip(ready, other, strict=True)],
                                            pa.float64()),
                    "near_next": pa.array([resemblance(a[3], b[3], k) for a, b in ready], pa.float64())})

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")
