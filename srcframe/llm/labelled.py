"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, mod: int = 4):
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    return F.crc32(doc_id.cast("long").cast("string")) % mod


def texts(docs: DataFrame, held: int = 2) -> DataFrame:
    """(doc_id, held_out, text) of every row; a row without id is held out."""
    i = F.col("doc_id").cast("long")
    return docs.select(i.alias("doc_id"), F.coalesce(fold(i) == held, F.lit(True)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))


def rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held: int = 2) -> tuple[DataFrame | None, dict]:
    """Up to ``per_class`` labelled documents of either class outside the held
    fold, chosen by a hash of the id, as (doc_id, text, y), and the number of all
    such documents by class (no frame if there is none).  Repeated labels count as
    their maximum; null ids or labels, and labels whose id is not in ``docs``, are
    passed over before anything is counted or chosen."""
    spark = docs.sparkSession
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .filter("doc_id is not null and y in (0, 1)").filter(fold(F.col("doc_id")) != held)
             .groupBy("doc_id").agg(F.max("y").alias("y"))
             .join(there, "doc_id", "left_semi"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(*order).limit(per_class).collect()]
    if not ids:
        return None, sizes
    few = spark.createDataFrame(ids, "doc_id long, y int")  # 2 * per_class rows at most
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(F.broadcast(few), "doc_id"))
    return found, sizes


def _sorted(found: pd.DataFrame) -> pd.DataFrame:
    return found.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held: int = 2) -> tuple[pd.DataFrame, dict]:
    """``rows`` as pandas."""
    found, sizes = rows(docs, labels, label, per_class, held)
    return pd.DataFrame({"doc_id": [], "text": [], "y": []}) if found is None else _sorted(found.toPandas()), sizes


SAMPLE_BYTES = 16 << 20  # of text in a sample, per class


class _Within:
    """Rows of least ``order`` whose texts take at most ``limit`` bytes together
    (or the first row), of rows that come one by one in any order."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.size, self.n = limit, [], 0, 0

    def add(self, order: int, row: tuple) -> None:
        size = len(row[1].encode()) if row[1] else 0
        self.n += 1
        heapq.heappush(self.heap, (-order, -(row[0] or 0), -self.n, size, row))
        self.size += size
        while self.size > self.limit and len(self.heap) > 1:
            self.size -= heapq.heappop(self.heap)[3]


def fitted(docs: DataFrame, labels: DataFrame, label: str, per_class: int, fit: Callable,
           max_bytes: int = SAMPLE_BYTES):
    """``fit(texts, y, sizes)`` on the sample, in one task of an executor: its
    texts and work do not burden the driver, which gets the model only.  Of
    either class the documents that come first by the hash of their id are
    taken, ``per_class`` at most and ``max_bytes`` of text."""
    found, sizes = rows(docs, labels, label, per_class)
    if found is None:
        return fit([], np.zeros(0), sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {0: _Within(max_bytes), 1: _Within(max_bytes)}
        for t in batches:
            for order, *row in zip(*(t.column(c).to_pylist() for c in ("order", "doc_id", "text", "y")), strict=True):
                kept[row[2]].add(order, tuple(row))
        few = _sorted(pd.DataFrame([x[4] for k in kept.values() for x in k.heap], columns=["doc_id", "text", "y"]))
        model = fit(few["text"].tolist(), few["y"].to_numpy().astype(float), sizes)
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})

    one = found.withColumn("order", F.xxhash64("doc_id")).repartition(1)  # 2 * per_class rows at most
    made = one.mapInArrow(run, "model binary").collect()  # no row if none of the documents is there
    return pickle.loads(made[0]["model"]) if made else fit([], np.zeros(0), sizes)
