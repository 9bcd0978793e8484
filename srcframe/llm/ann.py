"""Approximate nearest neighbours by inner product with cross-polytope hashing.

Candidates are dealt into bands of nearly equal norm (``BANDS`` for each doubling),
in which inner product orders nearly like cosine; all vectors are scaled to unit
length, and a query probes every band.  In each of ``TABLES`` tables a fast
pseudo-rotation (three rounds of random signs and a Hadamard transform) is applied,
and a vector is filed under the signed axis nearest to it; a query probes its
``PROBES`` nearest axes.  All vectors filed there are candidates and are ranked by
their exact inner product in double precision, ties of the last place included.
Queries that found fewer than k are compared with all candidates.

Equal vectors are one candidate with its ``k + 1`` smallest ids (no query needs
more) and one query, so many copies of a vector cost as much as one.  A bucket is
cut into groups of about ``GROUP`` candidates and as many queries, by its counted
size.

Rules: vectors that are null, empty, zero, or hold null or non-finite components,
vectors of another length than most (the longer one, if equally frequent), and rows
without id take no part.  Repeated rows count once.  Fewer candidates than k: all
that are found.  Ties go to the smaller id.  Empty table: no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcframe.session import Scratch

TABLES = 32
PROBES = 6
BANDS = 4
GROUP = 4096
SEED = 41


class Rotations:
    """The pseudo-rotations of all tables for vectors of one length."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.size = 1 << dim.bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def _hadamard(self, v: np.ndarray) -> np.ndarray:
        h = 1
        while h < self.size:
            w = v.reshape(len(v), -1, 2, h)
            v = np.stack([w[:, :, 0] + w[:, :, 1], w[:, :, 0] - w[:, :, 1]], 2).reshape(len(v), self.size)
            h *= 2
        return v / np.sqrt(self.size)

    def axes(self, v: np.ndarray, table: int, m: int) -> np.ndarray:
        """The m nearest signed axes (2 * coordinate + sign) of unit vectors."""
        x = np.zeros((len(v), self.size))
        x[:, :v.shape[1]] = v
        for s in self.signs[table]:
            x = self._hadamard(x * s)
        near = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :m]
        return 2 * near + (np.take_along_axis(x, near, 1) < 0)


def best(number: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best rows of each query, distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, -score, number))
    number, ids, score = number[order], ids[order], score[order]
    order = np.lexsort((np.arange(len(ids)), ids, number))
    n, i = number[order], ids[order]
    first = np.ones(len(ids), bool)
    first[order[1:]] = (n[1:] != n[:-1]) | (i[1:] != i[:-1])  # an id's best row, which is its first in order
    number, ids, score = number[first], ids[first], score[first]
    start = np.searchsorted(number, number)
    keep = np.arange(len(number)) - start < k
    return number[keep], ids[keep], score[keep]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column) if not isinstance(column, pa.Array) else b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(-1, dim)


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``vectors(vec_id,
    embedding)`` where the column ``is_query`` is true, its k nearest others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.filter("vec_id is not null and size(v) > 0").filter(
        F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))).filter(F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return empty
    dim = lengths[0]["d"]
    rows = rows.filter(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    band = F.floor(F.log2(norm) * BANDS + 0.5).cast("int")  # no border at norm 1

    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter("is_query").select("vec_id", "v")
    classes = scratch.save(
        classes.withColumn("cid", F.col("ids")[0]).withColumn("band", band)
        .join(asked.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left"), "classes")
    members = scratch.save(asked.join(classes.select("v", "cid"), "v").select("vec_id", "cid"), "members")
    turn = Rotations(dim, tables)

    def filed(m: int, query: bool):
        m = min(m, turn.size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 2048):
                    t = whole.slice(a, 2048)
                    v = t.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    raw = pa.array([x.tobytes() for x in v], pa.binary())
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    for table in range(tables):
                        axis = turn.axes(unit, table, m)
                        at = np.repeat(np.arange(len(v)), m)
                        cols = {"tab": pa.array(np.full(len(at), table, np.int32)),
                                "axis": pa.array(axis.reshape(-1).astype(np.int32)),
                                "cid": t.column("cid").take(pa.array(at)), "raw": raw.take(pa.array(at))}
                        if not query:
                            cols["band"] = t.column("band").take(pa.array(at))
                            cols["ids"] = t.column("ids").take(pa.array(at))
                        yield pa.record_batch(cols)
        return run

    spread = "tab int, axis int, cid long, raw binary"
    cand = classes.select("cid", "v", "band", "ids").mapInArrow(filed(1, False), spread + ", band int, ids array<long>")
    ask = classes.filter("asks").select("cid", "v").mapInArrow(filed(probes, True), spread)

    # group counts of a bucket: tables x axes x bands rows at most
    def groups(d: DataFrame, name: str, *more: str) -> DataFrame:
        return d.groupBy("tab", "axis", *more).agg(F.ceil(F.count("*") / GROUP).cast("int").alias(name))

    cand = scratch.save(cand, "candidates")
    ask = scratch.save(ask, "asked")

    def dealt(d: DataFrame, cut: DataFrame, own: str, other: str) -> DataFrame:
        return (d.join(F.broadcast(cut), ["tab", "axis", "band"] if own == "cs" else ["tab", "axis"])
                .withColumn("band", F.col("band") + 0)  # a column of its own on either side
                .withColumn("own", F.pmod(F.xxhash64("cid"), F.col(own)).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .withColumn("x", F.col("own") if own == "cs" else F.col("other"))
                .withColumn("y", F.col("other") if own == "cs" else F.col("own")))

    key = ["tab", "axis", "band", "x", "y"]

    def rank(c: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("cid", pa.int64()), ("found", pa.binary())])
        if not c.num_rows or not q.num_rows:
            return schema.empty_table()
        cv, qv = _matrix(c.column("raw"), dim), _matrix(q.column("raw"), dim)
        ids = c.column("ids").to_pylist()
        longest = np.linalg.norm(cv, axis=1).max()
        out = []
        for a in range(0, len(qv), 256):
            near = qv[a:a + 256] @ cv.T
            m = min(len(cv), k + 1)  # and all that tie with the last, ranked anew by exact sums
            least = np.partition(near, len(cv) - m, axis=1)[:, len(cv) - m]
            slack = 1e-12 * np.linalg.norm(qv[a:a + 256], axis=1) * longest
            n, j = np.nonzero(near >= (least - slack)[:, None])
            exact = (qv[a + n] * cv[j]).sum(1)
            size = np.array([len(ids[x]) for x in j])
            each = np.array([i for x in j for i in ids[x]], np.int64)
            n, i, s = best(np.repeat(n, size), each, np.repeat(exact, size), k + 1)
            for z in range(len(near)):
                lo, hi = np.searchsorted(n, [z, z + 1])
                out.append(i[lo:hi].tobytes() + s[lo:hi].tobytes())
        return pa.table({"cid": q.column("cid").combine_chunks(), "found": pa.array(out, pa.binary())}, schema=schema)

    def lists(c: DataFrame, q: DataFrame) -> DataFrame:
        cut = groups(c, "cs", "band").join(groups(q, "qs"), ["tab", "axis"])
        return dealt(c, cut, "cs", "qs").select(*key, "raw", "ids").groupBy(*key).cogroup(
            dealt(q, cut, "qs", "cs").select(*key, "cid", "raw").groupBy(*key)).applyInArrow(rank, "cid long, found binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for t in batches:
            n, i, s = [held[0]], [held[1]], [held[2]]
            for c, f in zip(t.column("cid").to_pylist(), t.column("found"), strict=True):
                raw = f.as_buffer()
                m = raw.size // 16
                n.append(np.full(m, c, np.int64))
                i.append(np.frombuffer(raw, np.int64, m))
                s.append(np.frombuffer(raw, np.float64, m, 8 * m))
            held = best(np.concatenate(n), np.concatenate(i), np.concatenate(s), k + 1)
        yield pa.record_batch({"cid": pa.array(held[0]), "vec_id": pa.array(held[1]), "score": pa.array(held[2])})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def gathered(d: DataFrame) -> DataFrame:
        return d.repartition(parts, "cid").mapInArrow(gather, "cid long, vec_id long, score double")

    found = scratch.save(gathered(lists(cand, ask)), "found")
    have = min(k + 1, rows.select("vec_id").distinct().limit(k + 1).count())
    enough = found.groupBy("cid").agg(F.count("*").alias("n")).filter(F.col("n") >= have).select("cid")
    few = scratch.save(classes.filter("asks").select("cid").join(enough, "cid", "left_anti"), "few")
    if not few.isEmpty():
        first = cand.filter("tab = 0").withColumns({"axis": F.lit(0), "band": F.lit(0)})
        again = ask.filter("tab = 0").dropDuplicates(["cid"]).withColumn("axis", F.lit(0)).join(few, "cid", "left_semi")
        found = scratch.save(found.join(few, "cid", "left_anti").unionByName(gathered(lists(first, again))), "all")
    scratch.drop("candidates", "asked")
    others = found.join(members.withColumnRenamed("vec_id", "query_id"), "cid").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
