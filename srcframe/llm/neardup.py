"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set is its distinct k-word shingles.  Equal sets form one class.
Each class has a MinHash signature and is posted under its coordinate-value
pairs.  Two sets at the similarity sought agree in at least ``floor`` of the ``POSTED`` first coordinates (missed with
probability under ``miss``), so, with each signature's pairs ordered from rare to
frequent, they meet in the first ``POSTED - floor + 1`` of both: only this prefix
is posted, and frequent pairs (boilerplate) are skipped.  The collisions of two
classes that meet are then counted over the whole signatures of ``COORDS``, and
pairs that reach the match threshold are confirmed on full sets.

A posting list is never expanded into all its pairs.  First every member is
compared with the list's smallest class; the links found give components, and
only members of *different* components that still share a list are compared: a
pair inside one component cannot change the result.  Lists of up to ``SHORT``
classes do that by a join; longer ones are cut into blocks of about ``BLOCK``
classes, and every pair of blocks is a task of its own that holds the sets of its
members, confirms links on them and hands back only links that join something.
There a pair belongs to the first coordinate under which both are posted, so no
list repeats another's work.

Rules: null or empty text, or text without words: an empty set, linked with
nothing.  Fewer than k words: the whole sequence is the one shingle.  Rows
without ``doc_id`` take no part (component null, not kept).  Repeated rows with
one id share its component.  Extra columns are left alone.  Empty table: empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from srcframe.llm.graph import components
from srcframe.llm.text import distinct, mix, run_over, text_words
from srcframe.session import Scratch

POSTED = 40
COORDS = 128
SHORT = 32
BLOCK = 4096
MISS = 1e-6
_RNG = np.random.default_rng(977)
_XOR = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SET_SCHEMA = "doc_id long, n_shingles long, fp binary, sig array<int>"


def match_floor(coords: int, similarity: float, miss: float = MISS) -> int:
    """The largest count of equal coordinates that two sets of this similarity
    fall short of with probability ``miss`` at most."""
    total, t = 0.0, 0
    while t < coords:
        total += math.comb(coords, t) * similarity**t * (1 - similarity) ** (coords - t)
        if total > miss:
            break
        t += 1
    return max(t, 1)


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a shingle set (sums of two scrambles of its hashes)."""
    a = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) ^ np.uint64(len(s))
    return a.tobytes() + b.tobytes()


def _signature(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """Signatures of non-empty sets, a row each."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), coords), np.uint32)
    for c in range(coords):
        out[:, c] = np.minimum.reduceat((flat ^ _XOR[c]) * _MUL[c], at) >> np.uint64(32)
    return out.view(np.int32)


def shingle_sets(docs: DataFrame, words: int, coords: int) -> DataFrame:
    """Per document: size and fingerprint of its set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for t in run_over(whole):
                sets = []
                for _, _, w in text_words(t.column("text")):
                    sets += w.shingles(words)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                for a in range(0, len(full), 256):
                    part = full[a:a + 256]
                    for k, row in zip(part, _signature([sets[k] for k in part], coords), strict=True):
                        sig[k] = row
                yield pa.record_batch({
                    "doc_id": t.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "fp": pa.array([fingerprint(s) for s in sets], pa.binary()),
                    "sig": pa.array(sig, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .filter("doc_id is not null").mapInArrow(run, SET_SCHEMA)


def class_sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(fp, members) of the texts of the documents ``need(doc_id)``, members being
    the full sorted set of 64-bit shingle hashes."""

    def make(batches):
        for whole in batches:
            for t in run_over(whole):
                sets = [s for _, _, w in text_words(t.column("text")) for s in w.shingles(words)]
                yield pa.record_batch({"fp": pa.array([fingerprint(s) for s in sets], pa.binary()),
                                       "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(need, "doc_id", "left_semi").mapInArrow(make, "fp binary, members binary").dropDuplicates(["fp"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""

    def compare(batches):
        for t in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(t.column("sa"), t.column("sb"), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("fp").alias("a"), F.col("members").alias("sa")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("members").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(compare, "a binary, b binary"))


def _block_links(rows: DataFrame, floor: int, percent: int) -> DataFrame:
    """Links between different components inside pairs of blocks.  ``rows``: key,
    c (coordinate), i, j (blocks), own (block of the row), fp, part, posted (bits
    of the coordinates posted), sig, members."""

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        fp, part = t.column("fp").to_pylist(), t.column("part").to_pylist()
        n, c = len(fp), t.column("c")[0].as_py()
        number = {p: k for k, p in enumerate(dict.fromkeys(part))}
        root = np.arange(len(number))
        at = np.array([number[p] for p in part])
        sig = t.column("sig").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        sig8 = np.ascontiguousarray((sig & 255).astype(np.uint8).T)
        posted = t.column("posted").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("members").chunk(0)]
        own = t.column("own").to_numpy()
        left = np.flatnonzero(own == t.column("i")[0].as_py())
        right = np.flatnonzero(own == t.column("j")[0].as_py())
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for k in range(0, len(left), 64):
            rows = left[k:k + 64]
            equal = np.zeros((len(rows), len(right)), np.uint8)
            for s in sig8:
                equal += s[rows][:, None] == s[right][None, :]
            maybe = (equal >= floor) & (at[rows][:, None] != at[right][None, :])
            if same:
                maybe &= rows[:, None] < right[None, :]
            x, y = np.nonzero(maybe)
            x, y = rows[x], right[y]
            first = np.ones(len(x), bool)  # no earlier coordinate under which both are posted
            for e in range(c):
                first &= (sig[x, e] != sig[y, e]) | (((posted[x] & posted[y]) >> e) & 1 == 0)
            for u, v in zip(x[first].tolist(), y[first].tolist(), strict=True):
                p, q = find(at[u]), find(at[v])
                if p != q and linked(sets[u], sets[v], percent):
                    root[p] = q
                    a.append(fp[u])
                    b.append(fp[v])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links),
    kept: one row per row of ``docs(doc_id, text)`` that has an id."""
    return grouped(docs, words, percent, miss).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, words: int, percent: int, miss: float = MISS) -> DataFrame:
    """doc_id, fp (class), n_shingles, component_id, chosen (the row's class
    represents its component, under the component's smallest id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    meet = POSTED - match_floor(POSTED, percent / 100, miss) + 1
    floor = match_floor(COORDS, percent / 100, miss)

    rows = scratch.save(shingle_sets(docs, words, COORDS), "rows")
    classes = scratch.save(
        rows.filter("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")),
        "classes")

    # postings: the rare prefix of every signature, without pairs that stand alone
    posts = classes.select("fp", F.posexplode(F.slice("sig", 1, POSTED)).alias("c", "v")).select(
        "fp", (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v")).alias("key"), "c")
    common = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    by_class = Window.partitionBy("fp")
    lists = scratch.save(
        posts.join(common, "key")
        .withColumn("r", F.row_number().over(by_class.orderBy("n", "key")))
        .withColumn("alone", POSTED - F.count("*").over(by_class))
        .filter(F.col("r") + F.col("alone") <= meet).select("key", "fp", "c"), "lists")
    centers = lists.groupBy("key").agg(F.min("fp").alias("center"), F.count("*").alias("n")).filter("n > 1")

    def matching(pairs: DataFrame) -> DataFrame:
        sig = classes.select("fp", "sig")
        same = F.expr("aggregate(zip_with(x, y, (p, q) -> if(p = q, 1, 0)), 0, (s, e) -> s + e)")
        return (pairs.join(sig.select(F.col("fp").alias("a"), F.col("sig").alias("x")), "a")
                .join(sig.select(F.col("fp").alias("b"), F.col("sig").alias("y")), "b")
                .filter(same >= floor).select("a", "b"))

    star_pairs = scratch.save(matching(
        lists.join(centers, "key").filter("fp <> center")
        .select(F.col("center").alias("a"), F.col("fp").alias("b")).distinct()), "star_pairs")

    # sets of all classes that a list compares with another
    nodes = lists.join(centers.select("key"), "key", "left_semi").select("fp").distinct()
    sets = scratch.save(class_sets(docs, nodes.join(classes.select("fp", "doc_id"), "fp").select("doc_id").distinct(),
                                   words), "sets")
    star = scratch.save(_confirm(star_pairs, sets, percent), "star")
    first = scratch.save(components(star, scratch, "first"), "first")

    held = lists.join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "c", "fp", F.coalesce("component", "fp").alias("part"))
    mixed = held.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("fp").alias("center"),
                                    F.count("*").alias("n")).filter("lo <> hi and n > 2").select("key", "center", "n")
    left = scratch.save(held.join(mixed, "key"), "left")

    short = left.filter(F.col("n") <= SHORT).filter("fp <> center")
    pairs = scratch.save(matching(
        short.alias("l").join(short.alias("r"), F.expr("l.key = r.key and l.part < r.part"))
        .select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b")).distinct()), "pairs")
    rest = scratch.save(_confirm(pairs, sets, percent), "rest")

    posted = lists.groupBy("fp").agg(F.sum(F.expr("shiftleft(1L, c)")).alias("posted"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    long_lists = (left.filter(F.col("n") > SHORT).withColumn("blocks", blocks).withColumn("own", own)
                  .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .select("key", "c", "fp", "part", "own", F.least("own", "other").alias("i"),
                          F.greatest("own", "other").alias("j")))
    more = scratch.save(_block_links(
        long_lists.join(posted, "fp").join(classes.select("fp", "sig"), "fp").join(sets, "fp"), floor, percent), "more")

    whole = components(star.union(rest).union(more), scratch, "whole")
    part = classes.select("fp", "doc_id").join(whole.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "doc_id", F.coalesce("component", "fp").alias("part"))
    low = part.groupBy("part").agg(F.min(F.struct("doc_id", "fp")).alias("low"))
    named = part.join(low, "part").select("fp", "low")
    out = scratch.save(rows.select("doc_id", "n_shingles", "fp").join(named, "fp", "left").select(
        "doc_id", "fp", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("low.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.struct("doc_id", "fp") == F.col("low")).otherwise(F.lit(True))
        .alias("chosen")), "out")
    scratch.drop("rows", "classes", "lists", "star_pairs", "sets", "star", "first", "left", "pairs", "rest", "more")
    return out


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, in all their columns, that represent their component:
    one row per component, and one of repeated rows without words.  Rows without
    an id are kept as they are."""
    found = grouped(docs, words, percent)
    chosen = found.filter("chosen").select("doc_id", "fp").distinct()
    often = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    own = docs["doc_id"].cast("long")
    once = chosen.join(often.filter("n = 1"), "doc_id").select(F.col("doc_id").alias("_one"))
    several = often.filter("n > 1").select(F.col("doc_id").alias("_some"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for t in run_over(whole):
                sets = [s for _, _, w in text_words(t.column("text")) for s in w.shingles(words)]
                yield t.append_column("_set", pa.array([fingerprint(s) for s in sets], pa.binary()))

    # ids that several rows bear: the row is told by its set as well
    shared = docs.join(several, own == several["_some"], "left_semi")
    shared = shared.mapInArrow(mark, StructType([*docs.schema.fields, StructField("_set", BinaryType())]))
    shared = shared.join(chosen.select(F.col("doc_id").alias("_some"), F.col("fp").alias("_fp")),
                         (shared["doc_id"].cast("long") == F.col("_some")) & (F.col("_set") == F.col("_fp")), "left_semi")
    return (docs.join(once, own == once["_one"], "left_semi")
            .unionByName(shared.dropDuplicates(["doc_id", "_set"]).drop("_set"))
            .unionByName(docs.filter("doc_id is null")))
