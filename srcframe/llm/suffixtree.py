"""Probabilistic suffix tree over the symbols of a text, and word-count base.

A text's tokens are its lower-cased words and one end.  The tree spells them:
each word's bytes, a space between words, an end symbol last (a bijection, so the
probability of the spelling is that of the token sequence).  Counting covers
every training text:

* occurrences of each symbol after its last ``DEPTH`` symbols are counted per
  task (sorted windows), added up by Spark, and summed for shorter contexts;
* every counted (context, symbol) entry takes part, however rare.  Orders up to
  ``SHARED`` are bounded by the alphabet and made in the driver; longer ones are made
  by executors, all contexts with the same ``SHARED + 1`` nearest symbols at once;
* a context is retained if its next-symbol distribution diverges from that of
  its suffix: count * KL >= ``CUTOFF`` nats, or if a longer retained context
  needs it as a suffix;
* distributions are smoothed by mixing with the suffix's, weighted by the number
  of different next symbols (``BACK`` for each), down to a smoothed root, so each
  sums to one;
* a symbol is scored by the longest retained suffix state of its history.  A tree of
  more than ``PART`` entries is cut by nearest symbols, and the texts are passed over
  once for each part, which scores the symbols whose history lies in it.

Word counts (by 64-bit hash of the whole word) are exact: words of probability
2**-HEAVY_BITS and more are looked up in a table of at most 2**HEAVY_BITS rows,
all others by a join.

Rules: null or empty text is the end token alone.  Rows without ``doc_id`` are
held out (scored, never learned from).  Repeated rows are scored each and count
each.  With nothing to learn from, the root is uniform and the base is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.llm.text import _LOWER, Words, mix, run_over, text_words
from srcframe.session import Scratch

DEPTH = 5
SHARED = 2          # orders the driver makes: at most 256**3 entries at any size
PART = 1 << 21      # entries of long contexts that are broadcast at once
HEAVY_BITS = 18
CUTOFF = 25.0
BACK = 4.0          # weight of the suffix for each different next symbol
END, GAP = 10, 32
END_HASH = int(mix(np.array([0x656E64], np.uint64)).view(np.int64)[0])
MERGE_AT = 1 << 20   # entries a task gathers before it adds them up
FLUSH_AT = 1 << 21   # distinct entries a task holds before it hands them on


def spell(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, and where each row starts."""
    none = np.flatnonzero(np.diff(w.bounds) == 0)
    size = np.insert(w.end - w.start, w.bounds[none], 0) + 1
    first = np.insert(w.start, w.bounds[none], 0)
    stop = np.cumsum(size)
    per_row = np.maximum(np.diff(w.bounds), 1)
    last = np.cumsum(per_row) - 1
    low = np.append(_LOWER[w.data], np.uint8(0))
    sym = low[np.arange(stop[-1]) - np.repeat(stop - size - first, size)]
    sym[stop - 1] = GAP
    sym[stop[last] - 1] = END
    return sym, np.concatenate([[0], stop[last[:-1]]])


def windows(sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per symbol: its DEPTH predecessors (nearest in the highest byte; END
    before the start of a text) and, in the lowest byte, the symbol."""
    key = sym.astype(np.uint64)
    end = np.append(at[1:], len(sym))
    for j in range(1, DEPTH + 1):
        p = np.full(len(sym), END, np.uint8)
        p[j:] = sym[:-j] if j < len(sym) else 0
        for i in range(j):
            x = at + i
            p[x[x < end]] = END
        key |= p.astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - j))
    return key


def context_mask(k: int) -> int:
    """Bits of a window that hold the k nearest predecessors."""
    return ((1 << (8 * k)) - 1) << (8 * (DEPTH + 1 - k))


def _add_up(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts (or sums of n)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if n is None:
        return keys[cut], np.diff(np.append(cut, len(keys)))
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


class _Tally:
    """Counts of 64-bit keys of one task, in bounded memory: ``add`` hands back
    a part when too much has gathered."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(_add_up(keys))

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_add_up(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def full(self) -> bool:
        if sum(len(k) for k, _ in self.parts[1:]) > MERGE_AT:
            self.merge()
        return len(self.parts) == 1 and len(self.parts[0][0]) > FLUSH_AT


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over the whole texts: kind 0 words, kind 1 windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = (_Tally(), _Tally())

        def flush(kind):
            k, n = tally[kind].merge()
            tally[kind].parts = []
            for a in range(0, len(k), 1 << 18):
                part = k[a:a + (1 << 18)].view(np.int64)
                yield pa.record_batch({"kind": pa.array(np.full(len(part), kind, np.int8)), "key": pa.array(part),
                                       "n": pa.array(n[a:a + (1 << 18)].astype(np.int64))})

        for whole in batches:
            for t in run_over(whole, 1 << 21):
                found, spelled = [], []
                for _, _, w in text_words(t.column("text")):
                    found.append(w.hash)
                    spelled.append(windows(*spell(w)))
                found.append(np.full(t.num_rows, END_HASH, np.int64).view(np.uint64))
                tally[0].add(np.concatenate(found))
                tally[1].add(np.concatenate(spelled))
                for kind in (0, 1):
                    if tally[kind].full():
                        yield from flush(kind)
        for kind in (0, 1):
            yield from flush(kind)

    return docs.select("text").mapInArrow(run, "kind byte, key long, n long") \
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))


def levels(key: np.ndarray, n: np.ndarray, orders) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, n) of each order, summed from the sorted keys of a longer one."""
    out = []
    for k in sorted(orders, reverse=True):
        key, n = _add_up(key & np.uint64(context_mask(k) | 255), n)
        out.append((key, n))
    return out[::-1]


class Level:
    """All contexts of one order with their next-symbol distributions."""

    def __init__(self, key: np.ndarray, n: np.ndarray, k: int, up: np.ndarray, cutoff: float):
        own = key & np.uint64(context_mask(k))
        new = np.append(True, own[1:] != own[:-1])[:len(own)]  # keys are sorted by context
        self.k, self.key, self.own, self.context = k, key, own, own[new]
        inv = np.cumsum(new) - 1
        m = len(self.context)
        total, kinds = np.bincount(inv, n, m), BACK * np.bincount(inv, minlength=m)
        self.dist = (n + kinds[inv] * up) / (total + kinds)[inv]
        self.escape = np.log(kinds / (total + kinds))
        self.keep = np.bincount(inv, n * np.log(n / total[inv] / up), m) >= cutoff

    def below(self, key: np.ndarray) -> np.ndarray:
        """P(symbol | context of this order) of counted windows."""
        return self.dist[np.searchsorted(self.key, key & np.uint64(context_mask(self.k) | 255))]

    def need(self, suffixes: np.ndarray) -> None:
        self.keep |= np.isin(self.context, suffixes)

    def suffixes(self) -> np.ndarray:
        """Suffixes of the retained contexts."""
        return np.unique(self.context[self.keep] & np.uint64(context_mask(self.k - 1)))

    def retained(self):
        """Keys and ln P of entries, keys and ln of escapes, tagged with the order."""
        tag, on = np.uint64(self.k << 48), np.isin(self.own, self.context[self.keep])
        return (self.key[on] | tag, np.log(self.dist[on]).astype(np.float32),
                self.context[self.keep] | tag, self.escape[self.keep].astype(np.float32))


def grow(below, made: list[tuple[np.ndarray, np.ndarray]], first: int, cutoff: float) -> list[Level]:
    """Levels of the orders from ``first`` on; ``below(key)`` is the order before.
    Suffixes of retained contexts are retained within these levels."""
    out: list[Level] = []
    for k, (key, n) in enumerate(made, first):
        out.append(Level(key, n, k, below(key), cutoff))
        below = out[-1].below
    for low, high in zip(out[-2::-1], out[:0:-1]):
        low.need(high.suffixes())
    return out


class Tree:
    """Retained contexts with smoothed next-symbol distributions.

    ``entries``: key (order, context, symbol) -> ln P; ``contexts``: key (order,
    context) -> ln of the weight left to the suffix's distribution."""

    def __init__(self, root: np.ndarray, entries, value, contexts, escape):
        self.root = root
        i, j = np.argsort(entries), np.argsort(contexts)
        self.entries, self.value, self.contexts, self.escape = entries[i], value[i], contexts[j], escape[j]

    def with_part(self, part: "Tree | None") -> "Tree":
        """Short contexts of this tree and the long ones of a part."""
        if part is None:
            return self
        return Tree(self.root, *(np.concatenate([getattr(self, x), getattr(part, x)])
                                 for x in ("entries", "value", "contexts", "escape")))

    def index(self):
        if not hasattr(self, "_index"):
            self._index = (pd.Index(self.entries), pd.Index(self.contexts))
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def within(self, key: np.ndarray, first: int, last: int) -> np.ndarray:
        """``log_probabilities`` of the windows in a range of groups, 0 for others."""
        g, out = group_of(key), np.zeros(len(key))
        on = (g >= np.uint64(first)) & (g <= np.uint64(last))
        out[on] = self.log_probabilities(key[on])
        return out

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """ln P of each window's symbol given its longest retained context."""
        entries, contexts = self.index()
        out = np.zeros(len(key))
        todo = np.arange(len(key))
        for k in range(DEPTH, 0, -1):
            tag = np.uint64(k << 48)
            here = key[todo]
            i = entries.get_indexer((here & np.uint64(context_mask(k) | 255)) | tag)
            hit = i >= 0
            out[todo[hit]] += self.value[i[hit]]
            todo, here = todo[~hit], here[~hit]
            j = contexts.get_indexer((here & np.uint64(context_mask(k))) | tag)
            known = j >= 0
            out[todo[known]] += self.escape[j[known]]
        out[todo] += self.root[(key[todo] & np.uint64(255)).astype(np.int64)]
        return out


def group_of(key):
    """The ``SHARED + 1`` nearest symbols of a window (array or column)."""
    bits = 8 * (DEPTH - SHARED)
    return F.shiftright(key, bits) if not isinstance(key, np.ndarray) else key >> np.uint64(bits)


class Model:
    """A tree in parts: ``low`` has the short contexts, the table ``high`` (g, entry,
    key, value) the long ones by group of their nearest symbols, and ``borders``
    the last group of each part."""

    def __init__(self, low: Tree, high: DataFrame, borders: list[int]):
        self.low, self.high, self.borders = low, high, borders

    @property
    def contexts(self) -> np.ndarray:
        return np.unique(np.concatenate([t.contexts for _, _, t in self.trees()]))

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        return sum(t.within(key, first, last) for first, last, t in self.trees())

    def trees(self) -> Iterator[tuple[int, int, Tree]]:
        """(first group, last group, tree), one part in memory at a time."""
        first = 0
        for last in self.borders:
            t = self.high.filter(F.col("g").between(first, last)).select("entry", "key", "value").toArrow().to_pandas()
            on, key, value = t["entry"].to_numpy(bool), t["key"].to_numpy().astype(np.uint64), t["value"].to_numpy(np.float32)
            yield first, last, self.low.with_part(Tree(self.low.root, key[on], value[on], key[~on], value[~on]))
            first = last + 1


def fit(counted: DataFrame, cutoff: float = CUTOFF, part: int = PART) -> Model:
    """Model from ``counts``: all counted windows take part."""
    spark = counted.sparkSession
    scratch = Scratch(spark, "lmtree")
    wins = counted.filter("kind = 1").select("key", "n")
    short = wins.groupBy(F.col("key").bitwiseAND(F.lit(context_mask(SHARED) | 255)).alias("key")) \
        .agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values("key")  # bounded by the alphabet
    made = levels(short["key"].to_numpy().astype(np.uint64), short["n"].to_numpy().astype(np.float64), range(SHARED + 1))
    del short
    root = np.full(256, 0.5)
    root[made[0][0].astype(np.int64)] += made[0][1]
    root /= root.sum()
    low = grow(lambda key: root[(key & np.uint64(255)).astype(np.int64)], made[1:], 1, cutoff)
    top = spark.sparkContext.broadcast((low[-1].k, low[-1].key, low[-1].dist))
    schema = pa.schema([("g", pa.int64()), ("entry", pa.bool_()), ("key", pa.int64()), ("value", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Level.__new__(Level)
        last.k, last.key, last.dist = top.value

        def made_of(key, n):  # whole groups, sorted
            for level in grow(last.below, levels(key, n, range(SHARED + 1, DEPTH + 1)), SHARED + 1, cutoff):
                e, v, c, w = level.retained()
                keys, each = np.concatenate([e, c]), np.concatenate([v, w])
                g = group_of(keys & np.uint64((1 << 48) - 1)).astype(np.int64)
                for a in range(0, len(keys), 1 << 16):
                    z = slice(a, a + (1 << 16))
                    yield pa.record_batch([pa.array(g[z]), pa.array(np.arange(len(keys))[z] < len(e)),
                                           pa.array(keys[z].astype(np.int64)), pa.array(each[z])], schema=schema)

        kept, size = [], 0
        for t in batches:
            key = t.column("key").to_numpy().astype(np.uint64)
            n = t.column("n").to_numpy().astype(np.float64)
            if not len(key):
                continue
            kept.append((key, n))
            size += len(key)
            if size > 1 << 18:
                key, n = (np.concatenate(x) for x in zip(*kept, strict=True))
                cut = int(np.searchsorted(group_of(key), group_of(key[-1:])[0]))  # the last group may go on
                if cut:
                    yield from made_of(key[:cut], n[:cut])
                kept, size = [(key[cut:], n[cut:])], 0
        if kept:
            yield from made_of(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    high = scratch.save(wins.repartition(parts, group_of(F.col("key"))).sortWithinPartitions("key")
                        .mapInArrow(run, "g long, entry boolean, key long, value float"), "tree")
    longest = high.filter(~F.col("entry") & (F.shiftright("key", 48) == SHARED + 1)).select("g").distinct().toArrow().to_pandas()
    low[-1].need(np.unique(longest["g"].to_numpy().astype(np.uint64) >> np.uint64(8)) << np.uint64(8 * (DEPTH + 1 - SHARED)))
    for down, up in zip(low[-2::-1], low[:0:-1]):
        down.need(up.suffixes())
    sizes = high.groupBy("g").agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values("g")  # bounded by the alphabet
    borders, held = [], 0
    for g, n in zip(sizes["g"].tolist(), sizes["n"].tolist(), strict=True):
        if held and held + n > part:
            borders.append(g - 1)
            held = 0
        held += n
    borders.append((1 << 8 * (SHARED + 1)) - 1)
    kept = [np.concatenate(x) for x in zip(*(level.retained() for level in low), strict=True)]
    return Model(Tree(np.log(root), *kept), high, borders)


class _Counts:
    """Counts of the frequent words."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, scale: float):
        self.index, self.weight = pd.Index(keys.astype(np.int64)), np.log10((n + 0.1) / scale)

    def __getstate__(self):
        return np.asarray(self.index), self.weight

    def __setstate__(self, state):
        self.index, self.weight = pd.Index(state[0]), state[1]


def score(docs: DataFrame, counted: DataFrame, model: Model, heavy_bits: int = HEAVY_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    words = counted.filter("kind = 0").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = n + 0.1 * (v + 1)
    common = words.filter(F.col("n") * F.lit(float(2**heavy_bits)) >= float(n)).toArrow().to_pandas()
    ends = words.filter(F.col("key") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    end_base = math.log10((ends + 0.1) / scale)
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    if len(model.borders) > 1:  # every pass has to see the same row numbers
        docs = Scratch(spark, "lmtexts").save(docs, "texts")
    words_bc = spark.sparkContext.broadcast(_Counts(common["key"].to_numpy(), common["n"].to_numpy(), scale))
    passes = [(first, last, spark.sparkContext.broadcast(tree)) for first, last, tree in model.trees()]
    first, last, tree = passes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = words_bc.value
        for whole in batches:
            for t in run_over(whole):
                for i, j, w in text_words(t.column("text")):
                    sym, at = spell(w)
                    total = np.add.reduceat(tree.value.within(windows(sym, at), first, last), at) / math.log(10)
                    h = w.hash.view(np.int64)
                    per_row = w.counts()
                    row = np.repeat(np.arange(j - i), per_row)
                    k = frequent.index.get_indexer(h)
                    hit = k >= 0
                    base = np.bincount(row[hit], frequent.weight[k[hit]], j - i)
                    known = np.bincount(row[hit], minlength=j - i)
                    rr, rh = row[~hit], h[~hit]
                    order = np.lexsort((rh, rr))
                    rr, rh = rr[order], rh[order]
                    cut = np.flatnonzero(np.concatenate([[True], (rr[1:] != rr[:-1]) | (rh[1:] != rh[:-1])])) \
                        if len(rr) else np.zeros(0, np.int64)
                    tf = np.diff(np.append(cut, len(rr)))
                    ids = t.column("rid").slice(i, j - i).to_numpy()
                    m = len(cut)

                    def col(doc, rare, kind):
                        return pa.concat_arrays([doc.cast(kind), rare if rare is not None else pa.nulls(m, kind)])

                    one = j - i
                    yield pa.record_batch({
                        "rid": pa.array(np.concatenate([ids, ids[rr[cut]]])),
                        "key": pa.array(np.concatenate([mix(ids.astype(np.uint64)).view(np.int64), rh[cut]])),
                        "tf": pa.array(np.concatenate([np.zeros(one, np.int64), tf])),
                        "doc_id": col(t.column("doc_id").slice(i, one), None, pa.int64()),
                        "held_out": col(t.column("held_out").slice(i, one), None, pa.bool_()),
                        "n_tokens": col(pa.array(per_row + 1), None, pa.int64()),
                        "n_known": col(pa.array(known + (ends > 0)), None, pa.int64()),
                        "base": col(pa.array(base + end_base), None, pa.float64()),
                        "score": col(pa.array(total), None, pa.float64())})

    def more(first, last, tree):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for t in run_over(whole):
                    for i, j, w in text_words(t.column("text")):
                        sym, at = spell(w)
                        total = np.add.reduceat(tree.value.within(windows(sym, at), first, last), at) / math.log(10)
                        yield pa.record_batch({"rid": t.column("rid").slice(i, j - i), "score": pa.array(total)})
        return run

    rows = docs.mapInArrow(
        run, "rid long, key long, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
             "score double")
    rare = words.filter(F.col("n") * F.lit(float(2**heavy_bits)) < float(n))
    weight = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(scale))
    each = (rows.join(rare, "key", "left")
            .select("rid", "doc_id", "held_out", "n_tokens", "score",
                    (F.coalesce("n_known", F.lit(0)) + F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("known"),
                    (F.coalesce("base", F.lit(0.0)) + F.when(F.col("tf") > 0, F.col("tf") * weight).otherwise(0.0))
                    .alias("base")))
    for p in passes[1:]:
        each = each.unionByName(docs.select("rid", "text").mapInArrow(more(*p), "rid long, score double"),
                                allowMissingColumns=True)
    return (each.groupBy("rid").agg(
                F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
                F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
                F.sum("base").alias("base_score"), F.sum("score").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score",
                    "score"))


def language_model_scores(docs: DataFrame, held_mod: int = 10) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod ``held_mod`` is not 0 and
    score all of ``docs(doc_id, text)``."""
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % held_mod == 0, F.lit(True)).alias("held_out"))
    counted = scratch.save(counts(rows.filter("not held_out")), "counts")
    return score(rows, counted, fit(counted))
