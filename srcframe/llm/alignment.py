"""Alignment of two tokenizers over a corpus.

Equal texts are one: texts are grouped by their full value with the number of rows
that bear it, each is tokenised and aligned once, its pair counts weigh as often as
it occurs, and the measures are joined back to the rows by the text's digest.

Both tokenizers see a space and the text.  Byte offsets where tokens of both end cut
them into groups; within a group every token of the one is linked with every token
of the other.  The count of an id pair is the number of rows that hold it linked.

Neither tokenizer joins what stands on both sides of a single space between other
characters (``Aligner`` makes sure of that), so a text is the sequence of its words,
and a word is aligned when it is first met.  Words are kept in a bounded table that
lives as long as the task.

A task hands on its texts in batches of about ``BATCH_BYTES``, taken in slices of
about ``SLICE_BYTES``, of which only the distinct pairs of each text stay: one row with the
distinct id pairs of the batch, their weights, and for every text the numbers and
occurrences of its pairs.  The counts of the corpus are a plain aggregate over the
exploded pairs; a batch gets those of its own pairs back by a join, so the table of
all pairs is neither broadcast nor collected.

Rules: null and empty text, and text whose tokens of either side do not spell the
space and the text: no tokens, all measures zero, the groups' digest empty.  Rows
keep their doc_id, null or repeated.  Extra columns are not read.  Empty table:
empty result.  Special tokens' strings in a text are plain text.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.llm.text import run_over
from srcframe.session import Scratch

BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20  # text of a batch whose words are held at once
KEEP_WORDS = 1 << 17
KEEP_BYTES = 48 << 20
LEARN = 1 << 14  # words aligned at once
TOGETHER = 16  # words encoded in one call of a tokenizer
LINKS = 1 << 16  # links of a group that are written out
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")

BATCH_SCHEMA = ("batch long, digest array<binary>, " + ", ".join(f"{m} array<long>" for m in MEASURES)
                + ", groups array<string>, starts array<long>, pairs array<long>, weights array<long>, "
                "number binary, times binary")
RESULT_SCHEMA = ("digest binary, " + ", ".join(f"{m} long" for m in MEASURES)
                 + ", n_best long, count_sum long, groups_sha256 string")


def _byte_of() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for
    itself, the other bytes are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(other)}


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, sum(map(len, ids)))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


class Aligner:
    """Words (each led by a space that is not written) and what their tokens make."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        byte_of = _byte_of()
        self.a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                        for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b_bytes = []
        self.width = self.b.get_piece_size()
        for i in range(self.width):
            p = self.b.id_to_piece(i)
            if "▁" in p.lstrip("▁"):
                raise ValueError(f"piece {p!r} reaches over a space, so words are not independent")
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        self.a_len = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, x in self.a_bytes.items():
            self.a_len[i] = len(x)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.signed = [f"{i}{sign}" for i in range(max(len(self.a_len), self.width)) for sign in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.measures = np.zeros((0, 4), np.int64)  # n_a -1: bytes differ
        self.groups: list[str] = []
        self.pairs = self.times = np.zeros(0, np.int64)  # of all words, one after the other
        self.offset = np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int64)  # slices that a word was met in
        self.size = 0

    def shrink(self) -> None:
        """Words of one slice only go; all, if the others are many."""
        keep = np.flatnonzero(self.seen > 1)
        count = np.diff(self.offset)[keep]
        groups = [self.groups[i] for i in keep.tolist()]
        place = np.full(len(self.seen), -1)
        place[keep] = np.arange(len(keep))
        place = place.tolist()
        number = {w: place[i] for w, i in self.number.items() if place[i] >= 0}
        size = sum(map(len, number)) + 200 * len(number) + sum(map(len, groups)) + 16 * int(count.sum())
        measures, at = self.measures[keep], _ranges(self.offset[keep], count)
        pairs, times = self.pairs[at], self.times[at]
        self.forget()
        if len(keep) <= KEEP_WORDS // 2 and size <= KEEP_BYTES // 2:
            self.number, self.measures, self.groups, self.pairs, self.times = number, measures, groups, pairs, times
            self.offset, self.size = np.concatenate([[0], np.cumsum(count)]), size
            self.seen = np.ones(len(keep), np.int64)

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, and whether those of both spell a space and the text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        return a, b, [b"".join([self.a_bytes[i] for i in x]) == s and b"".join([self.b_bytes[i] for i in y]) == s
                      for x, y, s in zip(a, b, (b" " + t.encode() for t in texts), strict=True)]

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), LEARN):
            part = words[at:at + LEARN]
            # words without white space at their ends are encoded several at a time
            plain, alone = [], []
            for w in part:
                (plain if w and w == w.strip() else alone).append(w)
            alone += self._learn_runs([plain[k:k + TOGETHER] for k in range(0, len(plain), TOGETHER)])
            a, b, right = self._encoded(alone)
            good = [k for k, r in enumerate(right) if r]
            wrong = [k for k, r in enumerate(right) if not r]
            self._add([alone[k] for k in good], _flat([a[k] for k in good]), _flat([b[k] for k in good]),
                      np.array([len(a[k]) for k in good], np.int64), np.array([len(b[k]) for k in good], np.int64))
            first = len(self.measures)
            self.number.update((alone[k], first + n) for n, k in enumerate(wrong))
            self.measures = np.concatenate([self.measures, np.tile([-1, 0, 0, 0], (len(wrong), 1))])
            self.groups += [""] * len(wrong)
            self.offset = np.concatenate([self.offset, np.full(len(wrong), self.offset[-1])])
            self.size += sum(map(len, part)) + 200 * len(part)

    def _learn_runs(self, runs: list[list[str]]) -> list[str]:
        """Words of the runs are learned where both sides spell the whole run and end a
        token at each word's end; the words of other runs come back."""
        a, b, right = self._encoded([" ".join(r) for r in runs])
        while True:
            kept = [k for k, r in enumerate(right) if r]
            x, y = _flat([a[k] for k in kept]), _flat([b[k] for k in kept])
            words = [w for k in kept for w in runs[k]]
            end = np.cumsum([1 + len(w.encode()) for w in words], dtype=np.int64)
            x_end, y_end = np.cumsum(self.a_len[x]), np.cumsum(self.b_len[y])
            x_at, y_at = np.searchsorted(x_end, end), np.searchsorted(y_end, end)
            over = (x_end[x_at] != end) | (y_end[y_at] != end)
            if not over.any():
                break
            run = np.repeat(kept, [len(runs[k]) for k in kept])
            for k in run[over].tolist():
                right[k] = False
        self._add(words, x, y, np.diff(x_at, prepend=-1), np.diff(y_at, prepend=-1))
        return [w for k, r in enumerate(right) if not r for w in runs[k]]

    def _add(self, words: list[str], x: np.ndarray, y: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Align all the words at once: laid end to end, every word's end is a cut.
        ``x``, ``y``: ids of either side, of which a word has ``n_a`` and ``n_b``."""
        first = len(self.measures)
        self.number.update((w, first + k) for k, w in enumerate(words))
        if not words:
            return
        x_end, y_end = np.cumsum(self.a_len[x]), np.cumsum(self.b_len[y])
        cut = np.intersect1d(x_end, y_end, assume_unique=True)
        x_group, y_group = np.searchsorted(cut, x_end), np.searchsorted(cut, y_end)
        left, right = np.bincount(x_group), np.bincount(y_group)
        x_from, y_from = np.cumsum(left) - left, np.cumsum(right) - right
        word = np.repeat(np.arange(len(words)), n_a)[x_from]  # of a group
        linked = left * right
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        total = np.concatenate([[0], np.cumsum(linked)])
        self.measures = np.concatenate([self.measures, np.stack(
            [n_a, n_b, np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]]], 1)])

        # pairs: of usual groups all links at once, of enormous ones by distinct ids
        usual = np.flatnonzero(linked <= LINKS)
        group = np.repeat(usual, linked[usual])
        r = np.arange(len(group)) - np.repeat(np.cumsum(linked[usual]) - linked[usual], linked[usual])
        pair = x[x_from[group] + r // right[group]] * self.width + y[y_from[group] + r % right[group]]
        keys, times = [word[group] << 40 | pair], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(linked > LINKS).tolist():
            p, m = np.unique(x[x_from[g]:x_from[g] + left[g]], return_counts=True)
            q, n = np.unique(y[y_from[g]:y_from[g] + right[g]], return_counts=True)
            keys.append(word[g] << 40 | (p[:, None] * self.width + q).ravel())
            times.append((m[:, None] * n).ravel())
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, at, np.concatenate(times))
        ends = np.searchsorted(key >> 40, np.arange(1, len(words) + 1))
        self.offset = np.concatenate([self.offset, self.offset[-1] + ends])
        self.pairs = np.concatenate([self.pairs, key & ((1 << 40) - 1)])
        self.times = np.concatenate([self.times, count])

        # text of the groups: ids and the signs behind them in the order of the text
        ids, sign = np.empty(len(x) + len(y), np.int64), np.empty(len(x) + len(y), np.int64)
        x_at = np.arange(len(x)) + y_from[x_group]
        y_at = np.arange(len(y)) + (x_from + left)[y_group]
        ids[x_at], ids[y_at] = x, y
        sign[x_at] = np.append(x_group[1:] != x_group[:-1], True)
        sign[y_at] = np.append(y_group[1:] != y_group[:-1], True) * 2
        signed = list(map(self.signed.__getitem__, (ids * 3 + sign).tolist()))
        stop = np.cumsum(n_a + n_b).tolist()
        text = ["".join(signed[i:j])[:-1] for i, j in zip([0, *stop], stop, strict=False)]
        self.groups += text
        self.size += sum(map(len, text)) + 16 * len(key)

    def batch(self, texts: list[str], copies: np.ndarray) -> dict:
        """Columns of a batch (lists) for its non-empty texts."""
        ends = np.cumsum([len(t) for t in texts])
        turn = (ends - 1) // SLICE_BYTES  # of the slice that a text ends in
        cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(texts)]
        totals, groups, found = [], [], []
        for x, y in itertools.pairwise(cuts):
            total, text, doc, pair, linked = self._slice(texts[x:y])
            totals.append(total)
            groups += text
            found.append((doc + x, pair, linked))
        doc, pair, linked = (np.concatenate(c) for c in zip(*found, strict=True))
        pairs, number = np.unique(pair, return_inverse=True)
        weights = np.bincount(number, weights=copies[doc], minlength=len(pairs)).astype(np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress
        listed = lambda v: pa.array([v], pa.list_(pa.int64()))
        return {**{m: listed(np.concatenate([t[m] for t in totals])) for m in MEASURES}, "groups": [groups],
                "starts": listed(np.searchsorted(doc, np.arange(len(texts) + 1))),
                "pairs": listed(pairs), "weights": listed(weights),
                "number": [pack(number.astype(np.int32).tobytes())], "times": [pack(linked.tobytes())]}

    def _slice(self, texts: list[str]) -> tuple[dict, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Measures and groups' digest of the texts; (text, pair, links), ascending."""
        words = [_BETWEEN.split(" " + t) for t in texts]
        for w in words:
            w[0] = w[0][1:]
        if len(self.measures) > KEEP_WORDS or self.size > KEEP_BYTES:
            self.shrink()
        self.learn(sorted({x for w in words for x in w}.difference(self.number)))
        counts = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(counts.sum()))
        del words
        bounds = np.concatenate([[0], np.cumsum(counts)])
        used, word = np.unique(ids, return_inverse=True)
        self.seen = np.concatenate([self.seen, np.zeros(len(self.measures) - len(self.seen), np.int64)])
        self.seen[used] += 1
        measures = self.measures[used]
        wrong = np.add.reduceat(measures[word, 0] < 0, bounds[:-1]) > 0
        totals = {m: np.where(wrong, 0, np.add.reduceat(measures[word, k], bounds[:-1])) for k, m in enumerate(MEASURES)}
        groups = ["" if bad else hashlib.sha256(";".join([self.groups[i] for i in ids[x:y].tolist()]).encode()).hexdigest()
                  for bad, x, y in zip(wrong.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

        # (text, word) with its occurrences, then (text, pair) with its links
        doc = np.repeat(np.arange(len(texts)), counts)
        right = ~wrong[doc]
        seen, often = np.unique(doc[right] * len(used) + word[right], return_counts=True)
        doc, word = np.divmod(seen, max(len(used), 1))
        none = np.zeros(0, np.int64)
        start = self.offset[used[word]]
        n = self.offset[used[word] + 1] - start
        at = _ranges(start, n)
        pairs, number = np.unique(self.pairs[at], return_inverse=True)
        key = np.repeat(doc, n) * max(len(pairs), 1) + number
        order = np.argsort(key, kind="stable")
        key, linked = key[order], (self.times[at] * np.repeat(often, n))[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else none
        linked = np.add.reduceat(linked, first) if len(key) else none
        doc, number = np.divmod(key[first], max(len(pairs), 1))
        return totals, groups, doc, pairs[number], linked


def _row(schema: pa.Schema, values: dict) -> pa.RecordBatch:
    columns = [values[f.name] for f in schema]
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, f.type)
                            for v, f in zip(columns, schema, strict=True)], schema=schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()),
          "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def aligned_batches(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Batches of ``texts(text, digest, copies)``, distinct and not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, aligner, number = _arrow(BATCH_SCHEMA), None, TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            nonlocal aligner, number
            aligner = aligner or Aligner(byte_path, piece_path)
            t = pa.Table.from_batches(held)
            out = aligner.batch(t.column("text").to_pylist(), t.column("copies").to_numpy())
            number += 1
            return _row(schema, {"batch": [number], "digest": [t.column("digest").to_pylist()], **out})

        for whole in batches:
            for t in run_over(whole, BATCH_BYTES):
                if held and sum(x.nbytes for x in held) + t.nbytes > BATCH_BYTES:
                    yield made()
                    held = []
                held.append(t)
        if held:
            yield made()

    return texts.mapInArrow(run, BATCH_SCHEMA)


def _measured(batch: pa.Table, found: pa.Table) -> pa.Table:
    """Measures of the texts of one batch (a row) with the counts of its pairs."""
    schema = _arrow(RESULT_SCHEMA)
    if not batch.num_rows:
        return schema.empty_table()
    row = batch.to_pylist()[0]
    unpack = zstandard.ZstdDecompressor().decompress
    number, times = np.frombuffer(unpack(row["number"]), np.int32), np.frombuffer(unpack(row["times"]), np.int64)
    count, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
    at = found.column("place").to_numpy()
    count[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy()
    starts = np.array(row["starts"], np.int64)

    def summed(x: np.ndarray) -> list[int]:
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[starts[1:]] - total[starts[:-1]]).astype(np.int64).tolist()

    return pa.table({"digest": row["digest"], **{m: row[m] for m in MEASURES}, "n_best": summed(times * best[number]),
                     "count_sum": summed(times * count[number]), "groups_sha256": row["groups"]}, schema=schema)


def pair_counts(batches: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, count, best): the rows that hold an id pair linked; best is 1
    where no pair of the same first id has a higher count."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")) \
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("count")) \
        .withColumn("a", F.expr(f"pair div {width}")).withColumn("b", F.col("pair") % width)
    most = each.groupBy("a").agg(F.max("count").alias("most"))
    return each.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row
    per row of ``docs(doc_id, text)``.  ``byte_path``: a byte-level tokenizer file,
    ``piece_path``: a sentencepiece model that puts a space before the text."""
    from sentencepiece import SentencePieceProcessor
    width = SentencePieceProcessor(model_file=piece_path).get_piece_size()
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spelled = F.coalesce(F.length("text") > 0, F.lit(False))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    texts = rows.filter(spelled).groupBy("text").agg(F.count("*").alias("copies")).select("text", digest, "copies")
    batches = scratch.save(aligned_batches(texts, byte_path, piece_path), "batches")
    counts = scratch.save(pair_counts(batches, width), "counts")
    places = batches.select(F.col("batch").alias("of"), F.posexplode("pairs").alias("place", "pair")) \
        .join(counts.select("pair", "count", "best"), "pair").select("of", "place", "count", "best")
    measures = scratch.save(
        batches.drop("weights").groupBy("batch").cogroup(places.groupBy("of")).applyInArrow(_measured, RESULT_SCHEMA),
        "measures")
    scratch.drop("batches", "counts")
    zero = [F.lit(0).cast("long").alias(m) for m in [*MEASURES, "n_best", "count_sum"]]
    found = rows.filter(spelled).select("doc_id", digest).join(measures, "digest").drop("digest")
    return found.unionByName(rows.filter(~spelled).select("doc_id", *zero, F.lit("").alias("groups_sha256")))
