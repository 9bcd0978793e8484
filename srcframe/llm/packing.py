"""Bounded-space online packing of tokenised documents into windows.

Each partition keeps ``OPEN`` windows of ``SIZE`` tokens.  A document's tokens
come in reading order: whole windows first, the rest goes to the open window
where it fits best (least room left).  If it fits nowhere it fills the fullest
window up, which is emitted, and what remains is placed anew.  At the end of a
partition the open windows are merged into full ones; the one that stays is left
over and, with those of other partitions, is packed best-fit as it is (uncut)
into shared windows.  Only piece descriptions (id, start, length, checksum) are
shuffled, never tokens.

Token ids are those of the tokenizer on the whole text.  Its rules split at white
space and drop it, so a text is the sequence of its words: the ids of a word are
looked up in a bounded cache, and new words are encoded in batches.  Between
tasks a Python worker holds 65,536 words (some 16 MB).

Rules: null text is empty: only the end id.  Repeated rows are packed each; rows
without id have a null doc_id.  Empty table: no piece.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcframe.llm.text import run_over

SIZE = 4096
OPEN = 64
END_ID = 2
CACHE_WORDS = 1 << 19
KEPT_WORDS = 1 << 16  # that a Python worker holds between tasks
GROUP = 64  # partitions whose leftovers are packed together

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "over long")


class WordTokens:
    """Ids of a text as bytes of unsigned 32-bit numbers, word by word.

    The cache has two generations of ``limit`` words: when the young one is full
    it becomes the old one, and words met again move over.  A new word of ASCII
    and Latin-1 letters is cut where the tokenizer's own rule cuts it (letters,
    single digits, other signs, short endings); its pieces are encoded many at a
    time, without the rules, which such a piece passes unchanged but for its
    case.  A piece ends at the token that ends a word.  Other words take the
    whole tokenizer, and so do texts that spell one of its added tokens."""

    # The letters of Latin-1 in UTF-8, and the tokenizer's rule on them.
    LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
    PLAIN = re.compile(rb"(?:[\x00-\x7f]|" + LATIN + rb")*")
    PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|" + LATIN + rb")+|[0-9]|[^a-z0-9\xc3\x80-\xbf]+")

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> None:
        """Words by the whole tokenizer."""
        for a in range(0, len(words), 4096):
            part = words[a:a + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False),
                            strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _encode_pieces(self, pieces: list[bytes]) -> None:
        for a in range(0, len(pieces), 256):
            part = pieces[a:a + 256]
            ids = np.array(self.bare.encode(b" ".join(part).decode().lower(), add_special_tokens=False).ids, "<u4")
            to = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(to) != len(part):
                raise ValueError("a piece of a word is not one piece to the tokenizer")
            raw, at = ids.tobytes(), 0
            for p, z in zip(part, to.tolist(), strict=True):
                self.known[p] = raw[at:z]
                at = z

    def _learn(self, words: set[bytes]) -> None:
        """Make all of ``words`` known."""
        known, old, plain, find = self.known, self.old, self.PLAIN.fullmatch, self.PIECE.findall
        cut, whole, pieces = {}, [], set()
        for w in words:
            if w in old:
                known[w] = old[w]
            elif w.isalpha():
                pieces.add(w)
            elif plain(w):
                cut[w] = find(w)
                pieces.update(cut[w])
            else:
                whole.append(w)
        self._encode(sorted(whole))
        self._encode_pieces(sorted(p for p in pieces if p not in known and p not in old))
        for w, parts in cut.items():
            known[w] = b"".join([known.get(x) or old[x] for x in parts])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        end = np.array([END_ID], "<u4").tobytes()
        split = [t.lower() if t else b"" for t in texts]
        spelled = {i for i, t in enumerate(split) if any(x in t for x in self.added)}
        split = [t.split() if i not in spelled else [] for i, t in enumerate(split)]
        words = set().union(*split)
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known, self.old = {}, self.known
            new = words
        if new:
            self._learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, x)) + end for x in split]
        for i in spelled:
            ids = self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids
            out[i] = np.array(ids, "<u4").tobytes() + end
        return out

    def rest(self) -> None:
        """Between tasks only the first ``KEPT_WORDS`` learnt stay, most of them frequent."""
        self.known, self.old = dict(islice(self.known.items(), KEPT_WORDS)), {}


_TOKENS: dict[str, WordTokens] = {}  # of this Python worker, for all its tasks


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


class Packer:
    """Open windows of one partition; pieces are (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.open_windows = size, open_windows
        self.fill: list[tuple[int, int]] = []  # (used, window), sorted
        self.windows: dict[int, list] = {}
        self.next, self.out = 0, []

    def _emit(self, pieces: list) -> None:
        self.out.append(pieces)

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self._emit([(doc, at, ids[4 * at:4 * (at + self.size)], total)])
            at += self.size
        self._place(doc, at, ids[4 * at:], total)

    def _place(self, doc, at: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // 4
            k = bisect_right(self.fill, (self.size - n, 1 << 62)) - 1  # fullest window with room for it
            if k >= 0:
                used, w = self.fill.pop(k)
                piece, ids = ids, b""
            elif len(self.fill) < self.open_windows:
                used, w, piece, ids = 0, self.next, ids, b""
                self.next += 1
                self.windows[w] = []
            else:
                used, w = self.fill.pop()
                room = 4 * (self.size - used)
                piece, ids = ids[:room], ids[room:]
            self.windows[w].append((doc, at, piece, total))
            at += len(piece) // 4
            if used + len(piece) // 4 == self.size:
                self._emit(self.windows.pop(w))
            else:
                insort(self.fill, (used + len(piece) // 4, w))

    def close(self) -> list | None:
        """Merge the open windows into full ones; the rest, if any, is returned."""
        left = [p for _, w in self.fill for p in self.windows[w]]
        self.fill, self.windows, self.open_windows = [], {}, 1
        for doc, at, ids, total in left:
            self._place(doc, at, ids, total)
        return self.windows.popitem()[1] if self.windows else None


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, open_windows: int = OPEN) -> DataFrame:
    """Pieces of the documents ``docs(doc_id, text)`` in windows of ``size`` tokens:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        tokens, packer, number = word_tokens(tokenizer_path), Packer(size, open_windows), pid << 40

        def rows(windows: list, over: bool) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in range(8)]
            for pieces in windows:
                offset = 0
                for doc, at, ids, total in pieces:
                    for c, x in zip(cols, (doc, at, len(ids) // 4, zlib.crc32(ids), total, number, offset,
                                           pid // GROUP if over else None), strict=True):
                        c.append(x)
                    offset += len(ids) // 4
                number += 1
            names = SCHEMA.replace(" long", "").split(", ")
            return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

        for whole in batches:
            for t in run_over(whole, 1 << 20):
                encoded = tokens.encode(t.column("text").cast(pa.large_binary()).to_pylist())
                for doc, ids in zip(t.column("doc_id").to_pylist(), encoded, strict=True):
                    packer.add(doc, ids)
                if len(packer.out) > 256:
                    yield rows(packer.out, False)
                    packer.out = []
        tokens.rest()
        left = packer.close()
        yield rows(packer.out, False)
        if left:
            yield rows([left], True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict[int, list] = {}
        for t in batches:
            free = t.column("over").is_null()
            yield t.filter(free).drop_columns(["over"])
            for r in t.filter(pc.invert(free)).to_pylist():
                over.setdefault(r["over"], []).append(r)
        for rows in over.values():  # at most GROUP windows each
            items: dict[int, list] = {}
            for r in rows:
                items.setdefault(r["sequence_id"], []).append(r)
            fill: list[tuple[int, int]] = []
            for number, pieces in sorted(items.items(), key=lambda x: (-sum(r["length"] for r in x[1]), x[0])):
                n = sum(r["length"] for r in pieces)
                k = bisect_right(fill, (size - n, 1 << 62)) - 1
                used, into = fill.pop(k) if k >= 0 else (0, number)
                for r in sorted(pieces, key=lambda r: r["offset"]):
                    r["offset"] += used
                    r["sequence_id"] = into
                insort(fill, (used + n, into))
            names = SCHEMA.replace(" long", "").split(", ")[:-1]
            yield pa.record_batch({n: pa.array([r[n] for r in rows], pa.int64()) for n in names})

    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)
    # leftovers of a group of partitions meet; full windows spread over all
    return pieces.repartition(int(parts), F.coalesce("over", -1 - F.col("sequence_id"))) \
        .mapInArrow(merge, SCHEMA.removesuffix(", over long"))
