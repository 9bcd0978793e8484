"""Breadth-first walks from many entries over one graph, in executors' tasks.

A task holds the graph as targets by source (in a file of its own that the
system pages in and out), two numbers a node, and walks from 64 entries at a
time: an entry is a bit, a level is one ``or`` over the edges of the nodes that
got new bits.  Nothing of a walk is shuffled or written; rows leave as they
are found.
"""

from __future__ import annotations

import io
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17  # edges, entries or names in one row
SLICE = 1 << 20  # edges looked at together
ROWS = 1 << 15   # rows of a batch that leaves
WIDTH = 64       # entries that walk together
EDGES, ENTRIES, NAMES = 0, 1, 2
PACKED = "kind int, first long, last long, n long, data binary, more binary"
FOUND = "repo_id string, entry_fqn string, node string, depth int"


def number_type(nodes: int) -> str:
    """Type of the nodes' numbers in blocks and files."""
    return "i4" if nodes < 1 << 31 else "i8"


def _deltas(x: np.ndarray, number: str) -> bytes:
    """Sorted numbers in few bytes."""
    return pa.compress(np.diff(x.astype(np.int64), prepend=0).astype(number).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: pa.Buffer, n: int, number: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, n * np.dtype(number).itemsize, "zstd"), number), dtype=np.int64)


def packed(kind: int, number: str, *columns: str):
    """For ``mapInArrow``: sorted rows, ``columns[0]`` a number, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = b.slice(at, BLOCK)
                first = x[columns[0]].to_numpy()
                if kind == NAMES:
                    sink = io.BytesIO()
                    table = pa.table({c: x[c].cast(pa.string()) for c in columns[1:]})
                    with pa.ipc.new_stream(sink, table.schema) as out:
                        out.write_table(table)
                    data, more = sink.getvalue(), b""
                else:
                    data, more = _deltas(first, number), b""
                    if kind == EDGES:
                        more = _deltas(x[columns[1]].to_numpy(), number)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([kind], pa.int32()), "first": pa.array([int(first[0])], pa.int64()),
                    "last": pa.array([int(first[-1])], pa.int64()), "n": pa.array([x.num_rows], pa.int64()), "data": pa.array([data], pa.binary()), "more": pa.array([more], pa.binary())})
    return run


class Graph:
    """Targets by source; nodes are numbered from 0."""

    def __init__(self, number: str = "i8"):
        self._number = number
        self._file = tempfile.TemporaryFile(prefix="walks-")
        self._counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, src: np.ndarray, dst: np.ndarray) -> None:
        """Edges by source, in order."""
        self._file.write(dst.astype(self._number).tobytes())
        self._counts.append(np.unique(src, return_counts=True))
        self.size += len(dst)

    def close(self, nodes: int) -> None:
        count = np.zeros(nodes + 1, np.int64)
        for src, n in self._counts:
            count[src + 1] += n
        self._counts = []
        self.offsets = np.cumsum(count)
        self._file.flush()
        self.targets = np.memmap(self._file, self._number, "r", shape=(self.size,)) if self.size else np.zeros(0, self._number)
        self.seen, self._next = np.zeros(nodes, np.uint64), np.zeros(nodes, np.uint64)

    def _edges(self, active: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Targets of the active nodes' edges with the nodes' bits, some ``SLICE`` at a time."""
        start, count = self.offsets[active], self.offsets[active + 1] - self.offsets[active]
        some = count > 0
        start, count, bits = start[some], count[some], bits[some]
        end = np.cumsum(count)
        low = 0
        while low < len(count):
            before = end[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(end, before + SLICE, "right")))
            n, b = count[low:high], bits[low:high]
            if high == low + 1:  # a node of very many edges is cut
                for at in range(0, int(n[0]), SLICE):
                    x = np.asarray(self.targets[start[low] + at:start[low] + min(int(n[0]), at + SLICE)])
                    yield x, np.full(len(x), b[0], np.uint64)
            else:
                at = np.arange(int(n.sum())) + np.repeat(start[low:high] - (np.cumsum(n) - n), n)
                yield np.asarray(self.targets[at]), np.repeat(b, n)
            low = high

    def walk(self, entries: np.ndarray, max_depth: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(nodes, their new bits, depth) from at most ``WIDTH`` entries, level by level."""
        bits = np.left_shift(np.uint64(1), np.arange(len(entries), dtype=np.uint64))
        np.bitwise_or.at(self.seen, entries, bits)
        active = np.unique(entries)
        fresh, touched, depth = self.seen[active], [active], 0
        while len(active):
            yield active, fresh, depth
            if depth == max_depth:
                break
            depth += 1
            dense, reached = int((self.offsets[active + 1] - self.offsets[active]).sum()) > len(self.seen) // 8, []
            for dst, got in self._edges(active, fresh):
                np.bitwise_or.at(self._next, dst, got)
                if not dense:
                    reached.append(np.unique(dst))
            new = np.flatnonzero(self._next) if dense else np.unique(np.concatenate(reached)) if reached else active[:0]
            fresh = self._next[new] & ~self.seen[new]
            self._next[new] = 0
            active, fresh = new[fresh != 0], fresh[fresh != 0]
            self.seen[active] |= fresh
            touched.append(active)
        for x in touched:
            self.seen[x] = 0


def _rows(entries: np.ndarray, nodes: np.ndarray, bits: np.ndarray, depth: int, repo: pa.ChunkedArray, name: pa.ChunkedArray):
    for bit, entry in enumerate(entries):
        hit = nodes[(bits >> np.uint64(bit)) & np.uint64(1) != 0]
        for at in range(0, len(hit), ROWS):
            some = hit[at:at + ROWS]
            same = pa.array(np.full(len(some), entry))
            yield {"repo_id": repo.take(same), "entry_fqn": name.take(same), "node": name.take(pa.array(some)),
                   "depth": pa.array(np.full(len(some), depth, np.int32))}


def _batches(parts: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Small results joined to batches of about ``ROWS`` rows."""
    held, n = [], 0
    for x in parts:
        held.append(pa.table(x))
        n += held[-1].num_rows
        if n >= ROWS or len(held) >= 4_096:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=ROWS)
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=ROWS)


def walks(groups: int, number: str, max_depth: int | None):
    """For ``mapInArrow``: ``(g, kind, first, last, n, data, more)`` by (g, kind, first,
    last), so that the edges of a node stand together though it spans blocks;
    each group the whole graph; group ``g`` walks from every ``groups``-th chunk."""
    def one(g, graph, entries, names):
        names = pa.concat_tables(names).combine_chunks()
        graph.close(names.num_rows)
        entries = np.concatenate(entries) if entries else np.zeros(0, np.int64)
        for at in range(g * WIDTH, len(entries), groups * WIDTH):
            chunk = entries[at:at + WIDTH]
            for nodes, bits, depth in graph.walk(chunk, max_depth):
                yield from _rows(chunk, nodes, bits, depth, names["repo_id"], names["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for b in batches:
            for i in range(b.num_rows):
                if b["g"][i].as_py() != g:
                    if g is not None:
                        yield from _batches(one(g, graph, entries, names))
                    g, graph, entries, names = b["g"][i].as_py(), Graph(number), [], []
                kind, n, data = b["kind"][i].as_py(), b["n"][i].as_py(), b["data"][i].as_buffer()
                if kind == NAMES:
                    names.append(pa.ipc.open_stream(data).read_all())
                elif kind == ENTRIES:
                    entries.append(_numbers(data, n, number))
                else:
                    graph.add(_numbers(data, n, number), _numbers(b["more"][i].as_buffer(), n, number))
        if g is not None:
            yield from _batches(one(g, graph, entries, names))
    return run
