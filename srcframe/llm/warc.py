"""WARC records in seekable Zstandard bundles, and reading them back.

Records are grouped into frames of about ``FRAME_BYTES``, each an independent
Zstandard frame, so any frame can be read alone.  A bundle ends with two skippable
frames: the record index (record id, frame, offset in the frame, length) and, last,
the seek table of the seekable format (compressed and decompressed size of every
frame, footer with the number of frames and the magic number 0x8F92EAB1).

Every task writes bundles of at most about ``BUNDLE_BYTES`` under a temporary name
and renames them, so a repeated task replaces its own files.  They lie in a folder
that all executors share; Spark's binaryFile reader reads them back.

Equal payloads of at least ``SHARED_BYTES`` are stored once: the record with the
largest page_id is the response, others are revisits that refer to it.  Frequent
payloads are counted with partial aggregates and joined as one row each.

Rules: a null html is an empty payload.  Null urls are written as an empty target.
Rows without page_id are written with an empty id and come back as null; they
never are the response others refer to unless no row with that payload has an id
(then all of them are responses).  Repeated rows are written each; with equal ids
the payload's response is every row that has the largest id.  Empty table: no
bundle, no row.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcframe.llm.text import run_over

SHARED_BYTES = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 16 << 20
SEEK_MAGIC = 0x8F92EAB1       # fixed values of the seekable format
SEEK_FRAME = 0x184D2A5E
INDEX_FRAME = 0x184D2A50
LEVEL = 3
_ENTRY = struct.Struct("<qIII")  # page id, frame, offset, length; -2**63: no id
_NO_ID = -(2**63)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    name = f"<urn:page:{'' if page_id is None else page_id}>"
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}",
            "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    block = payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames, record index and seek table of one bundle, as bytes."""

    def __init__(self):
        import zstandard
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.out, self.frame = bytearray(), bytearray()
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, page_id, data: bytes) -> None:
        self.index.append((_NO_ID if page_id is None else page_id, len(self.sizes), len(self.frame), len(data)))
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.frame:
            packed = self.zstd.compress(bytes(self.frame))
            self.sizes.append((len(packed), len(self.frame)))
            self.out += packed
            self.frame = bytearray()

    def finish(self) -> bytes:
        self._close_frame()
        index = b"".join(_ENTRY.pack(*e) for e in self.index)
        self.out += struct.pack("<II", INDEX_FRAME, len(index)) + index
        self.sizes.append((8 + len(index), 0))
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out += struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + \
            struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return bytes(self.out)


def seek_table(data) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed size) of every frame, from the footer."""
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEK_MAGIC or flags & 0x80:
        raise ValueError("no seek table")
    at, out = 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - 8 * (count - k))
        out.append((at, packed, plain))
        at += packed
    return out


def record_index(data) -> list[tuple[int, int, int, int]]:
    """(page id, frame, offset in frame, length) of every record."""
    start, size, _ = seek_table(data)[-1]
    return list(_ENTRY.iter_unpack(bytes(data[start + 8:start + size])))


def read_frame(data, table: list, k: int) -> bytes:
    import zstandard
    start, size, plain = table[k]
    return zstandard.ZstdDecompressor().decompress(bytes(data[start:start + size]), max_output_size=max(plain, 1))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def read_record(data, page_id: int) -> bytes | None:
    """One record by id: only its frame is decompressed."""
    table = seek_table(data)
    for i, k, at, n in record_index(data):
        if i == page_id:
            return read_frame(data, table, k)[at:at + n]
    return None


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    shared = (rows.filter(F.octet_length("html") >= SHARED_BYTES).groupBy("digest")
              .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("digest", "kept"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("page_id").eqNullSafe(F.col("kept")), F.lit(None)).otherwise(F.col("kept")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``decide``'s rows as bundles in ``folder``; (bundle, page_id, frame,
    offset, length) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        pid, number, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def close() -> pa.RecordBatch:
            nonlocal number, bundle
            name = f"part-{pid:06d}-{number:04d}.warc.zst"
            temp = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as f:
                f.write(bundle.finish())
            fs.move(temp, f"{root}/{name}")
            cols = list(zip(*bundle.index, strict=True))
            found = pa.record_batch({
                "bundle": pa.array([name] * len(bundle.index)),
                "page_id": pa.array([None if i == _NO_ID else i for i in cols[0]], pa.int64()),
                "frame": pa.array(cols[1], pa.int32()), "offset": pa.array(cols[2], pa.int32()),
                "length": pa.array(cols[3], pa.int32())})
            number, bundle = number + 1, Bundle()
            return found

        for whole in batches:
            for t in run_over(whole, column="html"):
                for i, u, h, d, r in zip(*(t.column(c).to_pylist() for c in ("page_id", "url", "html", "digest",
                                                                             "refers_to")), strict=True):
                    bundle.add(i, record(i, u, h.encode(), d, r))
                    if len(bundle.out) >= BUNDLE_BYTES:
                        yield close()
        if bundle.index:
            yield close()

    return pages.mapInArrow(run, "bundle string, page_id long, frame int, offset int, length int")


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every bundle of ``folder``: page_id, url, record_type,
    refers_to, payload_bytes, payload_digest, payload (null for revisits).  The
    digest and length of responses are those of the payload read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for content in t.column("content"):
                data = memoryview(content.as_buffer())
                table, index = seek_table(data), record_index(data)
                for k, entries in groupby(index, key=lambda e: e[1]):
                    frame = read_frame(data, table, k)
                    cols: list[list] = [[] for _ in range(7)]
                    for i, _, at, n in entries:
                        head, block = parse(frame[at:at + n])
                        whole = head["WARC-Type"] == "response"
                        for c, x in zip(cols, (
                                None if i == _NO_ID else i, head["WARC-Target-URI"], head["WARC-Type"],
                                None if whole else int(head["WARC-Refers-To"][10:-1]),
                                len(block) if whole else int(head["X-Payload-Length"]),
                                hashlib.sha1(block).hexdigest() if whole else head["WARC-Payload-Digest"][5:],
                                block if whole else None), strict=True):
                            c.append(x)
                    yield pa.record_batch({
                        n: pa.array(c, x) for c, (n, x) in zip(cols, (
                            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("payload", pa.binary())), strict=True)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
                                 "payload_digest string, payload binary")
