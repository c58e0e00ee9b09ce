"""Media columns: payloads stored as images in archives, read back through a Spark data source.

``store`` turns each text into a lossless 8-bit grey image (PNG, 64 samples a row) and packs the images
of a task into one archive. An archive is: members, a directory of fixed-width entries (offset, length,
crc32, doc_id, flags), and a footer that gives the directory's place. ``ArchiveSource`` is a Python data
source: it plans byte-range partitions over the archives, each partition reads the directory entries of the
members that start in its range, streams their payloads as Arrow batches, and reads a member that fails its
crc32 or is cut short again by its offset alone, without its neighbours.

Archives carry attempt-unique names and only those that a finished task reports are planned, so a task that
is run twice leaves no member twice.

Edge cases: null and empty texts are stored as one row of 64 zero samples; repeated rows and a null doc_id are
kept; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from provlake.llm.common import lean, scratch, small_batches, text_batches

WIDTH = 64
RANGE_BYTES = 4_000_000
RETRIES = 4
ENTRY = struct.Struct("<QIIqIB3x")  # offset, length, crc32, doc_id, unpadded bytes, doc_id is null
FOOTER = struct.Struct("<QQ8s")  # directory offset, members, mark
MARK = b"GREYARC1"
BATCH_BYTES = 1_000_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of 64."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A grey PNG whose 8-bit samples are the payload; rows are unfiltered."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(x), WIDTH + 1), np.uint8)
    rows[:, 1:] = x
    head = struct.pack(">IIBBBBB", WIDTH, len(x), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_image(stored: bytes) -> bytes:
    """The samples of a grey 8-bit PNG of this width with unfiltered rows; checksums are verified."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, height, data = 8, 0, []
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if width != WIDTH or form != [8, 0, 0, 0, 0]:
                raise ValueError("not an image of ours")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """rows;mean;standard deviation;share of edges between neighbours;a 4x4 thumbnail, as text."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    wide = x.astype(np.int64)
    n = x.size
    total, squares = int(wide.sum()), int((wide * wide).sum())
    edges = int((np.abs(np.diff(wide, axis=1)) > 32).sum())
    rows = np.linspace(0, x.shape[0], 5).astype(int)
    cells = [int(wide[a : max(b, a + 1), c : c + 16].sum()) // (max(b - a, 1) * 16) for a, b in zip(rows[:-1].clip(max=x.shape[0] - 1), rows[1:], strict=True) for c in range(0, WIDTH, 16)]
    return f"{x.shape[0]};{total * 1000 // n};{(squares * n - total * total) * 1000 // (n * n)};{edges};" + "".join(f"{c:02x}" for c in cells)


def directory_bytes(entries: list[tuple]) -> bytes:
    return b"".join(ENTRY.pack(*e) for e in entries)


def ending(entries: list[tuple], offset: int) -> bytes:
    """The directory and the footer of an archive whose members end at offset."""
    return directory_bytes(entries) + FOOTER.pack(offset, len(entries), MARK)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def store(docs: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write the archives; (path, bytes) of each. One row comes to the driver for each task, not for each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = open_fs(folder)
        where.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.arc"
        entries, offset, out = [], 0, None
        for b in text_batches(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                image = to_image(padded(raw))
                out = out or where.open_output_stream(f"{at}/{name}")
                out.write(image)
                entries.append((offset, len(image), zlib.crc32(image), doc or 0, len(raw), doc is None))
                offset += len(image)
        if out is not None:
            last = ending(entries, offset)
            out.write(last)
            out.close()
            size = offset + len(last)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["path", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "path string, size long").collect()
    return sorted((r["path"], r["size"]) for r in rows)


def manifest(spark: SparkSession, archives: list[tuple[str, int]]) -> str:
    """A file of the archives' sizes and paths, so that a plan names one file however many archives there are."""
    at = scratch(spark, "manifest") + ".txt"
    where, path = open_fs(at)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write("".join(f"{n}\t{p}\n" for p, n in archives).encode())
    return at


def listed(at: str) -> list[tuple[str, int]]:
    where, path = open_fs(at)
    with where.open_input_stream(path) as f:
        rows = [line.split("\t", 1) for line in f.read().decode().splitlines()]
    return [(p, int(n)) for n, p in rows]


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, first: int, last: int):
        self.path, self.size, self.first, self.last = path, size, first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = listed(options["manifest"])
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(p, n, a, min(a + self.step, n)) for p, n in self.archives for a in range(0, n, self.step)] or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        where, at = open_fs(part.path)
        with where.open_input_file(at) as f:
            directory, n, mark = FOOTER.unpack(read_at(f, part.size - FOOTER.size, FOOTER.size))
            if mark != MARK:
                raise ValueError(f"{part.path} is no archive")
            first = search(f, directory, n, part.first)
            last = search(f, directory, n, part.last)
            rows: list[tuple] = []
            held = 0
            for k in range(first, last, 4096):
                some = read_at(f, directory + k * ENTRY.size, (min(last, k + 4096) - k) * ENTRY.size)
                for offset, length, crc, doc, unpadded, null in ENTRY.iter_unpack(some):
                    rows.append((None if null else doc, unpadded, member(f, offset, length, crc, self.retries)))
                    held += length
                    if held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "n_bytes", "media"])


def read_at(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    return f.read(length)


def search(f, directory: int, n: int, offset: int) -> int:
    """The first member that starts at ``offset`` or beyond, by bisection over the directory."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        if ENTRY.unpack(read_at(f, directory + mid * ENTRY.size, ENTRY.size))[0] < offset:
            low = mid + 1
        else:
            high = mid
    return low


def member(f, offset: int, length: int, crc: int, retries: int) -> bytes:
    """One member's bytes; a failed read is tried again from its own offset, with growing pauses."""
    for attempt in range(retries + 1):
        try:
            got = read_at(f, offset, length)
            if len(got) == length and zlib.crc32(got) == crc:
                return got
            failure: Exception = OSError(f"member at {offset} fails its checksum")
        except OSError as e:
            failure = e
        if attempt < retries:
            time.sleep(0.05 * 2**attempt)
    raise failure


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "greyarchive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read(spark: SparkSession, archives: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The archives' members: doc_id, n_bytes, media."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("greyarchive").option("manifest", manifest(spark, archives)).option("rangeBytes", str(range_bytes)).load()


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Checksums and features of what was read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for stored in b.column(2).to_pylist():
                p = from_image(stored)
                for col, v in zip(out, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(p)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(lean(run), DIGEST)


def media_digests(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the documents' payloads, read them back, and describe each."""
    spark = docs.sparkSession
    return digests(read(spark, store(docs, folder or scratch(spark, "media"))))
