"""Arrays packed into binary columns, so that a shuffle moves a few large rows, and exchanges of them."""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "target int, kind int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, compressed; bytes of like weight lie together, so small numbers cost little."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode()
        parts.append(struct.pack("<B", len(code)) + code + struct.pack("<Q", len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 and len(a) else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4, []
    for _ in range(n):
        k = raw[at]
        kind = np.dtype(raw[at + 1 : at + 1 + k].decode())
        (size,) = struct.unpack_from("<Q", raw, at + 1 + k)
        at += 9 + k
        piece = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        at += size * kind.itemsize
        out.append(np.ascontiguousarray(piece.reshape(kind.itemsize, size).T).view(kind).reshape(size) if kind.itemsize > 1 and size else piece.view(kind))
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which pack better; undone by np.cumsum."""
    return np.diff(x, prepend=x.dtype.type(0)) if len(x) else x


def joined(parts: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The k arrays of many packs, end to end."""
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(k)]


#: Bytes of text for each partition, at most about: a task holds what some such bytes give.
PART_BYTES = 24_000_000


def partitions(docs: DataFrame, text: str = "text") -> int:
    """As many as the session asks for, or more where the texts are more: what a task holds has a bound at every size."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(n, -(-size // PART_BYTES))


def exchange(rows: DataFrame, n: int) -> DataFrame:
    """Each row to the partition that it names."""
    return rows.repartitionById(n, rows["target"]) if hasattr(rows, "repartitionById") else rows.repartition(n, "target")


def free_shuffles(spark: SparkSession) -> None:
    """Files of shuffles that nothing refers to any longer go as soon as the driver's JVM notices."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
