"""SimHash near-duplicates by tiled exact comparison: no band and no sample, every pair within the radius is found.

A document's fingerprint has a bit for each that is set in over half of its shingles' hashes. Equal fingerprints are one
node. Nodes are ordered by the population counts of the four quarters of their bits and cut into tiles. Two tiles are compared
only if their counts come within the radius, for a bit that differs moves one count by one: the sum of the gaps between
the quarters' ranges is a lower bound of all their distances, and a sharper one than the gap of the whole counts. A task
holds two tiles, goes through them in small ones by the same rule, and compares what is left with exclusive-or and bit counts.

Scale. Texts are read once and only (doc_id, fingerprint) goes on. Nodes are dealt by range, a tile to a partition; pairs
of tiles meet through the first quarter's count, and each carries two tiles of at most 8 * ``MOST_TILE`` bytes. The work is
quadratic in the number of distinct fingerprints by the method, at about a nanosecond for each pair of the tenth or so that
the counts leave. From two tiles come only the links of a spanning forest, fewer than their nodes, so thousands of
near copies never become all their pairs, and components are those of all links.

Edge cases: null and blank texts have fingerprint zero and link like any other; fewer than four words are one shingle; equal
texts and repeated rows share a node; a null doc_id is kept and is no component's least (null if its component has no
other); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import forget, lean, small_batches, stored, text_batches, utf8_parts
from provlake.llm.components import components

WIDTH = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a tile: about a 32nd of all, within these bounds.
LEAST_TILE, MOST_TILE, TILES = 1024, 32768, 32
#: Fingerprints of the small tiles within a task.
SMALL = 256
#: Shingles whose bits are counted at once.
SHINGLES = 65_536
QUARTERS = [np.uint64(0xFFFF << (16 * i)) for i in (3, 2, 1, 0)]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words parted by one blank, A-Z lower-cased: the bytes, each word's first byte and end, words of each text."""
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    end = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1 if len(raw) else begin
    size = end - begin
    last = np.cumsum(size + 1) - 1  # where each word ends, its blank after it
    out = np.full(int(last[-1]) + 1 if len(last) else 0, 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[last] = False
    low = np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw).astype(np.uint8)
    out[keep] = low[~blank]
    count = np.searchsorted(begin, offsets[1:]) - np.searchsorted(begin, offsets[:-1])
    return out.tobytes(), last - size, last, count


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    data, begin, end, count = words_of(raw, offsets)
    shingles = np.where(count > 0, np.maximum(count - WIDTH + 1, 1), 0)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(count)), shingles)
    at = np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[text]
    stop = np.minimum(at + WIDTH, first[text] + count[text]) - 1
    hashed, view = xxhash.xxh64_intdigest, memoryview(data)
    ones = np.zeros((len(count), 64), np.int64)
    for i in range(0, len(text), SHINGLES):
        a, b, of = begin[at[i : i + SHINGLES]].tolist(), end[stop[i : i + SHINGLES]].tolist(), text[i : i + SHINGLES]
        h = np.array([hashed(view[x:y], SEED) for x, y in zip(a, b)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # eight one-byte sums are added as one number: runs are of one text, and of no more than such a sum can hold
        heads = np.r_[True, of[1:] != of[:-1]]
        heads = np.unique(np.r_[np.flatnonzero(heads), np.arange(0, len(of), 255)])
        sums = np.add.reduceat(bits.view(np.uint64), heads, axis=0).view(np.uint8).astype(np.int64)
        runs = of[heads]
        firsts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
        ones[runs[firsts]] += np.add.reduceat(sums, firsts, axis=0)
    most = 2 * ones > shingles[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel() if len(most) else np.zeros(0, np.uint64)


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(*utf8_parts(b.column(1))).view(np.int64))], names=["doc_id", "fp"])


def counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint."""
    return np.stack([np.bitwise_count(fp & q) for q in QUARTERS], axis=1).astype(np.int16)


def gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """The least distance between what lies within two ranges of counts."""
    return np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0).sum(axis=-1)


def ordered(fp: np.ndarray) -> np.ndarray:
    c = counts(fp)
    return fp[np.lexsort((fp, c[:, 3], c[:, 2], c[:, 1], c[:, 0]))]


def tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's fingerprints in order, cut into tiles of at most MOST_TILE, with the ranges of their counts."""
    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 32
    fp = ordered(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy(zero_copy_only=False) for b in batches)]).view(np.uint64))
    for k, i in enumerate(range(0, len(fp), MOST_TILE)):
        part = fp[i : i + MOST_TILE]
        c = counts(part)
        low, high = c.min(axis=0).astype(np.int32).tolist(), c.max(axis=0).astype(np.int32).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([at + k]), pa.array([low], pa.list_(pa.int32())), pa.array([high], pa.list_(pa.int32())), pa.array([part.astype("<u8").tobytes()], pa.binary())], names=["tile", "low", "high", "payload"])


class Forest:
    """Links that join two trees are kept, the others dropped; nodes are numbers below n."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            # each of the larger roots takes one link, to the least root it meets
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            heads = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            self.kept.append((a[heads], b[heads]))
            self.root[high[heads]] = low[heads]
            while True:
                over = self.root[self.root]
                if np.array_equal(over, self.root):
                    break
                self.root = over

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(a for a, _ in self.kept)]), np.concatenate([none, *(b for _, b in self.kept)])


def compare(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a tile, or of two, that link: of all pairs within the radius, a spanning forest."""
    both = a if b is None else np.concatenate([a, b])
    forest = Forest(len(both))

    def smalls(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, cuts = counts(x), np.arange(0, len(x), SMALL)
        return np.minimum.reduceat(c, cuts, axis=0), np.maximum.reduceat(c, cuts, axis=0)

    other, base = (a, 0) if b is None else (b, len(a))
    (low_a, high_a), (low_b, high_b) = smalls(a), smalls(other)
    apart, ones = np.empty((SMALL, SMALL), np.uint64), np.empty((SMALL, SMALL), np.uint8)
    for i in range(len(low_a)):
        near = np.flatnonzero(gap(low_a[i], high_a[i], low_b, high_b) <= radius)
        if b is None:
            near = near[near >= i]
        left = a[i * SMALL : (i + 1) * SMALL]
        for j in near:
            right = other[j * SMALL : (j + 1) * SMALL]
            cut = slice(0, len(left)), slice(0, len(right))
            close = np.bitwise_count(np.bitwise_xor(left[:, None], right[None, :], out=apart[cut]), out=ones[cut]) <= radius
            if b is None and i == j:
                close = np.triu(close, 1)
            if close.any():
                x, y = np.nonzero(close)
                forest.add(x + i * SMALL, y + base + j * SMALL)
    x, y = forest.links()
    return both[x], both[y]


def pair_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for same, left, right in zip(*(whole.column(k) for k in range(3))):
                a = np.frombuffer(left.as_py(), "<u8")
                x, y = compare(a, None if same.as_py() else np.frombuffer(right.as_py(), "<u8"), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints in nodes (fp) whose components are those of all pairs within radius."""
    spark = nodes.sparkSession
    total = nodes.count()
    size = min(MOST_TILE, max(LEAST_TILE, -(-total // TILES)))
    cells = [F.bit_count(F.col("fp").bitwiseAND(F.lit(int(q.view(np.int64))))).alias(f"c{i}") for i, q in enumerate(QUARTERS)]
    keyed = nodes.select("fp", *cells).repartitionByRange(max(1, -(-total // size)), "c0", "c1", "c2", "c3", "fp").select("fp")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    tiles = stored(keyed.mapInArrow(lean(tile_rows), "tile long, low array<int>, high array<int>, payload binary"), "tiles")
    near = F.expr(f"aggregate(sequence(0, 3), 0, (sum, i) -> sum + greatest(low_b[i] - high_a[i], low_a[i] - high_b[i], 0)) <= {radius}")
    a = tiles.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.expr("sequence(low[0], high[0])")).alias("c"))
    b = tiles.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.expr(f"sequence(low[0] - {radius}, high[0] + {radius})")).alias("c"))
    # of the counts at which two tiles meet, the least; every pair once, from its lesser tile
    met = (F.col("a") <= F.col("b")) & near
    pairs = a.join(b, "c").where(met).groupBy("a", "b").agg(F.min("c").alias("c")).select("a", "b")
    left, right = tiles.select(F.col("tile").alias("a"), F.col("payload").alias("left")), tiles.select(F.col("tile").alias("b"), F.col("payload").alias("right"))
    held = pairs.join(left, "a").join(right, "b").select((F.col("a") == F.col("b")).alias("same"), "left", "right")
    # a row is two tiles of up to a quarter of a megabyte; dealt one by one, as the work of pairs differs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        return stored(held.repartition(tasks).mapInArrow(lean(pair_rows(radius)), "a long, b long"), "links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        forget(tiles)


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the component's least doc_id) of every row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stored(rows.mapInArrow(lean(fingerprint_rows), "doc_id long, fp long"), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes.select("fp"), radius)
    if found.isEmpty():
        named = nodes.withColumnRenamed("least", "component_id")
    else:
        roots = components(found)
        rooted = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(least, "root").select("fp", "component_id")
    # a table of its own, so that the join below is one of two plain shuffles, of which a fingerprint with many rows can be split
    named = stored(named, "classes")
    forget(nodes, found)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
