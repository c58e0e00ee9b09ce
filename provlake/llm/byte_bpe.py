"""Byte-level BPE by ranks, with overlapping chunk encoding; decoding concatenates raw bytes.

A text longer than ``CHUNK`` characters becomes chunk rows: chunk k holds the characters from k*CHUNK to
(k+1)*CHUNK and ``OVERLAP`` more. The rows are dealt over the cluster and pre-tokenised each on its own. A
chunk other than the first may begin amid a pre-token, and one other than the last ends amid one, so chunks
are stitched where the pre-token boundaries of both agree within their overlap: matching goes on from a
boundary in one way only, hence from the first common one both agree. The boundaries of a chunk's last
``LOOKAHEAD`` characters don't count, as the pattern could still read on there. Each chunk then encodes what
lies between its two seams, and a text's pieces are joined in order. A text with a seam that doesn't
resynchronise (a pre-token longer than the overlap) is encoded whole.

Edge cases: null text counts as empty, which has no ids; repeated rows and a null doc_id are kept; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlake.llm.common import KEPT, lean, small_batches, text_batches, vocabulary

CHUNK = 32_768
OVERLAP = 512
LOOKAHEAD = 4
#: Bytes of memory that the pre-tokens a worker keeps may take, about; each costs two entries besides its characters.
MOST_BYTES = 80_000_000
ENTRY_BYTES = 210


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first, until none is left.

    A heap over a linked list, so a long pre-token costs n log n.
    """
    import heapq

    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes by a rank file; pre-tokens already seen are kept, up to a bound."""

    def __init__(self, file: str, pat: str):
        import regex

        with open(file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pat)
        self.known: dict[str, bytes] = {}
        self.bytes = 0

    def ids_of(self, pre: list[str]) -> bytes:
        """ids of a list of pre-tokens, little-endian unsigned 32-bit."""
        known = self.known
        for p in set(filterfalse(known.__contains__, pre)):
            known[p] = ids = np.array(merge(p.encode(), self.ranks), "<u4").tobytes()
            self.bytes += ENTRY_BYTES + len(p) + len(ids)
        got = b"".join(map(known.__getitem__, pre))
        if self.bytes > MOST_BYTES:
            known.clear()
            self.bytes = 0
        return got

    def encode(self, text: str) -> bytes:
        return self.ids_of(self.pattern.findall(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str) -> list[int]:
        """Where each pre-token ends, from a scan that starts at 0; what the pattern skips ends one as well."""
        return [m.end() for m in self.pattern.finditer(text)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(file: str, pat: str) -> Codec:
    if (file, pat) not in _CODECS:
        _CODECS.clear()
        _CODECS[file, pat] = Codec(file, pat)
    KEPT["codec"] = _CODECS.clear
    return _CODECS[file, pat]


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
NAMES = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


def described(doc: int | None, ids: bytes, c: Codec, with_ids: bool) -> tuple:
    return doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), ids if with_ids else None


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, KINDS, strict=True)], names=NAMES)


def encode(docs: DataFrame, file: str | None = None, pat: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (null unless with_ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    file = file or vocabulary("byte_bpe_multi_50k.tiktoken")
    pat = pat or pattern()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_docs = docs.where(F.length("text") > chunk).withColumn("key", F.monotonically_increasing_id())

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, pat)
        for b in text_batches(batches):
            yield rows_batch([described(d, c.encode(t), c, with_ids) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            rows = []
            for d, t, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = -(-len(t) // chunk)
                rows += [(d, key, k, n, t[k * chunk : (k + 1) * chunk + overlap]) for k in range(n)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["doc_id", "key", "k", "n", "part"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries of each chunk within the overlaps, as places in the whole text."""
        c = codec(file, pat)
        for b in batches:
            heads, tails = [], []
            for k, n, part in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                base, last = k * chunk, k == n - 1
                ends = [0, *c.boundaries(part)]
                sure = len(part) - (0 if last else LOOKAHEAD)
                heads.append([base + e for e in ends if e <= overlap and e <= sure])
                tails.append([] if last else [base + e for e in ends if chunk <= e <= sure])
            places = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, places), pa.array(tails, places)], names=["doc_id", "key", "k", "n", "part", "head", "tail"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's ids between its seams; a chunk of a text to be encoded whole passes its characters on."""
        c = codec(file, pat)
        for b in batches:
            t = b.to_pydict()
            ids = [None if w else c.encode(p[s - k * chunk : e - k * chunk]) for w, p, s, e, k in zip(t["whole"], t["part"], t["from"], t["to"], t["k"], strict=True)]
            own = [p[:chunk] if w else None for w, p in zip(t["whole"], t["part"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(t["doc_id"], pa.int64()), pa.array(t["key"], pa.int64()), pa.array(t["k"], pa.int32()), pa.array(ids, pa.binary()), pa.array(own, pa.string())], names=["doc_id", "key", "k", "ids", "own"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's pieces in order; the rows come sorted by text and chunk."""
        c = codec(file, pat)
        now: tuple | None = None
        held: list[tuple] = []

        def done() -> tuple:
            whole = held[0][1] is not None
            ids = c.encode("".join(x[1] for x in held)) if whole else b"".join(x[0] for x in held)
            return described(now[0], ids, c, with_ids)

        for b in batches:
            rows = []
            t = b.to_pydict()
            for d, key, k, ids, own in zip(t["doc_id"], t["key"], t["k"], t["ids"], t["own"], strict=True):
                if k == 0 and held:
                    rows.append(done())
                    held = []
                now = (d, key)
                held.append((ids, own))
            yield rows_batch(rows)
        if held:
            yield rows_batch([done()])

    rows = long_docs.mapInArrow(lean(split, "codec"), "doc_id long, key long, k int, n int, part string").repartition("key", "k")
    found = rows.mapInArrow(lean(scan, "codec"), "doc_id long, key long, k int, n int, part string, head array<long>, tail array<long>")
    order, text = Window.partitionBy("key").orderBy("k"), Window.partitionBy("key")
    common = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    found = found.withColumn("from", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(common))
    found = found.withColumn("to", F.when(F.col("k") == F.col("n") - 1, F.col("k").cast("long") * chunk + F.length("part")).otherwise(F.lead("from").over(order)))
    found = found.withColumn("whole", F.max(F.col("from").isNull() | F.col("to").isNull() | F.coalesce(F.col("to") < F.col("from"), F.lit(False))).over(text))
    ids = found.select("doc_id", "key", "k", "part", "from", "to", "whole").repartition("key", "k").mapInArrow(lean(pieces, "codec"), "doc_id long, key long, k int, ids binary, own string")
    whole = ids.repartition("key").sortWithinPartitions("key", "k").mapInArrow(lean(joined, "codec"), OUT)
    return docs.where(F.length("text") <= chunk).mapInArrow(lean(short, "codec"), OUT).unionByName(whole)
