"""Token-id files: each document's ids compressed alone with a shared zstandard dictionary.

File: mark, dictionary length, dictionary, one frame for each document, the index (doc_id, frame offset,
number of ids, doc_id is null), and a footer with the index's place and the dictionary's SHA-256. ``lookup``
reads one document by the index, without the frames before it. The dictionary is trained on the serialized
ids of a bounded sample: at most ``SAMPLE`` blocks of ``BLOCK`` ids from anywhere in the texts of hashed documents;
all documents are written with it.

Documents lie in ascending order of doc_id over files and within each; the manifest has one row for each file,
with the ids before it. Files carry attempt-unique names and the manifest names those of finished tasks only.

Edge cases: null text is empty and gives the end id alone; a null doc_id comes first; repeated doc_ids keep each
row, by text; an empty table gives no files and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import hashed_sample, lean, scratch, small_batches, text_batches, vocabulary
from provlake.llm.media import open_fs, read_at
from provlake.llm.tokens import cache_for, with_end

END_ID = 1
SAMPLE = 1500
BLOCK = 4096
DICTIONARY_BYTES = 64_000
LEVEL = 3
MARK = b"TOKFILE1"
HEAD = struct.Struct("<8sI")
ENTRY = struct.Struct("<qQIB3x")  # doc_id, frame offset, ids, doc_id is null
FOOTER = struct.Struct("<QQ32s8s")  # index offset, documents, dictionary's SHA-256, mark


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary over serialized ids; too few samples to train on serve as raw content instead."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary(docs: DataFrame, vocab: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """Whole texts of about ``sample`` hashed documents are cut into blocks; of these the least by hash serve."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache_for(vocab)
        for b in text_batches(batches):
            ids, starts = with_end(*words.encode_array(b.column(0)), end_id)
            raw = ids.astype("<u4").tobytes()
            places = [(4 * k, 4 * min(k + BLOCK, j)) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for k in range(i, j, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([raw[i:j] for i, j in places], pa.binary())], names=["raw"])

    some = hashed_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", sample).select("text")
    rows = some.mapInArrow(lean(blocks, "tokens"), "raw binary").orderBy(F.xxhash64("raw"), "raw").limit(sample).collect()
    return train([bytes(r["raw"]) for r in rows])


def heading(shared: bytes) -> bytes:
    return HEAD.pack(MARK, len(shared)) + shared


def ending(entries: list[tuple], offset: int, shared: bytes) -> bytes:
    """The index and the footer of a file whose frames end at offset."""
    return b"".join(ENTRY.pack(*e) for e in entries) + FOOTER.pack(offset, len(entries), hashlib.sha256(shared).digest(), MARK)


class TokenFile:
    """Reads one file."""

    def __init__(self, path: str):
        where, at = open_fs(path)
        self.f = where.open_input_file(at)
        end = self.f.size()
        self.index, self.n, sha, mark = FOOTER.unpack(read_at(self.f, end - FOOTER.size, FOOTER.size))
        head, size = HEAD.unpack(read_at(self.f, 0, HEAD.size))
        raw = read_at(self.f, HEAD.size, size)
        if mark != MARK or head != MARK or hashlib.sha256(raw).digest() != sha:
            raise ValueError(f"{path}: wrong mark or dictionary")
        self.entries = list(ENTRY.iter_unpack(read_at(self.f, self.index, self.n * ENTRY.size)))
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)

    def ids(self, k: int) -> bytes:
        """The k-th document's ids."""
        _, offset, n, _ = self.entries[k]
        end = self.entries[k + 1][1] if k + 1 < self.n else self.index
        got = self.unpack.decompress(read_at(self.f, offset, end - offset), max_output_size=4 * n)
        if len(got) != 4 * n:
            raise ValueError("a frame is cut short")
        return got

    def lookup(self, doc_id: int) -> bytes | None:
        """A document's ids by its doc_id; the entries are in order, nulls first."""
        nulls = sum(e[3] for e in self.entries)
        low, high = nulls, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.entries[mid][0] < doc_id else (low, mid)
        return self.ids(low) if low < self.n and self.entries[low][0] == doc_id else None


def write(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = END_ID, sample: int = SAMPLE) -> list[tuple[str, int, int]]:
    """Write the files; (path, documents, ids before it) of each, in order. One row a task comes to the driver."""
    vocab = vocab or vocabulary("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    shared = dictionary(docs, vocab, end_id, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache_for(vocab)
        where, at = open_fs(folder)
        where.create_dir(at, recursive=True)
        name, out, offset, total = f"{uuid.uuid4().hex}.tok", None, len(heading(shared)), 0
        entries: list[tuple] = []
        first: tuple | None = None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None, write_content_size=True)
        for b in text_batches(batches):
            ids, starts = with_end(*words.encode_array(b.column(1)), end_id)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for doc, i, j in zip(b.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if out is None:
                    out = where.open_output_stream(f"{at}/{name}")
                    out.write(heading(shared))
                    first = (doc is not None, doc or 0)
                frame = press.compress(raw[4 * i : 4 * j])
                out.write(frame)
                n = j - i
                entries.append((doc or 0, offset, n, doc is None))
                offset += len(frame)
                total += n
        if out is not None and first is not None:
            out.write(ending(entries, offset, shared))
            out.close()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            row = (f"{folder}/{name}", len(entries), total, *first)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "docs", "ids", "known", "first"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = ordered.mapInArrow(lean(run, "tokens"), "path string, docs long, ids long, known boolean, first long").collect()
    out, before = [], 0
    for r in sorted(rows, key=lambda r: (r["known"], r["first"])):
        out.append((r["path"], r["docs"], before))
        before += r["ids"]
    return out


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """Each document from the files: its first id's place in the whole output, its number of ids, their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                for k in range(0, f.n, 500):
                    rows = []
                    for j in range(k, min(f.n, k + 500)):
                        doc, _, n, null = f.entries[j]
                        ids = f.ids(j)
                        rows.append((None if null else doc, start, n, zlib.crc32(ids), ids))
                        start += n
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    table = spark.createDataFrame([(p, s) for p, _, s in files], "path string, start long").repartition(max(1, len(files)))
    return table.mapInArrow(lean(run), READ + (", ids binary" if with_ids else ""))


def write_and_read(docs: DataFrame, folder: str | None = None, vocab: str | None = None, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, folder or scratch(spark, "tokens"), vocab, end_id))
