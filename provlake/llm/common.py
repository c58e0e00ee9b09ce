"""What the operators share: inputs, intermediate tables, bytes columns, word splitting.

Intermediate results that are read more than once are written as Parquet under ``spark.checkpoint.dir``,
which the driver and all executors share; so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("PROVLAKE_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder is not None:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; nothing local stands in for it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/provlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, lineage cut."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._provlake_at = at
    return out


def forget(*tables: DataFrame | None) -> None:
    """Tables that ``stored`` has written, and that nothing reads any longer, go from the shared folder."""
    for df in tables:
        at = getattr(df, "_provlake_at", None)
        if at:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def input_bytes(df: DataFrame) -> int | None:
    """Bytes that df's plan is said to read, without running it; None where the plan can't tell."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows, because texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null counts as empty."""
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each of the starts, count of them."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows, at most 2n, by hashed key: the same at each run, spread over all of df; no sort of wide rows."""
    total = df.count()
    some = df if total <= n else df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(total)) < n)
    return some.limit(2 * n)


#: What a Python worker keeps between tasks, by the name of its kind: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Freed memory goes back to the machine, as idle workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_kept(keeps: str = "") -> None:
    """What the worker keeps goes, but for one kind. The table is the module's own, which a pickled closure wouldn't see."""
    for kind in [k for k in KEPT if k != keeps]:
        KEPT.pop(kind)()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow: what a worker keeps, but for the kind ``keeps``, goes before it, and what it has freed after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        try:
            yield from run(batches)
        finally:
            drop_kept(keeps)
            give_back()

    return task


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of no more than about ``most`` bytes, or of one row."""
    for b in batches:
        step = b.num_rows if b.nbytes <= most else max(1, int(b.num_rows * most / b.nbytes))
        for i in range(0, b.num_rows, max(step, 1)):
            yield b.slice(i, step)
