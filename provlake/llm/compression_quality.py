"""Compression classifier: zstandard dictionaries of good and of bad text, and a calibrated score.

Two dictionaries are trained on a bounded sample of labelled rows (``SAMPLE`` of each label): their whole texts are cut
into blocks of ``BLOCK`` bytes, of which at most ``TRAINING`` of each label, the least by hash, serve. A text is compressed whole, in blocks of ``BLOCK`` bytes so that long texts don't outgrow the
dictionaries, with either. Its normalised size difference (bad - good) / (bad + good), with the compressed share
of its bytes for repetition that neither dictionary knows, is calibrated by a logistic curve fitted on *other*
labelled rows, so dictionaries never judge the texts they were made of. Labels and doc_id are no inputs. One
penalty holds for all of the curve's inputs at every size.

Folds: crc32(doc_id as text) mod 3; 0 trains dictionaries, 2 calibrates, 1 is held out.

Edge cases: null and empty texts get the score of an empty text, from the curve as any other; repeated rows and a
null doc_id (never held out) are kept; with no or one-sided labels all scores are the share of good labels (0.5
with none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provlake.llm.common import lean, small_batches, text_batches

SAMPLE = 3000
TRAINING = 4000
DICTIONARY_BYTES = 110_000
BLOCK = 4096
LEVEL = 3
#: Penalty on the curve's weights.
RIDGE = 1.0


def train(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    texts = [t for t in texts if len(t) >= 8]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


class Sizer:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, block: int = BLOCK):
        self.block = block
        self.press = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            self.press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, raw: bytes) -> tuple[int, int, int]:
        """(bytes, with the good, with the bad dictionary)"""
        good = bad = 0
        for i in range(0, max(1, len(raw)), self.block):
            part = raw[i : i + self.block]
            good += len(self.press[0].compress(part))
            bad += len(self.press[1].compress(part))
        return len(raw), good, bad


def inputs(sizes: np.ndarray) -> np.ndarray:
    """Columns of the curve from rows of (bytes, good, bad)."""
    n, good, bad = sizes.astype(float).T
    d = (bad - good) / np.maximum(1, bad + good)
    r = np.minimum(good, bad) / np.maximum(1, n)
    r = np.minimum(r, 2.0)
    length = np.log1p(n)
    return np.column_stack([np.ones_like(d), d, r, length, d * r, d * length, r * length, d * d, r * r, length * length])


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, sizes: np.ndarray) -> np.ndarray:
        z = (inputs(sizes) - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of the logistic curve, by Newton steps."""
    x = inputs(sizes)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    x = (x - mean) / scale
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fold", (F.crc32(F.col("doc_id").cast("string")) % 3).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From the labelled rows of folds 0 and 2; at most ``sample`` rows of each fold and label, by hashed doc_id."""
    from pyspark.sql import Window

    small_batches(docs.sparkSession)
    marked = with_fold(labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality")))
    ids = None
    for fold in (0, 2):
        for q in (0, 1):
            some = marked.where(f"fold = {fold} and quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
            ids = some if ids is None else ids.unionByName(some)
    # bounded: four times sample rows
    ids = ids.groupBy("doc_id", "fold").agg(F.max("quality").alias("quality"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text"), F.xxhash64("text")))).where("_n = 1")
    raw = F.encode("text", "utf-8")
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / BLOCK).cast("int"))
    blocks = some.where("fold = 0").select("quality", raw.alias("raw"), F.explode(places).alias("k")).select("quality", F.substring(F.col("raw"), F.col("k") * BLOCK + 1, F.lit(BLOCK)).alias("raw"))
    train_on = [[bytes(r["raw"]) for r in blocks.where(f"quality = {q}").orderBy(F.xxhash64("raw"), "raw").limit(TRAINING).select("raw").collect()] for q in (1, 0)]
    good, bad = map(train, train_on)
    got = sized(some.where("fold = 2").select("doc_id", "text", "quality"), good, bad).select("quality", "n", "good", "bad").collect()
    y = np.array([r["quality"] for r in got], float)
    sizes = np.array([[r["n"], r["good"], r["bad"]] for r in got], float).reshape(-1, 3)
    k = inputs(np.zeros((1, 3))).shape[1]
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        weights = np.zeros(k)
        weights[0] = np.log(share / (1 - share))
        return Model(good, bad, np.zeros(k), np.ones(k), weights)
    return Model(good, bad, *calibrate(sizes, y))


def sized(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """doc_id, quality, n, good, bad of rows of (doc_id, text, quality)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sizer(good, bad)
        for b in text_batches(batches):
            got = [s.sizes((t or "").encode()) for t in b.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "quality", "n", "good", "bad"])

    return rows.mapInArrow(lean(run), "doc_id long, quality int, n long, good long, bad long")


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5); docs' own columns of these names are replaced."""
    small_batches(docs.sparkSession)
    keep = docs.drop("score", "predicted")
    schema = StructType(list(keep.schema.fields)).add("score", "double").add("predicted", "integer")
    at = keep.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sizer(model.good, model.bad)
        for b in text_batches(batches):
            got = np.array([s.sizes((t or "").encode()) for t in b.column(at).to_pylist()], float).reshape(-1, 3)
            score = model.score(got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return keep.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = with_fold(apply(rows, model).drop("text"))
    return out.select("doc_id", F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out"), "score", "predicted")
