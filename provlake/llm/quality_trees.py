"""Quality rules: base rules on counts, then gradient-boosted trees over document statistics.

The trees are grown on histograms of a bounded, hashed sample of labelled rows (``SAMPLE``), with monotonic
constraints: a split on a constrained feature is allowed only if its leaves stay in order, and bounds are handed
down to both sides. All trees are flattened into one set of numpy node arrays, so a batch of documents walks all
of a tree's levels in a few array operations.

Edge cases: null text counts as empty (n_words 0, so base_failed); repeated rows and a null doc_id are kept; with
no usable labels the trees accept all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlake.llm.common import lean, small_batches, stored, text_batches

SAMPLE = 20_000
TREES = 60
DEPTH = 4
RATE = 0.15
BINS = 64
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("repeat_share", "symbol_share", "upper_share", "digit_share", "dup_line_share", "distinct_share", "mean_word", "top_share", "punct_share", "line_words", "log_words")
#: More of it never makes a document better (-1) or worse (1).
MONOTONE = {"repeat_share": -1, "symbol_share": -1, "dup_line_share": -1, "top_share": -1}

SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
DIGITS = re.compile(r"[0-9]")
PUNCT = re.compile(r"[!?;:\"'()]")
BLANK = re.compile(rb"\A[\x20\x09-\x0d]*\Z")


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if kinds < 2_000_000:
        key = (a * kinds + b) * kinds + c
    else:  # products would overflow: number the pairs first
        _, pair = np.unique(a * kinds + b, return_inverse=True)
        key = pair * kinds + c
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def statistics(text: str) -> tuple:
    """COUNTS and RATIOS of one text."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the blanks of the word rule
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in raw.split(b"\n") if not BLANK.match(x)]
    dup = len(lines) - len(set(lines))
    symbols = len(SYMBOLS.findall(text))
    repeat = repeated_words(ids, len(number))
    top = int(np.bincount(ids).max()) if n else 0
    w, c = max(n, 1), max(chars, 1)
    ratios = (
        repeat / w, symbols / c, len(UPPER.findall(text)) / c, len(DIGITS.findall(text)) / c, dup / max(len(lines), 1),
        len(number) / w, chars / w, top / w, len(PUNCT.findall(text)) / c, n / max(len(lines), 1), float(np.log1p(n)),
    )
    return (n, chars, symbols, dup, repeat, *ratios)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS (long) and RATIOS (double) of every whole text."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *COUNTS, *RATIOS]
    kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.float64()] * len(RATIOS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            rows = [(d, *statistics(t or "")) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = ", ".join([f"{n} long" for n in ("doc_id", *COUNTS)] + [f"{n} double" for n in RATIOS])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


@dataclass
class Forest:
    """All trees' nodes in flat arrays; ``roots`` has each tree's first node. A leaf is its own child."""

    base: float = 4.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    depth: int = DEPTH

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def boost(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = 2.0, least: float = 2.0, weight: np.ndarray | None = None) -> Forest:
    """Newton boosting of the logistic loss on binned features; weight counts a row as so many."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        return Forest(base=4.0 if not len(y) or y.min() else -4.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        work = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            gs, hs = g[rows], h[rows]
            total_g, total_h = gs.sum(), hs.sum()
            value = float(np.clip(total_g / (total_h + ridge), low, high))
            best = None
            if level < depth and len(rows) >= 2:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    bins = binned[rows, f]
                    left_g = np.cumsum(np.bincount(bins, gs, len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins, hs, len(e) + 1))[:-1]
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
                    a = np.clip(left_g / (left_h + ridge), low, high)
                    b = np.clip(right_g / (right_h + ridge), low, high)
                    gain[(left_h < least) | (right_h < least) | ((b - a) * monotone[f] < 0)] = -1
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, float(a[k]), float(b[k]))
            if best is None:
                nodes[at] = [0, np.inf, at, at, rate * value]
                margin[rows] += rate * value
                continue
            _, f, k, a, b = best
            mid = (a + b) / 2
            bounds = ((low, min(high, mid)), (max(low, mid), high)) if monotone[f] > 0 else ((max(low, mid), high), (low, min(high, mid))) if monotone[f] < 0 else ((low, high), (low, high))
            children = []
            goes_left = binned[rows, f] <= k
            for part, (lo, hi) in zip((rows[goes_left], rows[~goes_left]), bounds, strict=True):
                children.append(len(nodes))
                nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
                work.append((children[-1], part, level + 1, lo, hi))
            nodes[at] = [f, float(edges[f][k]), *children, 0.0]
    cols = list(zip(*nodes, strict=True))
    return Forest(base, np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4]), np.array(roots, np.int64), depth)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """From labelled rows, at most ``sample`` of them; a doc_id with several labels counts once, as bad if any is."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality") > 0).cast("int").alias("quality"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stats.join(F.broadcast(some), "doc_id")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*COUNTS))).where("_n = 1")
    got = rows.orderBy("doc_id").select("quality", *RATIOS).collect()
    x = np.array([[r[c] for c in RATIOS] for r in got], float).reshape(-1, len(RATIOS))
    y = np.array([r["quality"] for r in got], float)
    return boost(x, y, np.array([MONOTONE.get(c, 0) for c in RATIOS]))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, score. Texts are read once; the trees run over the narrow statistics."""
    stats = stored(document_statistics(docs), "statistics")
    forest = fit(stats, labels, sample)
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in RATIOS]) if b.num_rows else np.zeros((0, len(RATIOS)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(1 + len(COUNTS))] + [pa.array(forest.score(x))], names=[*names[: 1 + len(COUNTS)], "score"])

    scored = stats.mapInArrow(lean(run), ", ".join(f"{n} long" for n in ("doc_id", *COUNTS)) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= 0.5)).select("doc_id", *COUNTS, "base_failed", "kept", "score")
