"""Words and five-word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from provlake.llm.common import mix
from provlake.llm.suffix_dedup import powers

WIDTH = 5


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without blanks, as in the quality rules) of texts laid end to end.

    (text number, first byte, byte after the last, hash) of each, in order. No word crosses texts.
    """
    n = len(raw)
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    inside = ~blank
    edge = np.zeros(n + 1, bool)
    edge[starts[(starts >= 0) & (starts <= n)]] = True
    before = np.r_[True, blank] | edge
    after = np.r_[blank, True] | edge
    begin = np.flatnonzero(inside & before[:n])
    end = np.flatnonzero(inside & after[1:]) + 1
    up, down = powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    value = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    text = np.searchsorted(starts, begin, side="right") - 1
    return text, begin, end, value


def shingles(text: np.ndarray, value: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle; texts of one to four words have one shingle, all their words."""
    counts = np.bincount(text, minlength=n_texts)
    first = np.cumsum(counts) - counts
    n = len(value)
    mixed = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - i] = value[i:]
        if i:  # a shorter text's shingle ends with its last word
            shifted[: n - i][text[i:] != text[: n - i]] = 0
            shifted[n - i :] = 0
        mixed = mix(mixed * np.uint64(0x9FB21C651E98DF25) + shifted + np.uint64(i + 1))
    place = np.arange(n) - first[text]
    keep = (place + WIDTH <= counts[text]) | ((place == 0) & (counts[text] < WIDTH))
    return text[keep], mixed[keep]


def content(text: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
    """A hash of each text's sequence of words; 0 words give one value."""
    counts = np.bincount(text, minlength=n_texts)
    first = np.cumsum(counts) - counts
    up, _ = powers(int(counts.max(initial=0)) + 1)
    place = np.arange(len(value)) - first[text]
    terms = value * up[place] if len(value) else value
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mix(total[first + counts] - total[first] + counts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def numbered(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, 1 for its first occurrence in the text, 2 for its second, ...), ordered by text and shingle."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    head = np.flatnonzero(new)
    level = np.arange(len(text)) - head[np.cumsum(new) - 1] + 1 if len(text) else np.zeros(0, np.int64)
    return text, shingle, level


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets given as sorted distinct (shingle, level) hashes."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)
