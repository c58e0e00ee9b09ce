"""BagMinHash: signatures whose slots agree with the probability of the weighted Jaccard similarity.

A weight (how often a shingle occurs) is discretised at 0, 1, 2, ... and its range is cut into dyadic blocks (0,1],
(1,2], (2,4], ... Each shingle and block has a Poisson process of the block's rate; a point falls on a level of
the block, found by halving the block once for each bit of the point's hash, and counts if the weight reaches it. A
point also falls on one slot, and a slot keeps the earliest point of all. So two multisets share a slot's point with
probability sum(min)/sum(max). Points of a process come in order of time; a process stops once its time is beyond
the latest slot of its text. All processes of a batch of texts advance together.
"""

from __future__ import annotations

import numpy as np

from provlake.llm.common import mix

SLOTS = 128


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, slots: int = SLOTS) -> np.ndarray:
    """(n_texts, slots) of 64-bit ids of points, from distinct (text, shingle) with weights; 0 where there is none."""
    time = np.full(n_texts * slots, np.inf)
    point = np.zeros(n_texts * slots, np.uint64)
    # processes: a block of level 2**j reaches from 2**(j-1), exclusive, to 2**j
    n_blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    own = np.repeat(np.arange(len(text)), n_blocks)
    block = np.arange(len(own)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    size = np.where(block == 0, 1, low)
    t, w = text[own].astype(np.int64), weight[own].astype(np.int64)
    key = mix(mix(shingle[own]) + block.astype(np.uint64))
    at = np.zeros(len(own))
    step = 0
    while len(t):
        step += 1
        h = mix(key + np.uint64(step * 0xD1342543DE82EF95 % 2**64))
        at += -np.log1p(-((h >> np.uint64(11)).astype(np.float64) / 2.0**53)) / size
        h2 = mix(h ^ np.uint64(0xA0761D6478BD642F))
        slot = t * slots + (h2 % np.uint64(slots)).astype(np.int64)
        # halving: the upper bits of h2 choose a half, and a half of that, down to one level
        level = low + 1 + ((h2 >> np.uint64(32)).astype(np.int64) & (size - 1))
        counts = level <= w
        s, a, i = (slot, at, h) if counts.all() else (slot[counts], at[counts], h[counts])
        np.minimum.at(time, s, a)
        won = time[s] == a
        point[s[won]] = i[won]
        latest = time.reshape(n_texts, slots).max(axis=1)
        go = at <= latest[t]
        if not go.all():
            t, w, key, at, low, size = t[go], w[go], key[go], at[go], low[go], size[go]
    return point.reshape(n_texts, slots)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(n_texts, slots / rows) keys; a band's number is part of its key."""
    n, slots = sig.shape
    parts = sig.reshape(n, slots // rows, rows)
    key = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, i])
    return key
