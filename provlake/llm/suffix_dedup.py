"""Suffix-array dedup: removes each byte covered by a 50-byte string that also starts in a smaller document.

Building one suffix array over a corpus isn't distributable, so documents first meet through anchors. An anchor
is a ``GRAM``-byte string whose hash is least among those of some ``WINDOW``-byte string (equal least ones all
count). Which anchor a window has depends on its own bytes only, hence equal windows share an anchor at the same
place, and all that could make a window a repeat lies in the anchors' contexts: what the windows that have them span,
at most ``REACH`` bytes before to ``WINDOW`` bytes from the anchor.

1. anchors    each task hashes its texts, finds anchors, and settles what repeats within its own batch; one entry
              for each (anchor, context, least document) goes to the anchor's partition, as packed arrays
2. entries    a context that a smaller document has too is covered whole; anchors of several documents with
              several contexts ask for those contexts' bytes
3. contexts   the texts' partitions cut the contexts asked for
4. suffixes   for each anchor, the suffix array of its contexts (``lyndon``: linear grouping, all anchors in
              step); suffixes that agree in 50 bytes are neighbours, and all but those of the least document are
              covered. An anchor with more than ``LANE`` contexts is split by longer common parts, down to
              single windows, so no lane grows with the corpus
5. cover      the texts' partitions join covered stretches and cut them out

Texts are scanned three times and never held by more than one partition; nothing but packed arrays moves. A row is
known by its doc_id and the hash of doc_id and text.

Edge cases: null text is empty; texts under 50 bytes keep all; a null doc_id is smaller than any other; of rows with
one doc_id none is smaller than another, so copies there stay; an empty table gives no rows; other columns are
ignored by ``dedup`` and kept by ``cut_repeats`` (names that begin with _ are its own).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provlake.llm import blobs
from provlake.llm.common import KEPT, lean, mix, ragged, small_batches, stored, utf8_parts
from provlake.llm.lyndon import suffix_arrays

WINDOW = 50
GRAM = 20
REACH = WINDOW - GRAM
BATCH_BYTES = 4_000_000
#: Bytes that a task gathers before it puts them out.
SENT_BYTES = 4_000_000
PIECE = 1_000_000
STEP = 3
LANE = 2000
LANE_SYMBOLS = 1_500_000
NOTHING = np.zeros(0, np.int64)
NULL_ID = np.iinfo(np.int64).min
ENTRIES, LOCAL, FULL, ASKED, TEXTS, PARTS = range(6)

BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        KEPT["powers"] = _POWERS.clear
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def sliding(x: np.ndarray, w: int, best: np.ufunc, forward: bool) -> np.ndarray:
    """best over w neighbours from each place on (forward) or up to it; short at the end of the array."""
    out, span = x.copy(), 1
    while span < min(w, len(x)):
        step = min(span, w - span)
        if step >= len(x):
            break
        if forward:
            out[: len(x) - step] = best(out[: len(x) - step], out[step:].copy())
        else:
            out[step:] = best(out[step:], out[: len(x) - step].copy())
        span += step
    return out


def find_anchors(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: (text number, place in it, reach, anchor hash, context hash).

    An anchor's context is what the windows that have it span; reach packs the bytes of it before the anchor and
    those from it on (``sides``). starts: n+1 offsets. Long texts are scanned in pieces that overlap by more than a context.
    """
    out: list[list[np.ndarray]] = []
    lengths = np.diff(starts)
    todo: list[tuple[int, int, int]] = []  # text, from, to: which anchors to keep
    for i in np.flatnonzero(lengths >= WINDOW):
        n = int(lengths[i])
        todo += [(int(i), a, min(a + PIECE, n)) for a in range(0, n, PIECE)]
    k = 0
    while k < len(todo):
        group, size = [], 0
        while k < len(todo) and (not group or size + todo[k][2] - todo[k][1] <= PIECE):
            group.append(todo[k])
            size += todo[k][2] - todo[k][1] + 4 * WINDOW
            k += 1
        text = np.array([g[0] for g in group])
        keep_a, keep_b = np.array([g[1] for g in group]), np.array([g[2] for g in group])
        from_, to = np.maximum(0, keep_a - 2 * WINDOW), np.minimum(lengths[text], keep_b + 2 * WINDOW)
        b = raw[ragged(starts[text] + from_, to - from_)]
        piece = np.repeat(np.arange(len(group)), to - from_)
        first = np.cumsum(to - from_) - (to - from_)
        stop = (first + (to - from_))[piece]
        n = len(b)
        up, down = powers(n + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        g = np.full(n, np.uint64(2**64 - 1))
        if n >= GRAM:
            g[: n - GRAM + 1] = mix((total[GRAM:] - total[: n - GRAM + 1]) * down[: n - GRAM + 1]) >> np.uint64(1)
        places = np.arange(n)
        fits = places + GRAM <= stop
        g[~fits] = np.uint64(2**64 - 1)
        tables = [g]  # least of 1, 2, 4, ... grams from each place on
        for j in range(4):
            t = tables[-1].copy()
            if n > 1 << j:
                np.minimum(t[: -(1 << j)], tables[-1][1 << j :], out=t[: -(1 << j)])
            tables.append(t)
        least = tables[4].copy()
        if n > REACH - 15:
            np.minimum(least[: -(REACH - 15)], tables[4][REACH - 15 :], out=least[: -(REACH - 15)])
        least[places + WINDOW > stop] = 0
        chosen = np.flatnonzero((sliding(least, REACH + 1, np.maximum, False) == g) & fits)
        own = piece[chosen]
        at = chosen - first[own] + from_[own]
        inside = (at >= keep_a[own]) & (at < keep_b[own])
        chosen, own, at = chosen[inside], own[inside], at[inside]
        # an anchor's windows: no gram in them is less, so they are neighbours; from ``low`` to ``high`` bytes before it
        mine, before, after = g[chosen], np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
        for j in (4, 3, 2, 1, 0):
            from_left = chosen - before - (1 << j)
            before += (1 << j) * ((from_left >= 0) & (tables[j][np.maximum(from_left, 0)] >= mine))
            from_right = chosen + after + 1
            after += (1 << j) * ((from_right < n) & (tables[j][np.minimum(from_right, n - 1)] >= mine))
        high = np.minimum(np.minimum(before, REACH), chosen - first[own])
        low = np.maximum(np.maximum(REACH - after, chosen + WINDOW - stop[chosen]), 0)
        l, r = high, WINDOW - low
        context = (total[chosen + r] - total[chosen - l]) * down[chosen - l]
        context = mix(context + l.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + r.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        out.append([text[own], at, (l | r << 8).astype(np.uint16), mix(g[chosen]), context])
    if not out:
        return NOTHING, NOTHING, NOTHING.astype(np.uint16), NOTHING.view(np.uint64), NOTHING.view(np.uint64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(5))


def sides(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (reach & 255).astype(np.int64), (reach >> 8).astype(np.int64)


def by_target(target: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(target, places of its items, in order)"""
    order = np.argsort(target, kind="stable")
    ends = np.searchsorted(target[order], np.arange(n + 1))
    for t in np.flatnonzero(np.diff(ends)):
        yield int(t), order[ends[t] : ends[t + 1]]


def rows_of(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = zip(*found, strict=True) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["target", "kind", "payload"])


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(doc_id, row hash, bytes, offsets, the rows) of about ``most`` bytes of text at a time, or of one longer text."""
    for b in batches:
        doc = b.column(0).fill_null(NULL_ID).to_numpy()
        row = b.column(1).to_numpy()
        raw, starts = utf8_parts(b.column(2))
        i = 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, side="right")) - 1)
            j = min(j, len(doc))
            yield doc[i:j], row[i:j], raw[starts[i] : starts[j]], starts[i : j + 1] - starts[i], b.slice(i, j - i)
            i = j


def home(row: np.ndarray, n: int) -> np.ndarray:
    """The partition that holds a row's text."""
    return (mix(row.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def anchor_rows(n: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, row, raw, starts, _ in gathered(batches):
            text, at, reach, anchor, context = find_anchors(raw, starts)
            if not len(text):
                continue
            order = np.lexsort((doc[text], context, anchor))
            text, at, reach, anchor, context = (x[order] for x in (text, at, reach, anchor, context))
            d = doc[text]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]
            least = d[new][np.cumsum(new) - 1]
            known = d > least
            found = []
            k = np.flatnonzero(known)
            for t, some in by_target(home(row[text[k]], n), n):
                s = k[some]
                found.append((t, LOCAL, blobs.pack(doc[text[s]], row[text[s]], at[s].astype(np.uint32), reach[s])))
            k = np.flatnonzero(~known)
            for t, some in by_target(((anchor[k] >> np.uint64(32)) % np.uint64(n)).astype(np.int64), n):
                s = k[some]
                s = s[np.lexsort((at[s], text[s]))]
                found.append((t, ENTRIES, blobs.pack(doc, row, blobs.deltas(text[s].astype(np.uint32)), at[s].astype(np.uint32), reach[s], anchor[s].astype(np.uint32), context[s])))
            yield rows_of(found)

    return anchors


def entry_rows(n: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = defaultdict(list)
        local: dict[int, list[list[np.ndarray]]] = defaultdict(list)
        for b in batches:
            for target, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == LOCAL:
                    local[target].append(blobs.unpack(payload))
                    continue
                doc, row, text, at, reach, anchor, context = blobs.unpack(payload)
                text = np.cumsum(text, dtype=np.uint32)
                parts[target].append([doc[text], row[text], at, reach, anchor, context])
        yield rows_of([(t, FULL, blobs.pack(*blobs.joined(p, 4))) for t, p in local.items()])
        local.clear()
        for bucket in list(parts):
            doc, row, at, reach, anchor, context = blobs.joined(parts.pop(bucket), 6)
            order = np.lexsort((doc, context, anchor))
            doc, row, at, reach, anchor, context = (x[order] for x in (doc, row, at, reach, anchor, context))
            new_a = np.r_[True, anchor[1:] != anchor[:-1]]
            new_c = new_a.copy()
            new_c[1:] |= context[1:] != context[:-1]
            of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
            first_a = np.flatnonzero(new_a)
            full = doc > doc[new_c][of_c]
            several = np.add.reduceat(new_c.astype(np.int64), first_a) > 1
            several &= np.minimum.reduceat(doc, first_a) < np.maximum.reduceat(doc, first_a)
            asked = ~full & several[of_a]
            found = []
            k = np.flatnonzero(full)
            for t, some in by_target(home(row[k], n), n):
                s = k[some]
                found.append((t, FULL, blobs.pack(doc[s], row[s], at[s], reach[s])))
            k = np.flatnonzero(asked)
            group = (of_a[k].astype(np.int64)) | (np.int64(bucket) << np.int64(36))
            for t, some in by_target(home(row[k], n), n):
                s = k[some]
                found.append((t, ASKED, blobs.pack(doc[s], row[s], at[s], reach[s], group[some])))
            yield rows_of(found)

    return entries


def ipc(rows: pa.RecordBatch) -> np.ndarray:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_batch(rows)
    return np.frombuffer(out.getvalue(), np.uint8)


def text_rows(n: int):
    """Texts on their way to their partitions, with the rows' further columns, if any."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, row, raw, starts, own in gathered(batches):
            found = []
            for t, s in by_target(home(row, n), n):
                size = np.diff(starts)[s]
                more = ipc(own.select(own.schema.names[3:]).take(pa.array(s))) if own.num_columns > 3 else np.zeros(0, np.uint8)
                found.append((t, TEXTS, blobs.pack(doc[s], row[s], size, raw[ragged(starts[s], size)], more)))
            yield rows_of(found)

    return texts


class Held:
    """Items of rows by (doc_id, row hash), from packs of arrays that begin with these two."""

    def __init__(self, parts: list[list[np.ndarray]], k: int):
        arrays = blobs.joined(parts, k)
        order = np.lexsort((arrays[0], arrays[1])) if len(arrays[0]) else np.zeros(0, np.int64)
        self.arrays = [a[order] for a in arrays]

    def of(self, doc: int, row: int) -> list[np.ndarray]:
        d, r = self.arrays[:2]
        a, b = np.searchsorted(r, row, "left"), np.searchsorted(r, row, "right")
        own = slice(a + np.searchsorted(d[a:b], doc, "left"), a + np.searchsorted(d[a:b], doc, "right"))
        return [x[own] for x in self.arrays[2:]]


def texts_of(payload: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    doc, row, size, raw, _ = blobs.unpack(payload)
    at = 0
    for d, r, s in zip(doc.tolist(), row.tolist(), size.tolist(), strict=True):
        yield d, r, raw[at : at + s]
        at += s


def context_rows(n: int):
    """Rows come sorted by kind, so what is asked for is there before the texts."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held: Held | None = None
        # what is cut goes out in large rows, however small the packs of texts are
        cut: list[list[np.ndarray]] = []
        kept = 0

        def sent() -> pa.RecordBatch:
            doc, row, at, l, size, group, raw = blobs.joined(cut, 7)
            starts = np.cumsum(size) - size
            found = []
            for t, s in by_target(group >> np.int64(36), n):
                found.append((t, PARTS, blobs.pack(doc[s], row[s], at[s].astype(np.uint32), l[s].astype(np.uint8), size[s].astype(np.uint8), group[s], raw[ragged(starts[s], size[s])])))
            cut.clear()
            return rows_of(found)

        for b in batches:
            for _, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == ASKED:
                    parts.append(blobs.unpack(payload))
                elif kind == TEXTS:
                    held = held or Held(parts, 5)
                    for doc, row, raw in texts_of(payload):
                        at, reach, group = held.of(doc, row)
                        if not len(at):
                            continue
                        at = at.astype(np.int64)
                        l, r = sides(reach)
                        size = l + r
                        cut.append([np.full(len(at), doc), np.full(len(at), row), at, l, size, group, raw[ragged(at - l, size)]])
                        kept += int(size.sum()) + 32 * len(at)
                    if kept > SENT_BYTES:
                        yield sent()
                        kept = 0
        if cut:
            yield sent()

    return contexts


def repeats_in(doc: np.ndarray, group: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a smaller document of the same group has too: (context, offset of the window in it).

    Each group's contexts, with a mark after each, make one lane.
    """
    order = np.argsort(group, kind="stable")
    doc, starts, sizes, group_ = doc[order], starts[order], sizes[order], group[order]
    new = np.r_[True, group_[1:] != group_[:-1]]
    first = np.flatnonzero(new)
    lane_size = np.add.reduceat(sizes + 1, first)
    by_size = np.argsort(-lane_size, kind="stable")
    found_c, found_o = [], []
    k = 0
    while k < len(by_size):
        stop = k + max(1, int(np.searchsorted(np.cumsum(lane_size[by_size[k:]]), LANE_SYMBOLS, side="right")))
        lanes = by_size[k:stop]
        k = stop
        n_contexts = np.diff(np.r_[first, len(doc)])[lanes]
        contexts = ragged(first[lanes], n_contexts)
        size = sizes[contexts]
        symbols = np.ones(int((size + 1).sum()), np.int64)
        begin = np.cumsum(size + 1) - (size + 1)
        places = ragged(begin, size)
        symbols[places] = raw[ragged(starts[contexts], size)].astype(np.int64) + 2
        edges = np.r_[0, np.cumsum(lane_size[lanes])]
        symbols[edges[1:] - 1] = 0
        array = suffix_arrays(symbols, edges)
        of = np.repeat(np.arange(len(contexts)), size + 1)
        offset = np.arange(len(symbols)) - begin[of]
        whole = array[(offset + WINDOW <= size[of])[array]]
        lane_of = np.repeat(np.arange(len(lanes)), lane_size[lanes])
        if len(whole) < 2:
            continue
        a, b = whole[:-1], whole[1:]
        same = np.flatnonzero(lane_of[a] == lane_of[b])
        for i in range(WINDOW):
            same = same[symbols[a[same] + i] == symbols[b[same] + i]]
        starts_run = np.ones(len(whole), bool)
        starts_run[same + 1] = False
        run_first = np.flatnonzero(starts_run)
        d = doc[contexts][of[whole]]
        least = np.minimum.reduceat(d, run_first)[np.cumsum(starts_run) - 1]
        hit = whole[d > least]
        found_c.append(order[contexts[of[hit]]])
        found_o.append(offset[hit])
    if not found_c:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_c), np.concatenate(found_o)


def with_partner(group: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a context another of its group may share: from ``low`` to ``high`` bytes before the anchor.

    Windows that begin from ``a`` to ``b`` bytes before the anchor all hold the bytes from a before it to WINDOW - b
    after it, so contexts that share one agree there. A context that agrees with no other at any step of STEP
    beginnings has no repeat and needs no suffixes (low above high).
    """
    up, down = powers(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    lowest, highest = np.full(len(group), REACH + 1), np.full(len(group), -1)
    for a in range(0, REACH + 1, STEP):
        b = min(a + STEP - 1, REACH)
        fits = np.flatnonzero((l >= a) & (sizes - l >= WINDOW - b))
        first = starts[fits] + l[fits] - a
        key = mix((total[first + a + WINDOW - b] - total[first]) * down[first] + mix(group[fits].view(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        shared = np.zeros(len(fits), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        shared = fits[shared]
        lowest[shared] = np.minimum(lowest[shared], a)
        highest[shared] = b
    return lowest, highest


def split_large(doc: np.ndarray, group: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, l: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """What suffix arrays are to be built of, (context, group, start, size), and what is a copy: (context, start, size).

    Groups of more than ``most`` contexts are split. The windows of an anchor that begin from ``low`` to ``high``
    bytes before it all hold the bytes from low before it to WINDOW - high after it; so contexts are grouped anew by
    these bytes and cut to what such windows reach, down to one window. Cut contexts of a group that are equal are
    one: those of larger documents than the least are copies throughout. A context alone in its group has no repeat.
    """
    up, down = powers(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    done: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    copies: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    todo = [(np.arange(len(group)), np.unique(group, return_inverse=True)[1], 0, REACH)]
    base = 0
    while todo:
        c, g, low, high = todo.pop()
        from_ = starts[c] + l[c] - np.minimum(l[c], high)
        to = np.minimum(starts[c] + sizes[c], starts[c] + l[c] + WINDOW - low)
        key = mix((total[to] - total[from_]) * down[from_] + mix(g.astype(np.uint64)) + (to - from_).astype(np.uint64))
        order = np.lexsort((doc[c], key))
        key, d = key[order], doc[c[order]]
        new = np.r_[True, key[1:] != key[:-1]]
        copy = d > d[new][np.cumsum(new) - 1]
        k = order[copy]
        copies.append((c[k], from_[k], (to - from_)[k]))
        k = np.sort(order[~copy])
        c, g, from_, to = c[k], g[k], from_[k], to[k]
        count = np.bincount(g)[g]
        small = (count > 1) & ((count <= most) | (low == high))
        done.append((c[small], g[small] + base, from_[small], (to - from_)[small]))
        base += int(g.max(initial=0)) + 1
        large = (count > most) & (low < high)
        c, g = c[large], g[large]
        if not len(c):
            continue
        mid = (low + high) // 2
        for a, b in ((low, mid), (mid + 1, high)):
            fits = (l[c] >= a) & (sizes[c] - l[c] >= WINDOW - b)
            cc = c[fits]
            if len(cc):
                first = starts[cc] + l[cc] - a
                common = mix((total[first + a + WINDOW - b] - total[first]) * down[first] + mix(g[fits].astype(np.uint64)))
                todo.append((cc, np.unique(common, return_inverse=True)[1], a, b))
    return tuple(np.concatenate([d[i] for d in done]) for i in range(4)), tuple(np.concatenate([d[i] for d in copies]) for i in range(3))


def suffix_rows(n: int):
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for b in batches:
            parts += [blobs.unpack(p) for p in b.column(2).to_pylist()]
        if not parts:
            return
        doc, row, at, l, size, group, raw = blobs.joined(parts, 7)
        parts.clear()
        at, l, size = at.astype(np.int64), l.astype(np.int64), size.astype(np.int64)
        starts = np.cumsum(size) - size
        lowest, highest = with_partner(group, raw, starts, size, l)
        keep = lowest <= highest
        doc, row, at, l, size, group, starts, lowest, highest = (x[keep] for x in (doc, row, at, l, size, group, starts, lowest, highest))
        if not len(doc):
            return
        # what no partner reaches is cut off
        less = l - np.minimum(l, highest)
        size = np.minimum(size, l + WINDOW - lowest) - less
        l, starts = l - less, starts + less
        (context, sub, start, length), (copy, copy_start, copy_length) = split_large(doc, group, raw, starts, size, l, LANE)
        c, o = repeats_in(doc[context], sub, raw, start, length) if len(context) else (NOTHING, NOTHING)
        n_windows = np.maximum(copy_length - WINDOW + 1, 0)
        o = np.concatenate([o + (start - starts[context])[c], ragged(copy_start - starts[copy], n_windows)])
        c = np.concatenate([context[c], np.repeat(copy, n_windows)])
        order = np.lexsort((o, c))
        c, o = c[order], o[order]
        if not len(c):
            return
        new = np.r_[True, (c[1:] != c[:-1]) | (o[1:] > o[:-1] + 1)]  # several finds of one window don't matter
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(c)] - 1
        own = c[head]
        begin = at[own] - l[own] + o[head]
        end = at[own] - l[own] + o[tail] + WINDOW
        yield rows_of([(t, PARTS, blobs.pack(doc[own[s]], row[own[s]], begin[s], end[s])) for t, s in by_target(home(row[own], n), n)])

    return suffixes


def covered(anchors: np.ndarray, reach: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(from, to) of the maximal covered stretches."""
    anchors = anchors.astype(np.int64)
    l, r = sides(reach)
    a = np.concatenate([anchors - l, begin])
    b = np.concatenate([anchors + r, end])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    head = np.flatnonzero(new)
    return np.column_stack([a[head], b[np.r_[head[1:], len(a)] - 1]])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cover_rows(make):
    """make(payload, [(doc, bytes, removed bytes' places, number of stretches)]) gives the batch for one pack of texts."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[list[np.ndarray]] = []
        parts: list[list[np.ndarray]] = []
        held: tuple[Held, Held] | None = None
        for b in batches:
            for _, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == FULL:
                    full.append(blobs.unpack(payload))
                elif kind == PARTS:
                    parts.append(blobs.unpack(payload))
                else:
                    held = held or (Held(full, 4), Held(parts, 4))
                    out = []
                    for doc, row, raw in texts_of(payload):
                        anchors, reach = held[0].of(doc, row)
                        begin, end = held[1].of(doc, row)
                        gone, spans = NOTHING, 0
                        if len(anchors) or len(begin):
                            stretches = covered(anchors, reach, begin, end)
                            gone, spans = ragged(stretches[:, 0], stretches[:, 1] - stretches[:, 0]), len(stretches)
                        out.append((doc, raw, gone, spans))
                    yield make(payload, out)

    return cover


def digest_batch(_: bytes, found: list[tuple]) -> pa.RecordBatch:
    rows = []
    for doc, raw, gone, spans in found:
        kept = np.delete(raw, gone) if len(gone) else raw
        rows.append((None if doc == NULL_ID else doc, len(raw), len(gone), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def text_batch(payload: bytes, found: list[tuple]) -> pa.RecordBatch:
    """The rows with what is kept of their texts; a character that is cut in part goes whole."""
    texts = []
    for _, raw, gone, _ in found:
        if len(gone):
            char = np.cumsum((raw & 0xC0) != 0x80) - 1
            broken = np.zeros(int(char[-1]) + 1, bool)
            broken[char[gone]] = True
            raw = raw[~broken[char]]
        texts.append(raw.tobytes().decode())
    more = blobs.unpack(payload)[4]
    rows = pa.ipc.open_stream(more.tobytes()).read_next_batch()
    null = rows.column(rows.schema.names.index("_null"))
    changed = pa.array([len(f[2]) > 0 for f in found])
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string(), mask=null.to_numpy(zero_copy_only=False)), changed], names=["_more", "text", "_changed"])


def _run(rows: DataFrame, make, schema) -> DataFrame:
    """rows: _id, _row, _text and what else ``make`` puts out again."""
    spark = rows.sparkSession
    small_batches(spark)
    plain = rows.select("_id", "_row", "_text")
    n = blobs.partitions(plain, "_text")
    flags = stored(blobs.exchange(plain.mapInArrow(lean(anchor_rows(n)), blobs.ROW), n).mapInArrow(entry_rows(n), blobs.ROW), "flags")
    blobs.free_shuffles(spark)
    asked = blobs.exchange(flags.where(f"kind = {ASKED}").unionByName(plain.mapInArrow(lean(text_rows(n)), blobs.ROW)), n).sortWithinPartitions("kind")
    contexts = blobs.exchange(asked.mapInArrow(lean(context_rows(n)), blobs.ROW), n)
    more = stored(contexts.mapInArrow(lean(suffix_rows(n)), blobs.ROW), "repeats")
    blobs.free_shuffles(spark)
    full = flags.where(f"kind = {FULL}").selectExpr("target", "kind", "payload", "0 first")
    both = full.unionByName(more.selectExpr("target", "kind", "payload", "0 first"))
    both = both.unionByName(rows.mapInArrow(lean(text_rows(n)), blobs.ROW).selectExpr("target", "kind", "payload", "1 first"))
    return blobs.exchange(both, n).sortWithinPartitions("first").select("target", "kind", "payload").mapInArrow(lean(cover_rows(make)), schema)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _run(rows.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_row"), F.col("text").alias("_text")), digest_batch, RESULT)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut from the texts and n_chars, where there, counted anew.

    Texts that keep nothing stay as empty rows; null texts stay null.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    # the other columns are held in one, so that their names cannot clash with those made here
    rows = docs.select(id_.alias("_id"), F.xxhash64(id_, text).alias("_row"), text.alias("_text"), F.struct(*others).alias("_more"), F.col("text").isNull().alias("_null"))
    schema = StructType().add("_more", StructType([docs.schema[c] for c in others])).add("text", "string").add("_changed", "boolean")
    out = _run(rows, text_batch, schema)
    columns = []
    for c in docs.columns:
        own = F.col("text") if c == "text" else F.col("_more").getField(c)
        if c == "n_chars":
            own = F.when(F.col("_changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns)
