"""Paragraph MinHash banding: repeated and nearly repeated paragraphs across documents, cut but for the first.

Documents hold few natural paragraphs and shared passages lie within lines, so a paragraph ends at a line end or
where a word's hash is least within ``SIDE`` words on both sides of its line: passages that documents share are cut
alike from a few words on. Lines of fewer than ``LEAST_WORDS`` words that follow one another count as one line, so
that passages set in short lines are cut alike too. Paragraphs of fewer than ``LEAST_WORDS`` words, which are then
short lines between longer ones, are never cut out, nor are repeats of fewer than ``LEAST_RUN`` words in a row: stock
phrases stay, passages go.

1. each batch hashes its paragraphs. Copies within the batch are settled on the spot; of each content the first
   (least doc_id, then place) sends one entry a band (``BANDS`` of ``ROWS`` MinHash rows, for a recall above 0.99 at
   the threshold)
2. a band's entries meet in one partition; copies of a content, known by 64 bits of hash, are settled, but for the first. Bands of several
   contents ask for their paragraphs
3. the texts' partitions send the paragraphs asked for, as shingle sets
4. each band verifies the exact Jaccard similarity: it grows groups from a paragraph by all that are similar to it,
   to those, and so on, and puts out the links by which they were reached, so never all pairs
5. contents that are linked are classes, by components; all but a class's first paragraph are removed

Edge cases: null text counts as empty; texts without a long enough paragraph keep all; a null doc_id is smaller
than any other; repeated rows share doc_id and text, so all of them keep or lose the same, and their paragraphs are
no copies of one another's; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm import blobs, shingles
from provlake.llm.common import lean, mix, ragged, small_batches, stored
from provlake.llm.components import components
from provlake.llm.neardup import plain
from provlake.llm.suffix_dedup import NULL_ID, SENT_BYTES, TEXTS, Held, by_target, gathered, home, rows_of, sliding, text_rows, texts_of

SIMILARITY = 0.8
SIDE = 5
#: No piece within a line is shorter: the words of a shingle, and of the first piece that ``SIDE`` allows.
LEAST_WORDS = 5
LEAST_RUN = 16
BANDS, ROWS = 5, 2
#: Kinds of rows besides TEXTS; those of entries are their band's number. ASKED sorts before TEXTS.
ASKED, GONE, SETS = -1, 11, 12


def paragraphs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paragraphs of texts laid end to end: (text, number within it, first byte, byte after, first word, words),
    and the words' (paragraph, hash)."""
    text, begin, end, value = shingles.words(raw, starts)
    n = len(text)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z, z, np.zeros(0, np.uint64)
    lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    line = lines[begin]
    own = np.ones(n, bool)
    own[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    # short lines in a row are one
    head = np.flatnonzero(own)
    short = np.diff(np.r_[head, n]) < LEAST_WORDS
    joined = head[1:][short[1:] & short[:-1]]
    own[joined[text[joined] == text[joined - 1]]] = False
    row = np.cumsum(own) - 1
    # a word pair is least among its neighbours of the same line
    pair = mix(value * np.uint64(3) + np.r_[value[1:], [np.uint64(0)]]) >> np.uint64(1)
    least = sliding(pair, 2 * SIDE + 1, np.minimum, True)
    centre = np.zeros(n, bool)
    m = n - 2 * SIDE
    if m > 0:
        at = np.arange(SIDE, n - SIDE)
        inside = (row[at - SIDE] == row[at]) & (row[at + SIDE] == row[at])
        if SIDE + 1 < n:  # the pair of the last word looked at lies in the line as well
            after = np.minimum(at + SIDE + 1, n - 1)
            inside &= (row[after] == row[at]) & (at + SIDE + 1 < n)
        centre[at] = inside & (least[:m] == pair[at])
    new = own | centre
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    tail = np.r_[head[1:], n] - 1
    first_of_text = np.ones(len(head), bool)
    first_of_text[1:] = text[head[1:]] != text[head[:-1]]
    number = np.arange(len(head)) - np.flatnonzero(first_of_text)[np.cumsum(first_of_text) - 1]
    # a paragraph reaches up to the next one of its line, so nothing is left between
    stop = end[tail].copy()
    joins = np.flatnonzero(~own[np.minimum(tail + 1, n - 1)] & (tail + 1 < n))
    stop[joins] = begin[tail[joins] + 1]
    return text[head], number, begin[head], stop, head, tail - head + 1, of, value


def minhash_keys(own: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS) keys of the shingle sets; own ascends and has each of n."""
    head = np.searchsorted(own, np.arange(n))
    keys = np.zeros((n, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(n, np.uint64(band + 1))
        for r in range(ROWS):
            seed = np.uint64(((band * ROWS + r + 1) * 0x9E3779B97F4A7C15) % 2**64)
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(mix(shingle ^ seed), head))
        keys[:, band] = key
    return keys


def entry_rows(n: int):
    def paragraph_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, row, raw, starts, _ in gathered(batches):
            text, number, _, _, _, size, of, value = paragraphs(raw, starts)
            long = size >= LEAST_WORDS
            if not long.any():
                continue
            text, number = text[long], number[long]
            keep = long[of]
            of, value = (np.cumsum(long) - 1)[of[keep]], value[keep]
            m = len(text)
            content = shingles.content(of, value, m)
            order = np.lexsort((number, row[text], doc[text], content))
            c, d, r = content[order], doc[text[order]], row[text[order]]
            new = np.r_[True, c[1:] != c[:-1]]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            # of rows alike in doc_id and text each keeps its first
            again = ~new & ~((d == d[first]) & (r == r[first]) & (number[order] == number[order][first]))
            found = []
            k = order[again]
            for t, s in by_target(home(row[text[k]], n), n):
                found.append((t, GONE, blobs.pack(doc[text[k[s]]], row[text[k[s]]], number[k[s]])))
            k = np.sort(order[new])
            mine = np.zeros(m, bool)
            mine[k] = True
            words = mine[of]
            own, shingle = shingles.shingles((np.cumsum(mine) - 1)[of[words]], value[words], len(k))
            keys = minhash_keys(own, shingle, len(k))
            for band in range(BANDS):
                key = keys[:, band]
                for t, s in by_target(((key >> np.uint64(20)) % np.uint64(n)).astype(np.int64), n):
                    i = k[s]
                    found.append((t, band, blobs.pack(doc, row, blobs.deltas(text[i].astype(np.uint32)), number[i].astype(np.uint32), key[s], content[i] if band == 0 else content[i].astype(np.uint32))))
            yield rows_of(found)

    return paragraph_entries


def band_rows(n: int):
    """Settle copies (band 0) and ask for the paragraphs of bands with several contents."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[list[np.ndarray]]] = defaultdict(list)
        for b in batches:
            for target, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == GONE:
                    yield rows_of([(target, kind, payload)])
                    continue
                doc, row, text, number, key, content = blobs.unpack(payload)
                text = np.cumsum(text, dtype=np.uint32)
                parts[target, kind].append([doc[text], row[text], number, key, content])
        for target, band in list(parts):
            doc, row, number, key, content = blobs.joined(parts.pop((target, band)), 5)
            order = np.lexsort((number, row, doc, content, key))
            doc, row, number, key, content = (x[order] for x in (doc, row, number, key, content))
            new_k = np.r_[True, key[1:] != key[:-1]]
            new_c = new_k.copy()
            new_c[1:] |= content[1:] != content[:-1]
            found = []
            if band == 0:
                first = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
                again = np.flatnonzero(~new_c & ~((doc == doc[first]) & (row == row[first])))
                again = np.union1d(again, np.flatnonzero(~new_c & (doc == doc[first]) & (row == row[first]) & (number != number[first])))
                for t, s in by_target(home(row[again], n), n):
                    found.append((t, GONE, blobs.pack(doc[again[s]], row[again[s]], number[again[s]].astype(np.int64))))
            of_k = np.cumsum(new_k) - 1
            several = np.bincount(of_k[new_c]) > 1
            asked = np.flatnonzero(new_c & several[of_k])
            group = of_k[asked] * BANDS + band | (np.int64(target) << np.int64(36))
            for t, s in by_target(home(row[asked], n), n):
                k = asked[s]
                found.append((t, ASKED, blobs.pack(doc[k], row[k], number[k].astype(np.int64), group[s])))
            yield rows_of(found)

    return bands


def set_rows(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held: Held | None = None
        # what is cut goes out in large rows, however small the packs of texts are
        cut: list[list[np.ndarray]] = []
        kept = 0

        def sent() -> pa.RecordBatch:
            doc, row, number, content, group, size, shingle = blobs.joined(cut, 7)
            starts = np.cumsum(size) - size
            cut.clear()
            return rows_of(
                [(t, SETS, blobs.pack(doc[s], row[s], number[s], content[s], group[s], size[s].astype(np.uint32), shingle[ragged(starts[s], size[s])])) for t, s in by_target(group >> np.int64(36), n)]
            )

        for b in batches:
            for _, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == ASKED:
                    parts.append(blobs.unpack(payload))
                    continue
                held = held or Held(parts, 4)
                for doc, row, raw in texts_of(payload):
                    number, group = held.of(doc, row)
                    if not len(number):
                        continue
                    _, _, _, _, _, _, of, value = paragraphs(raw, np.array([0, len(raw)]))
                    m = int(of[-1]) + 1
                    content = shingles.content(of, value, m)
                    own, shingle = shingles.shingles(of, value, m)
                    begin = np.searchsorted(own, np.arange(m + 1))
                    size = (begin[1:] - begin[:-1])[number]
                    k = len(number)
                    cut.append([np.full(k, doc), np.full(k, row), number, content[number], group, size, shingle[ragged(begin[number], size)]])
                    kept += 8 * int(size.sum()) + 48 * k
                if kept > SENT_BYTES:
                    yield sent()
                    kept = 0
        if cut:
            yield sent()

    return sets


def similar_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join all similar sets of one group: grown breadth first, each set against all not yet reached."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        # sizes alone rule most out
        near = left[(np.minimum(sizes[left], sizes[i]) >= threshold * np.maximum(sizes[left], sizes[i]) - 1e-9)]
        if not len(near):
            continue
        hits = np.isin(flat[ragged(starts[near], sizes[near])], sets[i])
        common = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
        ok = near[common >= threshold * (sizes[near] + sizes[i] - common) - 1e-9]
        out += [(i, j) for j in ok.tolist()]
        queue += ok.tolist()
        left = np.setdiff1d(left, ok, assume_unique=True)
    return out


LINK = "a long, b long, a_doc long, a_row long, a_number long, b_doc long, b_row long, b_number long"


def link_rows(threshold: float):
    def set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [blobs.unpack(p) for b in batches for p in b.column(2).to_pylist()]
        if not parts:
            return
        doc, row, number, content, group, size, shingle = blobs.joined(parts, 7)
        size = size.astype(np.int64)
        starts = np.cumsum(size) - size
        order = np.argsort(group, kind="stable")
        head = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
        found: list[tuple[int, int]] = []
        for a, b in zip(head, np.r_[head[1:], len(order)], strict=True):
            own = order[a:b]
            _, distinct = np.unique(content[own], return_index=True)
            own = own[np.sort(distinct)]
            if len(own) > 1:
                sets = [np.unique(shingle[starts[i] : starts[i] + size[i]]) for i in own]
                found += [(own[i], own[j]) for i, j in similar_links(sets, threshold)]
        if found:
            x, y = np.array(found).T
            ids = content.view(np.int64)
            cols = [ids[x], ids[y], doc[x], row[x], number[x], doc[y], row[y], number[y]]
            names = ["a", "b", "a_doc", "a_row", "a_number", "b_doc", "b_row", "b_number"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return set_links


RESULT = "doc_id long, row long, n_bytes long, n_paragraphs long, n_gone long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def runs_of(gone: np.ndarray, size: np.ndarray, least_run: int = LEAST_RUN) -> np.ndarray:
    """Those of the repeated paragraphs that stand in a run of so many words; short paragraphs don't end a run."""
    if not len(gone):
        return gone
    long = np.cumsum(size >= LEAST_WORDS)
    run = np.cumsum(np.r_[True, np.diff(long[gone]) > 1]) - 1
    return gone[np.bincount(run, size[gone])[run] >= least_run]


def cut_rows(with_kept: bool, least_run: int = LEAST_RUN):
    def cut_paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held: Held | None = None
        for b in batches:
            for _, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == GONE:
                    parts.append(blobs.unpack(payload))
                    continue
                held = held or Held(parts, 3)
                out = []
                for doc, row, raw in texts_of(payload):
                    (gone,) = held.of(doc, row)
                    _, _, begin, end, _, size, _, _ = paragraphs(raw, np.array([0, len(raw)]))
                    kept, spans, removed, gone = raw, 0, 0, runs_of(np.unique(gone), size, least_run)
                    if len(gone):
                        a, z = begin[gone], end[gone]
                        keep = np.ones(len(raw), bool)
                        keep[ragged(a, z - a)] = False
                        kept, removed = raw[keep], int((z - a).sum())
                        spans = 1 + int((a[1:] > z[:-1]).sum())
                    kept = kept.tobytes()
                    out.append((None if doc == NULL_ID else doc, row, len(raw), len(begin), len(gone), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                kinds = (*[pa.int64()] * 7, pa.string(), pa.binary())
                names = ("doc_id", "row", "n_bytes", "n_paragraphs", "n_gone", "n_removed", "n_spans", "kept_sha256", "kept")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return cut_paragraphs


def gone_rows(n: int):
    """(doc, row, number) rows, sorted into packs for the texts' partitions."""

    def gone_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, row, number = (c.to_numpy() for c in b.columns)
                yield rows_of([(t, GONE, blobs.pack(doc[s], row[s], number[s])) for t, s in by_target(home(row, n), n)])

    return gone_packs


def dedup(docs: DataFrame, threshold: float = SIMILARITY, with_kept: bool = False, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, row, n_bytes, n_paragraphs, n_gone (paragraphs removed), n_removed (bytes), n_spans, kept_sha256, kept.

    ``row`` is xxhash64(doc_id, text); kept is null unless with_kept. Repeats of fewer than least_run words in a row stay; 0
    cuts all of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = plain(docs)
    n = blobs.partitions(rows)
    flags = stored(blobs.exchange(rows.mapInArrow(lean(entry_rows(n)), blobs.ROW), n).mapInArrow(band_rows(n), blobs.ROW), "flags")
    blobs.free_shuffles(spark)
    texts = rows.mapInArrow(lean(text_rows(n)), blobs.ROW)
    asked = flags.where(f"kind = {ASKED}").unionByName(texts)
    sets = blobs.exchange(blobs.exchange(asked, n).sortWithinPartitions("kind").mapInArrow(lean(set_rows(n)), blobs.ROW), n)
    links = stored(sets.mapInArrow(lean(link_rows(threshold)), LINK), "paragraph-links")
    blobs.free_shuffles(spark)
    gone = flags.where(f"kind = {GONE}")
    if not links.isEmpty():
        roots = components(links.select("a", "b"))
        nodes = links.selectExpr("a id", "a_doc doc", "a_row row", "a_number number").unionByName(links.selectExpr("b id", "b_doc doc", "b_row row", "b_number number")).distinct()
        nodes = stored(nodes.join(roots, "id"), "paragraph-nodes")
        first = nodes.groupBy("root").agg(F.min(F.struct("doc", "row", "number")).alias("first"))
        late = nodes.join(first, "root").where("struct(doc, row, number) <> first").select("doc", "row", "number")
        gone = gone.unionByName(late.mapInArrow(lean(gone_rows(n)), blobs.ROW))
    both = gone.selectExpr("target", "kind", "payload", "0 first").unionByName(texts.selectExpr("target", "kind", "payload", "1 first"))
    return blobs.exchange(both, n).sortWithinPartitions("first").select("target", "kind", "payload").mapInArrow(lean(cut_rows(with_kept, least_run)), RESULT)
