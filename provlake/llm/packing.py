"""Best-fit packing of token sequences by bin completion.

A document's ids plus the end id are cut into pieces of at most ``capacity``; only the first piece may be
shorter, so all others fill a sequence alone. What is left is bin packing over piece lengths. There are at
most ``capacity`` different lengths, so the *histogram* of lengths is the whole problem: it is counted on the
cluster, solved on the driver, and the solution (runs of equal bins, bounded by the lengths and not by the
rows) is sent back and joined to the pieces by length and rank.

Edge cases: null text counts as empty and is packed as the end id alone; repeated rows are packed each; a null
doc_id is kept; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import lean, ragged, small_batches, stored, text_batches, vocabulary
from provlake.llm.tokens import cache_for, with_end

CAPACITY = 2048
END_ID = 0
#: Branchings that the search may try before it keeps the best packing found.
MOST_NODES = 4_000
#: Fillings that are put in order of tightness at a time; those that follow are tried as well.
LOOK_AHEAD = 24


# --- the packing itself, on a histogram of lengths -------------------------------------------------


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Bins needed at least: total length, or the bound that counts what cannot share a bin with the large."""
    n = np.zeros(capacity + 1, np.int64)
    for size, k in hist.items():
        n[size] = k
    count = np.concatenate([[0], np.cumsum(n)])  # count[i]: pieces shorter than i
    total = np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half = capacity // 2
    k = np.arange(1, half + 1)
    alone = count[-1] - count[capacity - k + 1]
    mid = count[capacity - k + 1] - count[half + 1]
    room = mid * capacity - (total[capacity - k + 1] - total[half + 1])
    need = total[half + 1] - total[k]
    bound = alone + mid + np.maximum(0, -(-(need - room) // capacity))
    return int(max(-(-total[-1] // capacity), bound.max(initial=0)))


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths in a bin, how many such bins)."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # of open_bins, ascending
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, bin_: tuple[int, ...], n: int) -> None:
        if room == 0:
            closed.append((bin_, n))
        else:
            if room not in open_bins:
                insort(rooms, room)
            at = open_bins.setdefault(room, {})
            at[bin_] = at.get(bin_, 0) + n

    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * size, (size,) * per, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[i]
            bin_, n = open_bins[room].popitem()
            if not open_bins[room]:
                del open_bins[room], rooms[i]
            per = room // size
            used = min(n, left // per)
            if used:
                put(room - per * size, bin_ + (size,) * per, used)
                left -= used * per
            if used < n and left and left < per:
                put(room - left * size, bin_ + (size,) * left, 1)
                used += 1
                left = 0
            if used < n:
                put(room, bin_, n - used)
    for at in open_bins.values():
        closed.extend(at.items())
    return closed


def completions(left: dict[int, int], sizes: list[int], largest: int, capacity: int) -> Iterator[tuple[int, ...] | None]:
    """All fillings of the bin that holds ``largest``, one by one, from the one of the largest pieces on.

    A filling is dominated if another one holds, in place of one of its pieces, a larger piece that still
    fits, or one piece more; or if the largest piece that fits is as long as all of it. Of those that come
    up, a dominated one is given as None, so that the caller can count it. ``sizes`` descend; ``left`` has the
    pieces of each and must be, whenever the next filling is asked for, what it was at first.
    """
    room = capacity - largest
    chosen: list[tuple[int, int]] = []  # place in sizes, how many
    total, top, reduced = 0, None, -1
    at = bisect_left(sizes, -room, key=int.__neg__)
    while True:
        for i in range(at, len(sizes)):
            if not room:
                break
            size = sizes[i]
            n = min(left[size] - (size == largest), room // size)
            if n > 0:
                chosen.append((i, n))
                room -= n * size
                total += n * size
        if top is None:
            top = sizes[chosen[0][0]] if chosen else 0
        if reduced < 0 or room < sizes[reduced]:
            fine = total > top or not chosen or sizes[chosen[0][0]] == top
            yield tuple(sizes[i] for i, n in chosen for _ in range(n)) if fine else None
        else:
            # one more of the reduced length fits, and with fewer of it still would
            while chosen and chosen[-1][0] >= reduced:
                i, n = chosen.pop()
                room += n * sizes[i]
                total -= n * sizes[i]
            yield None
        if not chosen:
            return
        i, n = chosen.pop()
        room += sizes[i]
        total -= sizes[i]
        if n > 1:
            chosen.append((i, n - 1))
        reduced, at = i, i + 1


def tightest(found: Iterator[tuple[int, ...] | None]) -> Iterator[tuple[int, ...] | None]:
    """The same, all of them, but of every ``LOOK_AHEAD`` that follow one another the tightest first."""
    while some := list(islice(found, LOOK_AHEAD)):
        yield from sorted((f for f in some if f is not None), key=lambda f: (-sum(f), len(f)))
        yield from (None for f in some if f is None)


def bin_completion(hist: dict[int, int], capacity: int = CAPACITY, most_nodes: int = MOST_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Branch and bound over fillings of the bin of the largest piece; equal bins are made many at a time.

    The incumbent starts as the best-fit packing, and each node offers another: its bins so far, completed by
    best fit. A node whose bins and waste so far cannot beat the incumbent is pruned. All fillings are branched
    on, each with every number of equal bins, the greatest first; a filling that a node has been through is not
    used again for that length below it. The search ends when the incumbent meets the lower bound, when nothing
    is left to try, so that it is optimal, or after ``most_nodes`` nodes.
    """
    hist = {s: n for s, n in hist.items() if n}
    full = [((capacity,), hist.pop(capacity))] if hist.get(capacity) else []
    best = best_fit(hist, capacity)
    count = sum(n for _, n in best)
    bound = lower_bound(hist, capacity)
    if count <= bound:
        return full + best
    total = sum(s * n for s, n in hist.items())
    sizes = sorted(hist, reverse=True)
    left = dict(hist)
    made: list[tuple[tuple[int, ...], int]] = []
    bins = waste = nodes = 0

    def branches(first: int, largest: int, done: set[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], int, int, set] | None]:
        """(bin, how many, first, done) of each child; None for a filling that is passed over."""
        for filling in tightest(completions(left, sizes[first:], largest, capacity)):
            if filling is None or filling in done:
                yield None
                continue
            done = done | {filling}
            bin_ = (largest, *filling)
            for times in range(min(left[s] // bin_.count(s) for s in set(bin_)), 0, -1):
                yield bin_, times, first, done

    def change(bin_: tuple[int, ...], times: int) -> None:
        for s in bin_:
            left[s] -= times

    stack = [branches(0, sizes[0], set())]
    while stack and nodes < most_nodes and count > bound:
        child = next(stack[-1], ())
        if child == ():
            stack.pop()
            if made:
                bin_, times = made.pop()
                change(bin_, -times)
                bins, waste = bins - times, waste - times * (capacity - sum(bin_))
            continue
        nodes += 1
        if child is None:
            continue
        bin_, times, first, done = child
        more = times * (capacity - sum(bin_))
        # waste bound: what is wasted so far cannot be used by the rest
        if -(-(total + waste + more) // capacity) >= count:
            continue
        change(bin_, times)
        rest = {s: n for s in sizes[first:] if (n := left[s])}
        tail = best_fit(rest, capacity)
        if bins + times + sum(n for _, n in tail) < count:
            best, count = [*made, (bin_, times), *tail], bins + times + sum(n for _, n in tail)
        if not rest or bins + times + lower_bound(rest, capacity) >= count:
            change(bin_, -times)
            continue
        made.append((bin_, times))
        bins, waste = bins + times, waste + more
        largest = next(iter(rest))
        stack.append(branches(sizes.index(largest, first), largest, done if largest == bin_[0] else set()))
    return full + best


def runs(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, count, first sequence, pieces per sequence, offset) of each run of equal pieces."""
    rank: dict[int, int] = {}
    out, first = [], 0
    for bin_, n in bins:
        at = 0
        for size in dict.fromkeys(bin_):
            per = bin_.count(size)
            r = rank.get(size, 0)
            out.append((size, r, per * n, first, per, at))
            rank[size] = r + per * n
            at += per * size
        first += n
    return out


# --- on the cluster --------------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids' bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache_for(vocab)
        for b in text_batches(batches):
            ids, starts = with_end(*words.encode_array(b.column(1)), end_id)
            n = np.diff(starts)
            number = -(-n // capacity)
            own = np.repeat(np.arange(len(n)), number)
            piece = ragged(np.zeros(len(n), np.int64), number)
            first = (n - 1) % capacity + 1  # only the first piece may be shorter
            start = np.where(piece == 0, 0, first[own] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[own], capacity)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            at = 4 * (starts[own] + start)
            places = list(zip(at.tolist(), (at + 4 * length).tolist(), strict=True))
            columns = [b.column(0).take(pa.array(own)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[i:j]) for i, j in places], pa.int64())]
            if with_ids:
                columns.append(pa.array([bytes(raw[i:j]) for i, j in places], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run, "tokens"), kind)


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, most_nodes: int = MOST_NODES) -> DataFrame:
    """Each piece with its sequence_id and its offset there, gapless from 0.

    with_ids adds the piece's ids (little-endian unsigned 32-bit). Ranks within a length are dealt in salted
    groups, so that a length which a third of all pieces have is no single task.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, vocab or vocabulary("byte_bpe_50k.json"), capacity, end_id, with_ids), "pieces")
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    salted = made.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = stored(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = runs(bin_completion(hist, capacity, most_nodes))
    from pyspark.sql import Window

    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_within", within).join(before.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_within") + F.col("_before"))
    # at most a few runs for each of the capacity's lengths: bounded, whatever the rows
    table = spark.createDataFrame(plan, "length long, _first long, _count long, _bin long, _per long, _at long")
    placed = ranked.join(F.broadcast(table), "length").where("_rank >= _first and _rank < _first + _count")
    j = F.col("_rank") - F.col("_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_bin") + F.floor(j / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (j % F.col("_per")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
