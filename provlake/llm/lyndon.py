"""Suffix arrays by linear grouping, for many strings at a time.

Suffixes are grouped by their Lyndon prefix. Groups are taken in descending order: each member's
previous-smaller pointer goes to the nearest place before it whose group is lower, and the suffixes pointed at are
moved, by how often, to new groups right above their old ones. The order within groups is then emitted in one
ascending sweep: when a suffix gets its rank, the unplaced suffixes on the pointer chain that begins just before
it take the next free ranks of their groups. Nothing is renamed and nothing recurses; work is linear in the symbols.

All strings ("lanes") run in step: one array operation takes the current group of every lane, or the current rank
of every lane, so interpreter time is shared by all lanes.
"""

from __future__ import annotations

import numpy as np

from provlake.llm.common import ragged


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix array of each lane, as places in ``symbols``, lane after lane.

    symbols: all lanes' symbols, each lane ending in its only 0; starts: the lanes' first places and, last, the end.
    """
    n, lanes = len(symbols), len(starts) - 1
    starts = np.asarray(starts, np.int64)
    if not lanes:
        return np.zeros(0, np.int64)
    lane_of = np.repeat(np.arange(lanes), np.diff(starts))
    span = int(symbols.max()) + 1
    key = lane_of * span + symbols
    at = np.argsort(key, kind="stable")  # at[rank place] = suffix
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    sorted_key = key[at]
    first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    sizes = np.diff(np.r_[first, n])
    group = np.empty(n, np.int64)  # a group is named by its first rank place
    group[at] = np.repeat(first, sizes)
    size = np.zeros(n + 1, np.int64)
    size[first] = sizes
    start_of_end = np.zeros(n + 1, np.int64)
    start_of_end[first + sizes - 1] = first

    previous = _group_all(n, starts, lane_of, at, place, group, size, start_of_end)
    return _emit(n, starts, group, previous)


def _group_all(n, starts, lane_of, at, place, group, size, start_of_end) -> np.ndarray:
    """Refine groups in place, in descending order; returns the previous-smaller pointers (-1: none)."""
    none = n  # stands for "outside the lane"
    left = np.arange(-1, n, dtype=np.int64)
    right = np.arange(1, n + 2, dtype=np.int64)
    left[starts[:-1]] = none
    right[starts[1:] - 1] = none
    group_at = np.append(group, -1)  # the outside is in no group
    previous = np.full(n, -1, np.int64)
    count = np.zeros(n, np.int64)
    seen = np.zeros(n, np.int64)
    moved = np.zeros(n, bool)
    low = starts[:-1].copy()
    cursor = starts[1:] - 1
    while len(cursor):
        g = start_of_end[cursor]
        n_members = cursor - g + 1
        members = np.sort(at[ragged(g, n_members)])
        # members that stand next to each other in what is left are one run, with one pointer
        before = left[members]
        new_run = np.ones(len(members), bool)
        new_run[1:] = before[1:] != members[:-1]
        head = np.flatnonzero(new_run)
        p = before[head]
        q = right[members[np.append(head[1:], len(members)) - 1]]
        right[p] = q
        left[q] = p
        p = p[np.cumsum(new_run) - 1]
        inside = p != none
        to = p[inside]
        previous[members[inside]] = to
        cursor = g - 1
        alive = cursor >= low
        if not alive.all():
            cursor, low = cursor[alive], low[alive]
        if not len(to):
            continue
        # the suffixes pointed at, once each, and how often
        ones = np.arange(len(to))
        seen[to] = ones
        np.add.at(count, to, 1)
        up = to[seen[to] == ones]
        often = count[up]
        count[up] = 0
        old = group_at[up]
        order = np.lexsort((-often, old)) if len(up) > 1 else np.zeros(1, np.int64)
        up, often, old = up[order], often[order], old[order]
        new_old = np.r_[True, old[1:] != old[:-1]]
        head = np.flatnonzero(new_old)
        n_up = np.diff(np.r_[head, len(up)])
        groups = old[head]
        end = groups + size[groups]
        # those in the way at the old groups' ends change places with those that move
        tail = end - n_up
        moved[up] = True
        held = at[ragged(tail, n_up)]
        stay = held[~moved[held]]
        moved[up] = False
        if len(stay):
            was = place[up]
            vacant = was[was < np.repeat(tail, n_up)]
            at[vacant] = stay
            place[stay] = vacant
        within = np.arange(len(up)) - np.repeat(head, n_up)
        put = np.repeat(end, n_up) - 1 - within
        at[put] = up
        place[up] = put
        # one new group for each number of pointers; more pointers stand higher
        new_class = new_old.copy()
        new_class[1:] |= often[1:] != often[:-1]
        class_head = np.flatnonzero(new_class)
        class_size = np.diff(np.r_[class_head, len(up)])
        class_start = put[class_head] - class_size + 1
        group_at[up] = np.repeat(class_start, class_size)
        rest = size[groups] - n_up
        size[groups] = rest
        size[class_start] = class_size
        start_of_end[class_start + class_size - 1] = class_start
        some = rest > 0
        start_of_end[(groups + rest - 1)[some]] = groups[some]
    group[:] = group_at[:-1]
    return previous


def _emit(n, starts, group, previous) -> np.ndarray:
    """Ranks in ascending order, one rank of every lane at a time."""
    out = np.full(n, -1, np.int64)
    free = np.arange(n + 1, dtype=np.int64)  # next free rank place of a group
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    before = np.append(np.where(previous < 0, n, previous), n)
    prior = np.arange(-1, n - 1, dtype=np.int64)
    prior[starts[:-1]] = n
    lengths = np.diff(starts)
    by_length = np.argsort(-lengths, kind="stable")
    first, ordered = starts[:-1][by_length], lengths[by_length]
    last = starts[1:] - 1  # the lane's 0 is its least suffix
    out[starts[:-1]] = last
    placed[last] = True
    longest = int(ordered[0])
    lanes_of_rank = np.searchsorted(-ordered, -np.arange(longest), side="left")
    for r in range(longest):
        j = prior[out[first[: lanes_of_rank[r]] + r]]
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
            j = j[~placed[j]]
    return out
