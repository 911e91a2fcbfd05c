"""Suffix arrays by linear grouping: Lyndon-prefix groups first, each group's inner order afterwards.

Phase one starts from one group per character and handles the groups in descending order. Every member of the
group at hand looks up its previous position in a lower group (pointers that skip what is already known to be no
lower). A position found by c members has its known prefix lengthened c times by the group's word and moves to a
new group right above its old one, ordered by c. At the end a group holds the suffixes that share their longest
Lyndon prefix, and groups are in order. Phase two goes through the suffixes in ascending order, the empty one
first: whatever position's Lyndon prefix ends where the current suffix begins is next in its own group. No renaming
and no recursion takes place. (Public algorithm: U. Baier, Linear-time suffix sorting, CPM 2016.)

``suffix_array`` does this for one string with lists; ``suffix_arrays`` does it for many short strings of one
length in lockstep, one group of each string per step, with NumPy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text) -> list[int]:
    """Positions of text (small non-negative ints) in the order of their suffixes."""
    codes = [int(c) for c in text]
    n = len(codes)
    if n == 0:
        return []
    order = sorted(range(n), key=codes.__getitem__)
    sa, place = order[:], [0] * n
    start, size = [0] * n, {}
    for i, p in enumerate(order):
        place[p] = i
        start[p] = i if i == 0 or codes[order[i - 1]] != codes[p] else start[order[i - 1]]
        size[start[p]] = size.get(start[p], 0) + 1
    word = [1] * n
    prev = list(range(-1, n - 1))
    end = n
    while end > 0:
        low = start[sa[end - 1]]
        members = sa[low:end]
        length = word[members[0]]
        found: dict[int, int] = {}
        for i in members:
            p = prev[i]
            while p >= 0 and start[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        by_group: dict[int, dict[int, list[int]]] = {}
        for p, c in found.items():
            by_group.setdefault(start[p], {}).setdefault(c, []).append(p)
        for g, levels in by_group.items():
            top = g + size[g]
            for c in sorted(levels, reverse=True):
                movers = levels[c]
                new = top - len(movers)
                for k, p in enumerate(movers):
                    here, there = place[p], new + k
                    # movers of higher levels are already above `top`; swap into the group's upper end
                    q = sa[there]
                    sa[here], sa[there] = q, p
                    place[q], place[p] = here, there
                for p in movers:
                    start[p] = new
                    word[p] += c * length
                size[new] = len(movers)
                top = new
            if top > g:
                size[g] = top - g
        end = low
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for p in range(n):
        ends[p + word[p]].append(p)
    out, fill = [0] * n, {}
    for step in range(-1, n - 1):
        for p in ends[n if step < 0 else out[step]]:
            g = start[p]
            k = fill.get(g, g)
            out[k] = p
            fill[g] = k + 1
    return out


def suffix_arrays(rows: np.ndarray) -> np.ndarray:
    """Row-wise suffix arrays of an integer matrix (values below 512); each row is a string of its own."""
    m, n = rows.shape
    out = np.zeros((m, n), np.int32)
    if m == 0 or n == 0:
        return out
    if n >= 1 << 15:
        raise ValueError("rows are too long for the lockstep form")
    base = (np.arange(m, dtype=np.int64) * n)[:, None]
    counts = np.bincount((np.arange(m)[:, None] * 513 + rows + 1).ravel(), minlength=m * 513).reshape(m, 513)
    start = np.take_along_axis(np.cumsum(counts, axis=1), rows.astype(np.int64), axis=1).astype(np.int16)
    size = np.zeros(m * (n + 1), np.int32)
    np.add.at(size, (np.arange(m)[:, None] * (n + 1) + start).ravel(), 1)
    start = np.ascontiguousarray(start).ravel()
    todo = start.copy().reshape(m, n)  # group of a position still to be handled, else -1
    flat_todo = todo.ravel()
    word = np.ones(m * n, np.int32)
    prev = (np.tile(np.arange(-1, n - 1), (m, 1)) + base).ravel()
    prev[::n] = -1
    while True:
        top = todo.max(axis=1)
        if top.max() < 0:
            break
        members = np.flatnonzero((todo == np.maximum(top, 0)[:, None]).ravel())
        line = members // n
        low = top[line]
        p = prev[members]
        open_ = np.flatnonzero(p >= 0)
        while len(open_):
            high = start[p[open_]] >= low[open_]
            open_ = open_[high]
            p[open_] = prev[p[open_]]
            open_ = open_[p[open_] >= 0]
        prev[members] = p
        length = word[members]
        flat_todo[members] = -1
        has = p >= 0
        if not has.any():
            continue
        parents, first, times = np.unique(p[has], return_index=True, return_counts=True)
        length = length[has][first]
        group = (parents // n) * (n + 1) + start[parents]
        order = np.lexsort((times, group))
        parents, group, times, length = parents[order], group[order], times[order], length[order]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_level = new_group | np.concatenate([[True], times[1:] != times[:-1]])
        g_at = np.flatnonzero(new_group)
        g_of = np.cumsum(new_group) - 1
        movers = np.diff(np.append(g_at, len(parents)))
        stay = size[group[g_at]] - movers  # members that keep the old start
        l_at = np.flatnonzero(new_level)
        l_of = np.cumsum(new_level) - 1
        new_start = (start[parents[l_at]] + stay[g_of[l_at]] + (l_at - g_at[g_of[l_at]])).astype(np.int16)
        size[group[g_at]] = stay
        size[(parents[l_at] // n) * (n + 1) + new_start] = np.diff(np.append(l_at, len(parents)))
        start[parents] = new_start[l_of]
        flat_todo[parents] = new_start[l_of]
        word[parents] += (times * length).astype(np.int32)
    # phase two; ends: positions by where their Lyndon prefix ends
    at = np.tile(np.arange(n), m)
    line = np.repeat(np.arange(m), n)
    target = line * (n + 1) + at + word
    by_end = np.argsort(target, kind="stable")
    head = np.searchsorted(target[by_end], np.arange(m * (n + 1) + 1))
    fill = np.tile(np.arange(n + 1), m)
    rows_at = np.arange(m) * (n + 1)
    flat = out.ravel()
    current = rows_at + n
    for step in range(n):
        lo, k = head[current], head[current + 1] - head[current]
        total = int(k.sum())
        if total:
            first = np.cumsum(k) - k
            who = by_end[np.repeat(lo - first, k) + np.arange(total)]
            l2 = line[who]
            slot = l2 * (n + 1) + start[who]
            flat[l2 * n + fill[slot]] = at[who]
            fill[slot] += 1
        current = rows_at + out[:, step]
    return out
