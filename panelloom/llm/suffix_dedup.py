"""Exact duplicate byte strings by suffix arrays: op10.

Runs of windows that share an anchor but differ in extent (see windows.py) are laid behind each other and
suffix-sorted by linear grouping (suffix_groups.py). Equal 50-byte strings are neighbours in that order; neighbours
are compared byte by byte, and all but those of the least document are removed.

Defined results: null text is empty; texts below the window's length keep all; a null id is compared with nothing;
rows of one id never remove from each other (only a smaller id does); repeated rows yield a row each; other columns
are not looked at; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.llm import windows as wn
from panelloom.llm.suffix_groups import suffix_array, suffix_arrays
from panelloom.runtime import scratch_for, ship_package

#: Up to this length groups are suffix-sorted in lockstep with others of like length.
LOCKSTEP = 600
#: Cells of one lockstep matrix.
CELLS = 1 << 19


def suffix_matcher(window: int, anchor: int) -> wn.Matcher:
    """Finds equal windows of runs that share an anchor, through one suffix array per anchor."""

    def match(ext: list[bytes], doc: np.ndarray, kh: np.ndarray, eh: np.ndarray, nw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # equal extents of one document are looked at once
        head = np.ones(len(kh), bool)
        head[1:] = (kh[1:] != kh[:-1]) | (eh[1:] != eh[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        run, where = distinct([ext[i] for i in at], doc[at], kh[at], off[at])
        copies = np.diff(np.append(at, len(kh)))[run]
        first = np.repeat(at[run], copies)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(copies) - copies, copies)
        return first + nth, np.repeat(where, copies)

    def distinct(ext: list[bytes], doc: np.ndarray, kh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(kh), bool)
        new[1:] = kh[1:] != kh[:-1]
        group = np.cumsum(new) - 1
        left, right = _reach(ext, group, off, window, anchor)
        alive = left + right >= window - anchor
        low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        high = np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group[alive], doc[alive])
        np.maximum.at(high, group[alive], doc[alive])
        alive &= (low < high)[group]
        rows = np.flatnonzero(alive)
        if not len(rows):
            return none
        # what lies beyond the reach of all others is in no common window; what is equal then is one string
        begin, end = (off - left)[rows].tolist(), (off + anchor + right)[rows].tolist()
        known: dict[tuple, int] = {}
        owner = np.array([known.setdefault((g, ext[i][a:b]), len(known)) for g, i, a, b in zip(group[rows].tolist(), rows.tolist(), begin, end, strict=True)])
        strings = [x for _, x in known]
        of_group = np.array([g for g, _ in known])
        count = np.array([len(x) for x in strings]) - window + 1
        base = np.cumsum(count) - count
        owned = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owned, owner, doc[rows])
        least = np.repeat(owned, count)  # the least document that has a window, by string and window
        _sorted_windows(strings, of_group, owned, count, base, least, window)
        many = count[owner]
        flat = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        hit = np.repeat(doc[rows], many) > least[np.repeat(base[owner], many) + flat]
        return np.repeat(rows, many)[hit], (flat + np.repeat(begin, many))[hit]

    return match


def _sorted_windows(strings: list[bytes], group: np.ndarray, doc: np.ndarray, count: np.ndarray, base: np.ndarray, least: np.ndarray, window: int) -> None:
    """Suffix-sort the strings of each group that has several, and lower `least` to what equal windows have."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    bounds = np.append(cut, len(group))
    total = np.add.reduceat(count + window, cut)
    order = np.argsort(total, kind="stable")
    order = order[np.diff(bounds)[order] > 1]

    def settle(sa: np.ndarray, text: np.ndarray, whose: np.ndarray, at: np.ndarray) -> None:
        who, where, low = _equal_neighbours(sa, text, whose, at, count, doc, window)
        least[base[who] + where] = np.minimum(least[base[who] + where], low)

    i = 0
    while i < len(order):
        n = int(total[order[i]])
        if n > LOCKSTEP:
            rows = np.arange(bounds[order[i]], bounds[order[i] + 1])
            text, whose, at = _laid_out([strings[r] for r in rows], rows, n)
            sa = np.array(suffix_array(text.astype(np.int64)), np.int64)[None, :]
            settle(sa, text[None, :], whose[None, :], at[None, :])
            i += 1
            continue
        j = i
        while j < len(order) and total[order[j]] <= min(LOCKSTEP, n + 24) and (j - i + 1) * total[order[j]] <= CELLS:
            j += 1
        j = max(j, i + 1)
        width = int(total[order[j - 1]])
        laid = [_laid_out([strings[r] for r in rows], rows, width) for rows in (np.arange(bounds[g], bounds[g + 1]) for g in order[i:j])]
        text, whose, at = (np.stack(x) for x in zip(*laid, strict=True))
        settle(suffix_arrays(text), text, whose, at)
        i = j


def _reach(ext: list[bytes], group: np.ndarray, off: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """How far, left and right of the anchor, a run agrees at most with another one of its group.

    In the order of the sides' bytes the most similar one is a neighbour.
    """
    side = window - anchor
    width = -(-side // 8) * 8
    out = []
    for is_left in (True, False):
        if is_left:
            parts = [x[:o][::-1] for x, o in zip(ext, off.tolist(), strict=True)]
        else:
            parts = [x[o + anchor :] for x, o in zip(ext, off.tolist(), strict=True)]
        length = np.array([len(x) for x in parts])
        bytes_ = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in parts]), np.uint8).reshape(-1, width)
        keys = bytes_.view(">u8").astype(np.uint64)
        order = np.lexsort((*keys.T[::-1], group))
        equal = bytes_[order[1:]] == bytes_[order[:-1]]
        common = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        common[group[order[1:]] != group[order[:-1]]] = 0
        reach = np.zeros(len(ext), np.int64)
        reach[order[1:]] = common
        reach[order[:-1]] = np.maximum(reach[order[:-1]], common)
        out.append(np.minimum(reach, length))
    return out[0], out[1]


def _laid_out(ext: list[bytes], rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The extents behind each other, a 0 after each; and the run and the place in it of each position (-1: none)."""
    text, whose, at = np.zeros(width, np.int16), np.full(width, -1), np.full(width, -1)
    p = 0
    for r, x in zip(rows.tolist(), ext, strict=True):
        q = p + len(x)
        text[p:q] = np.frombuffer(x, np.uint8).astype(np.int16) + 1
        whose[p:q] = r
        at[p:q] = np.arange(len(x))
        p = q + 1
    return text, whose, at


def _equal_neighbours(
    sa: np.ndarray, text: np.ndarray, whose: np.ndarray, at: np.ndarray, count: np.ndarray, doc: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window, least document of its equals) of all windows, from the order of the suffixes."""
    m, n = text.shape
    flat = (sa + (np.arange(m) * n)[:, None]).ravel()
    line = np.repeat(np.arange(m), n)
    who, where = whose.ravel()[flat], at.ravel()[flat]
    starts = (who >= 0) & (where < count[np.maximum(who, 0)])
    flat, who, where, line = flat[starts], who[starts], where[starts], line[starts]
    views = np.lib.stride_tricks.sliding_window_view(text.ravel(), window)
    new = np.ones(len(flat), bool)
    new[1:] = line[1:] != line[:-1]
    for lo in range(1, len(flat), 1 << 16):  # in pieces: each compares window bytes per position
        hi = min(lo + (1 << 16), len(flat))
        new[lo:hi] |= (views[flat[lo:hi]] != views[flat[lo - 1 : hi - 1]]).any(axis=1)
    first = np.flatnonzero(new)
    return who, where, np.minimum.reduceat(doc[who], first)[np.cumsum(new) - 1]


def remove_repeated_bytes(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, anchor: int = 18) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): each byte goes that a `window`-byte string covers which also starts in a
    row of smaller id. spans: the maximal removed runs as [start, end); kept: the bytes that stay."""
    spark = frame.sparkSession
    ship_package(spark)
    units = wn.Units(words=False, window=window, anchor=anchor)
    scratch = scratch_for(spark, "suffixdedup")
    docs = wn.usable(frame, id_col, text_col)
    found = scratch.save(lambda: wn.compare_runs(wn.runs(docs, units)), "runs")
    asked = found.where(wn.kind() == wn.REQUEST)
    fetched = scratch.save(lambda: wn.extents(docs, asked, units), "extents")
    spans = scratch.save(lambda: wn.matched_windows(fetched, suffix_matcher(window, anchor), units), "spans")
    both = wn.covered_spans(found, units).unionByName(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tc.string_buffers(batch.column(2))
            sizes, removed, lists, kept = [], [], [], []
            for i, gone in enumerate(wn.span_lists(batch.column(3))):
                text = raw[off[i] : off[i + 1]]
                edges = [0, *gone.ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
                removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                lists.append(gone.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "spans", "kept"],
            )

    out = tc.mapped(wn.with_spans(docs, both), cut, "doc long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    return out.withColumnRenamed("doc", id_col)
