"""Aggregation passes over a planned panel: per-key arrays that add up.

A pass reads each row once, whatever the number of folds, recipes or models: workers turn Arrow batches into NumPy arrays
and keep one small array per key (sums, counts, triangular factors); these are merged by key on the executors and come to
the driver as a few kilobytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelloom.runtime import ship_package

Parts = dict[tuple, np.ndarray]


@dataclass(frozen=True)
class Batch:
    """y: target or NaN; roles: rows x splits (0 none, 1 train, 2 test); numbers: rows x numeric columns, NaN if missing;
    texts: one object array per categorical column, None if missing."""

    y: np.ndarray
    roles: np.ndarray
    numbers: np.ndarray
    texts: list[np.ndarray]


@dataclass(frozen=True)
class Layout:
    """How a frame's columns make a Batch."""

    splits: int
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return ["__y", *(f"__r{k}" for k in range(self.splits)), *(f"__n{k}" for k in range(len(self.numeric))), *(f"__c{k}" for k in range(len(self.categorical)))]

    def batch(self, rows: pa.RecordBatch) -> Batch:
        real = lambda c: c.cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: E731  null becomes NaN
        at = 1 + self.splits
        roles = [rows.column(1 + k).to_numpy(zero_copy_only=False) for k in range(self.splits)]
        numbers = [real(rows.column(at + k)) for k in range(len(self.numeric))]
        texts = [np.array(rows.column(at + len(self.numeric) + k).to_pylist(), dtype=object) for k in range(len(self.categorical))]
        n = rows.num_rows
        return Batch(real(rows.column(0)), np.stack(roles, axis=1), np.stack(numbers, axis=1) if numbers else np.zeros((n, 0)), texts)


def add(key: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge two arrays of one key, by the key's first word."""
    kind = key[0]
    if kind == "R":  # triangular factors: the factor of both on top of each other
        return triangle(np.vstack([a, b]))
    if kind == "min":
        return np.minimum(a, b)
    if kind == "max":
        return np.maximum(a, b)
    return a + b


def triangle(block: np.ndarray) -> np.ndarray:
    """The R factor of a block, square."""
    p = block.shape[1]
    r = np.linalg.qr(block, mode="r")
    return r if len(r) == p else np.vstack([r, np.zeros((p - len(r), p))])


#: Partial results of a key that are merged at once.
MERGED = 1024


def run_pass(frame: DataFrame, layout: Layout, work: Callable[[Batch], Parts]) -> Parts:
    """Merge work(batch) over all rows."""
    ship_package(frame.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Parts = {}
        for rows in batches:
            if rows.num_rows:
                for key, value in work(layout.batch(rows)).items():
                    total[key] = add(key, total[key], value) if key in total else value
        if total:
            keys = [pickle.dumps(k) for k in total]
            part = pa.array([TaskContext.get().partitionId() // MERGED] * len(keys), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([pickle.dumps(v) for v in total.values()], pa.binary()), part], names=["k", "v", "part"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        key = pickle.loads(group["k"].iloc[0])
        total = None
        for value in sorted(group["v"]):  # one order, however the rows came
            part = pickle.loads(value)
            total = part if total is None else add(key, total, part)
        return pd.DataFrame({"k": [group["k"].iloc[0]], "v": [pickle.dumps(total)], "part": [group["part"].iloc[0] // MERGED]})

    schema = "k binary, v binary, part int"
    parts = frame.select(*layout.columns).mapInArrow(scan, schema)
    # no more than MERGED arrays of a key meet in a task; the driver adds the few that are left
    merged = parts.groupBy("k", "part").applyInPandas(merge, schema)
    if int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) > MERGED:
        merged = merged.groupBy("k", "part").applyInPandas(merge, schema)
    out: Parts = {}
    for r in sorted(merged.collect(), key=lambda r: (bytes(r["k"]), r["part"])):
        key, value = pickle.loads(bytes(r["k"])), pickle.loads(bytes(r["v"]))
        out[key] = add(key, out[key], value) if key in out else value
    return out


#: Bits per round of a selection by histograms.
ROUND_BITS = 13


def sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order."""
    bits = (values + 0.0).view(np.uint64)  # -0.0 becomes 0.0
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def unsortable(code: int) -> float:
    bits = code & ~(1 << 63) if code >> 63 else ~code & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def order_statistics(frame: DataFrame, layout: Layout, values: Callable[[Batch], dict[tuple, np.ndarray]], wanted: dict[tuple, list[int]]) -> dict[tuple, list[float]]:
    """Exact values at 0-based ranks, by key. values: the finite values of each key in a batch.

    Radix selection: each round counts the next bits of those values that share the bits found so far, so no task holds
    or sorts all values of a key.
    """
    jobs = [(key, k, rank) for key, ranks in wanted.items() for k, rank in enumerate(ranks)]
    state = {(key, k): (0, rank) for key, k, rank in jobs}
    done = 0
    while done < 64 and jobs:
        bits = min(ROUND_BITS, 64 - done)
        groups: dict[tuple, set[int]] = {}
        for (key, _), (prefix, _) in state.items():
            groups.setdefault(key, set()).add(prefix)
        shift, low = 64 - done - bits, (1 << bits) - 1

        def count(batch: Batch, groups=groups, shift=shift, bits=bits, low=low) -> Parts:
            out: Parts = {}
            for key, own in values(batch).items():
                if key in groups:
                    code = sortable(own) >> np.uint64(shift)
                    head = code >> np.uint64(bits)
                    for prefix in groups[key]:
                        here = code[head == np.uint64(prefix)]
                        out["sum", key, prefix] = np.bincount((here & np.uint64(low)).astype(np.int64), minlength=low + 1)
            return out

        counts = run_pass(frame, layout, count)
        for key, k, _ in jobs:
            prefix, rank = state[key, k]
            total = np.cumsum(counts["sum", key, prefix])
            slot = int(np.searchsorted(total, rank, side="right"))
            state[key, k] = (prefix << bits | slot, rank - (int(total[slot - 1]) if slot else 0))
        done += bits
    return {key: [unsortable(state[key, k][0]) for k in range(len(ranks))] for key, ranks in wanted.items()}


def quantile_ranks(count: int, shares: list[float]) -> list[int]:
    """Ranks that linear interpolation between order statistics needs: two for each share."""
    out = []
    for s in shares:
        low = int(np.floor((count - 1) * s))
        out += [low, min(low + 1, count - 1)]
    return out


def interpolate(count: int, shares: list[float], at_ranks: list[float]) -> list[float]:
    """Quantiles from the values at quantile_ranks."""
    out = []
    for k, s in enumerate(shares):
        place = (count - 1) * s
        t = place - np.floor(place)
        a, b = at_ranks[2 * k : 2 * k + 2]
        out.append(float(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)))
    return out
