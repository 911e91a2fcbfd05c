"""Best-fit packing of token sequences by a configuration linear program: op1.

1. Executors tokenize whole texts and cut only what is longer than `capacity`; what is kept of a piece is its length,
   place and checksum (and the ids, if wanted).
2. The driver gets the histogram of lengths: at most `capacity` numbers, whatever the input. A configuration is a
   multiset of lengths that fits a sequence. The covering program over all configurations is solved fractionally by
   multiplicative weights: a knapsack dynamic program prices configurations, those near the best price grow together,
   and the weights of the lengths that they cover shrink. The solution is rounded down, and only the residue goes
   best fit or greedily into sequences, on the histogram. Of that and of best fit for the whole histogram the plan of
   the fewer sequences is taken.
3. Executors number the pieces of each length (counts by length and bucket give offsets, so no task sees all pieces of
   a length) and look up the place of each number.

Defined results: null text is empty, so its document is the end id alone; rows with a null id are packed like others;
repeated rows are packed each; other columns are not looked at; an empty table yields no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.runtime import scratch_for, ship_package

#: Texts below this code point tokenize alike in both libraries (tested); the faster one takes them.
SAFE_LIMIT = 0x250
_LOADED: dict = {}


def encoders(vocabulary: str):
    """(fast, exact): functions from a text to its ids, for texts below SAFE_LIMIT and for all. Both give what the
    vocabulary's tokenizer gives as it is: an added token's content within a text is that token."""
    if vocabulary not in _LOADED:
        import base64
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as definition:
            added = [x["content"] for x in json.load(definition)["added_tokens"]]
        whole: list = []

        def exact(text: str) -> list[int]:
            if not whole:
                whole.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return whole[0].encode(text, add_special_tokens=False).ids

        def ranks_only(text: str) -> list[int]:
            # an added token's content is one id, which the ranks do not know
            return exact(text) if any(x in text for x in added) else fast.encode_ordinary(text)

        _LOADED[vocabulary] = ranks_only, exact
    return _LOADED[vocabulary]


def tokenize(text: str, vocabulary: str) -> list[int]:
    fast, exact = encoders(vocabulary)
    return fast(text) if text.isascii() or max(text) < chr(SAFE_LIMIT) else exact(text)


def pieces(frame: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, end_id: int, with_ids: bool) -> DataFrame:
    """(doc, piece, start, length, crc[, ids]) of the texts' ids and the end id, cut into pieces of `capacity` from the
    end, so that the first one may be shorter."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*tokenize(text.as_py() or "", vocabulary), end_id], np.uint32)
                n = len(ids)
                first = n % capacity or capacity if n > capacity else n
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    own = ids[a:b].astype("<u4").tobytes()
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(own), ids[a:b].astype(np.int64).tolist() if with_ids else None), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if with_ids else 5], names=["doc", "piece", "start", "length", "crc", "ids"][: 6 if with_ids else 5])

    own = frame.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return tc.mapped(own, scan, "doc long, piece int, start long, length int, crc long" + (", ids array<long>" if with_ids else ""))


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the greatest value among those that fill most of the capacity: an unbounded knapsack,
    solved by dynamic programming over exact fillings."""
    best, take = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        options = best[c - lengths[:k]] + value[:k]
        top = int(np.argmax(options))
        best[c], take[c] = options[top], top
    out: dict[int, int] = {}
    c = int(np.flatnonzero(best > -np.inf)[-1])
    while c > 0:
        length = int(lengths[take[c]])
        out[length] = out.get(length, 0) + 1
        c -= length
    return out


def configuration(value: np.ndarray, lengths: np.ndarray, left: dict[int, int], capacity: int) -> dict[int, int]:
    """The priced configuration within what the histogram still has: a length that would be overdrawn is taken as often
    as it is there, and the rest of the sequence priced without it."""
    out: dict[int, int] = {}
    while capacity > 0 and len(lengths):
        chosen = price(value, lengths, capacity)
        over = {n for n, k in chosen.items() if k > left[n]}
        if not over:
            for n, k in chosen.items():
                out[n] = k
            break
        for n in over:
            out[n] = left[n]
            capacity -= n * left[n]
        keep = np.array([int(n) not in over for n in lengths], bool)
        value, lengths = value[keep], lengths[keep]
    return out


def greedy(histogram: dict[int, int], capacity: int, rounds: int = 400, rate: float = 0.7) -> list[tuple[int, dict[int, int]]]:
    """Priced configurations in whole numbers as long as they fill sequences, then best fit: for what rounding leaves."""
    left = dict(sorted(histogram.items()))
    done: list[tuple[int, dict[int, int]]] = []
    # a length's dual price is its share of a sequence times its weight: at first large pieces weigh a little more, as
    # small ones fill gaps later on; weights shrink with what is covered
    weight = {n: 1 + 0.1 * n / capacity for n in left}
    for _ in range(rounds):
        lengths = np.array([n for n, k in left.items() if k > 0], np.int64)
        if not len(lengths):
            break
        value = lengths / capacity * np.array([weight[int(n)] for n in lengths])
        chosen = configuration(value, lengths, left, capacity)
        if sum(n * k for n, k in chosen.items()) < capacity:
            break  # the rest fills no sequence at these prices
        times = max(1, int(min(left[n] // k for n, k in chosen.items()) * rate))
        done.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= times * k
            weight[n] *= float(np.exp(-rate * 0.1 * times * k / histogram[n]))
    return done + best_fit(left, capacity)


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): by room, the greatest value that fits and the length that its filling ends with, 0 if it is that of
    less room. value[n] is that of length n, -inf if there is none."""
    capacity = len(value) - 1
    back = value[:0:-1].copy()
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = back[capacity - c :] + best[:c]
        k = int(options.argmax())
        if options[k] > best[c - 1]:
            best[c], last[c] = options[k], c - k
        else:
            best[c] = best[c - 1]
    return best, last


def dual_bound(histogram: dict[int, int], price: np.ndarray) -> float:
    """What no packing, even a fractional one, goes below: the histogram's worth over the best configuration's."""
    return sum(k * float(price[n]) for n, k in histogram.items()) / float(knapsack(price)[0][-1])


def fractional(histogram: dict[int, int], capacity: int, limit: int = 8000) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """([(times, {length: count})], bound): a fractional solution of the covering program over all configurations, full
    or not, and the greatest dual bound met. In each step the known configurations within `gap` of the best price grow
    together, and prices shrink by exp(-eta * coverage); every 40 steps, or when none is that near, the knapsack prices
    all configurations anew, and the best one through each length that lags behind is known from then on. Ends when
    every length is covered; after `limit` steps the rest stays uncovered. The fewer lengths, the finer the steps: a step
    costs time in proportion to the lengths, and takes eta to be about 15,000 over their number."""
    lengths = np.array(sorted(histogram), np.int64)
    have = np.array([histogram[int(n)] for n in lengths], float)
    m, rng = len(lengths), np.random.default_rng(0)
    eta = min(150.0, max(8.0, 15000 / m))
    gap = 0.05 if eta > 15 else 0.1
    marks = rng.integers(1, 1 << 62, capacity + 1)
    at = np.zeros(capacity + 1, np.int64)
    at[lengths] = np.arange(m)
    col, row, count = (np.zeros(0, np.int64) for _ in range(3))
    x, base = np.zeros(0), np.zeros(0)
    known: set[int] = set()
    covered, bound, top = np.zeros(m), 0.0, np.inf
    for step in range(limit):
        if covered.min() >= 1:
            break
        price = lengths / capacity * np.exp(-eta * (covered - covered.min()))
        worth = np.bincount(col, price[row] * count, len(x))
        if step % 40 == 0 or worth.max() < (1 - gap) * top:
            value = np.full(capacity + 1, -np.inf)
            value[lengths] = price
            if step % 80 == 0:
                bound = max(bound, dual_bound(histogram, value))
            else:
                value[lengths] *= 1 - gap / 2 * rng.random(m)  # other fillings of about the same price
            best, last = knapsack(value)
            top = float(best[capacity])
            # the best configuration through each length that lags behind, where it is near the best of all
            first = lengths[(value[lengths] + best[capacity - lengths] >= (1 - gap) * top) & (covered <= covered.mean())]
            stop = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))
            room, mark, held = stop[capacity - first], marks[first], [(np.arange(len(first)), first)]
            live = np.flatnonzero(room > 0)
            while len(live):
                taken = last[room[live]]
                held.append((live, taken))
                mark[live] += marks[taken]
                room[live] = stop[room[live] - taken]
                live = live[room[live] > 0]
            fresh = {k: i for i, k in enumerate(mark.tolist()) if k not in known}
            known.update(fresh)
            place = np.full(len(first), -1)
            place[list(fresh.values())] = len(x) + np.arange(len(fresh))
            which, taken = place[np.concatenate([a for a, _ in held])], at[np.concatenate([b for _, b in held])]
            pairs, n = np.unique(which[which >= 0] * m + taken[which >= 0], return_counts=True)
            col, row, count = np.concatenate([col, pairs // m]), np.concatenate([row, pairs % m]), np.concatenate([count, n])
            x = np.concatenate([x, np.zeros(len(fresh))])
            base = np.full(len(x), np.inf)
            np.minimum.at(base, col, have[row] / count)
            worth = np.bincount(col, price[row] * count, len(x))
        # in proportion to what they have; new ones begin with a little of their scarcest length
        grow = np.where(worth >= (1 - gap) * min(top, worth.max()), x + base * 0.01 * max(float(covered.mean()), 1e-3), 0)
        more = np.bincount(row, grow[col] * count, m) / have
        size = 0.5 / (eta * more.max())
        x += size * grow
        covered += size * more
    out: list[tuple[float, dict[int, int]]] = [(t, {}) for t in (x / max(1.0, float(covered.min()))).tolist()]
    for c, r, k in zip(col.tolist(), row.tolist(), count.tolist(), strict=True):
        out[c][1][int(lengths[r])] = k
    return [group for group in out if group[0] > 0], bound


def rounded(solution: list[tuple[float, dict[int, int]]], histogram: dict[int, int]) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """The solution rounded down, no more of a length than there is, and the histogram of what is left."""
    left, done = dict(histogram), []
    for amount, held in sorted(solution, key=lambda g: -g[0]):
        times = min(int(amount + 1e-9), *(left[n] // k for n, k in held.items()))
        if times > 0:
            done.append((times, held))
            for n, k in held.items():
                left[n] -= times * k
    return done, {n: k for n, k in left.items() if k > 0}


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) such that the configurations hold the histogram exactly: the program's solution rounded
    down and its residue best fit, or best fit alone where that takes fewer sequences; and where neither is within a
    thousandth of the dual bound, the residue is also tried greedily."""
    left = {n: k for n, k in sorted(histogram.items()) if k > 0}
    whole: list[tuple[int, dict[int, int]]] = []
    if left.get(capacity):
        whole.append((left.pop(capacity), {capacity: 1}))
    if not left:
        return whole

    def sequences(plan: list[tuple[int, dict[int, int]]]) -> int:
        return sum(times for times, _ in plan)

    solution, bound = fractional(left, capacity)
    done, residue = rounded(solution, left)
    plans = [done + best_fit(residue, capacity), best_fit(left, capacity)]
    if min(map(sequences, plans)) > np.ceil(bound * 1.001 - 1e-6):  # else no packing of the residue saves more than a thousandth
        plans.append(done + greedy(residue, capacity))
    return whole + min(plans, key=sequences)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Longest first, each into the fullest sequences that it fits; equal sequences are kept as one entry."""
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in sorted((n for n, k in histogram.items() if k > 0), reverse=True):
        count = histogram[length]
        for free in sorted(r for r in room if r >= length):
            groups = room.pop(free)
            while groups and count:
                times, held = groups.pop()
                each = free // length
                whole = min(times, count // each)
                if whole:
                    room.setdefault(free - each * length, []).append((whole, {**held, length: each}))
                    count -= whole * each
                    times -= whole
                if times and 0 < count < each:
                    room.setdefault(free - count * length, []).append((1, {**held, length: count}))
                    count, times = 0, times - 1
                if times:
                    groups.append((times, held))
            if groups:
                room.setdefault(free, []).extend(groups)
            if not count:
                break
        if count:
            each = capacity // length
            if count // each:
                room.setdefault(capacity - each * length, []).append((count // each, {length: each}))
            if count % each:
                room.setdefault(capacity - count % each * length, []).append((1, {length: count % each}))
    return [group for groups in room.values() for group in groups]


class _Places:
    """For the r-th piece of a length: its sequence and offset. A row for each length of each configuration: some tens of
    bytes times the configurations that the solver came to know, whatever the input."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        rows, base, seen = [], 0, {}
        for times, held in plan:
            offset = 0
            for length in sorted(held, reverse=True):
                k = held[length]
                begin = seen.get(length, 0)
                rows.append((length, begin, k, base, offset))
                seen[length] = begin + times * k
                offset += k * length
            base += times
        table = np.array(rows, np.int64).reshape(-1, 5)
        key = table[:, 0] * (1 << 48) + table[:, 1]
        order = np.argsort(key)
        self.key, self.base = key[order], table[order, 3]
        self.each, self.offset = table[order, 2].astype(np.int32), table[order, 4].astype(np.int32)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * (1 << 48) + rank, side="right") - 1
        nth = rank - (self.key[at] & ((1 << 48) - 1))
        return self.base[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def pack(
    frame: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    vocabulary: str = "byte_bpe_50k",
    end_id: int = 0,
    with_ids: bool = False,
    bucket_rows: int = 1 << 18,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece once, sequences without gaps.

    The pieces of a length are numbered in buckets of about `bucket_rows`, however many there are."""
    spark = frame.sparkSession
    ship_package(spark)
    scratch = scratch_for(spark, "packing")
    cut = scratch.save(lambda: pieces(frame, id_col, text_col, capacity, vocabulary, end_id, with_ids), "pieces")
    # at most `capacity` numbers
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = {n: -(-k // bucket_rows) for n, k in histogram.items() if k > bucket_rows}
    part = F.pmod(F.xxhash64("doc", "piece", "crc", "start"), F.col("parts"))
    of_length = F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair])[F.col("length")] if buckets else F.lit(None)
    cut = cut.withColumn("parts", F.coalesce(of_length, F.lit(1)).cast("long")).withColumn("bucket", part).drop("parts")
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    places = spark.sparkContext.broadcast(_Places(solve(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "piece", "crc", "start"))
    ranked = cut.withColumn("own", own).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    fields = ["doc", "piece", "start", "length", "crc", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, "sequence_id", "offset"])

    schema = "doc long, piece int, start long, length long, crc long, " + ("ids array<long>, " if with_ids else "") + "sequence_id long, offset long"
    dealt = ranked.select(*[F.col(c).cast("long") if c == "length" else F.col(c) for c in fields], "rank")
    out = tc.mapped(dealt, place, schema)
    names = [F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"]
    return out.select(*names, *(["ids"] if with_ids else []))
