"""Benchmark decontamination by greedy string tiling: op8.

Words are lower-cased runs of letters and digits. Documents and benchmark items that share a seed (`seed` words in a
row; an item of fewer words is its own seed) are compared: running Karp-Rabin finds the greatest length at which
unmarked words match, all matches of that length that do not overlap are marked in one sweep over the text, and so on
until none of `seed` words is left. The words of an item that its tiles cover, over its words, is the coverage. Tiles may
stand in any order in the document, so an item whose parts have been moved about is caught. No two places are listed as
a pair: a sweep looks at each place of the text once, and an item of n words takes sqrt(2n) sweeps at most, however often
words repeat.

The benchmark travels to the executors in parts of at most `part_bytes`; a benchmark beyond that takes more than one
pass over the documents, each written before the next part is sent, never a larger broadcast.

Defined results: null and empty texts match nothing, on either side; rows with a null id yield results with a null id;
repeated rows yield each of their results again; `worst_items` takes rows of one id and text as one document; of several items the one of the highest coverage, then of the least item_id, is named;
empty tables yield no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.runtime import scratch_for, ship_package


def word_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each row's first word."""
    text = tc.LOWER[raw[off[0] : off[-1]]]
    starts, ends, first = tc.words_of(text, off - off[0], tc.ALNUM_WORDS)
    return tc.word_hashes(text, 0, len(text), starts, ends), first


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words) of the tiles: longest first, of equal ones the first in the text, then in the
    item."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    high = min(len(item), len(text))
    while high >= least and len(_meeting(item, text, free_i, free_t, least)[1]):
        # the greatest length at which unmarked windows meet: where a longer one does, so do its parts
        low = least
        while low < high:
            middle = min(2 * low, (low + high + 1) // 2)
            if len(_meeting(item, text, free_i, free_t, middle)[1]):
                low = middle
            else:
                high = middle - 1
        new = _sweep(item, text, free_i, free_t, low)
        for i, t in new:
            free_i[i : i + low] = False
            free_t[t : t + low] = False
        tiles += [(i, t, low) for i, t in new]
        high = low if new else low - 1  # without a tile the hashes met but not the words
    return sorted(tiles)


def _meeting(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, size: int) -> tuple[dict[int, list[int]], np.ndarray, np.ndarray]:
    """(places in the item by hash, places in the text whose windows have one of these hashes, their hashes)."""
    (at_i, hash_i), (at_t, hash_t) = _windows(item, free_i, size), _windows(text, free_t, size)
    hit = np.isin(hash_t, hash_i)
    places: dict[int, list[int]] = {}
    if hit.any():
        for i, h in zip(at_i.tolist()[::-1], hash_i.tolist()[::-1], strict=True):
            places.setdefault(h, []).append(i)
    return places, at_t[hit], hash_t[hit]


def _sweep(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(place in item, place in text) of equal windows that overlap on neither side, from left to right."""
    places, at, hashes = _meeting(item, text, free_i, free_t, size)
    taken = np.zeros(len(item), bool)
    out, end = [], 0
    for t, h in zip(at.tolist(), hashes.tolist(), strict=True):
        own = places.get(h)
        if t < end or not own:
            continue
        while own:  # places that a tile has taken are never free again
            i = own.pop()
            if not taken[i] and not taken[i + size - 1]:
                if (item[i : i + size] == text[t : t + size]).all():
                    out.append((i, t))
                    taken[i : i + size] = True
                    end = t + size
                else:
                    own.append(i)
                break
    return out


def _windows(codes: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and rolling hashes of the windows of `size` unmarked words."""
    if len(codes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marked[size:] == marked[:-size])
    return at, tc.gram_hashes(tc.prefix_hash(codes), size)[at]


class _Items:
    """A part of the benchmark: words of the items and their seeds."""

    def __init__(self, ids: list, texts: list[str], seed: int):
        raw, off = tc.string_buffers(pa.array(texts, pa.string()))
        codes, first = word_codes(raw, off) if len(texts) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.seed = seed
        self.ids, self.words = [], []
        by_size: dict[int, dict[int, list[int]]] = {}
        for i, x in enumerate(ids):
            own = codes[first[i] : first[i + 1]]
            if len(own):
                k = min(seed, len(own))
                for h in np.unique(tc.shingle_hashes(own, k)).tolist():
                    by_size.setdefault(k, {}).setdefault(h, []).append(len(self.ids))
                self.ids.append(x)
                self.words.append(own)
        self.seeds = {}
        for k, table in by_size.items():
            keys = np.array(sorted(table), np.uint64)
            self.seeds[k] = keys, [table[h] for h in keys.tolist()]


def _compare(docs: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in batches:
            raw, off = tc.string_buffers(batch.column(1))
            found = []
            for lo, hi in tc.row_slices(off):
                codes, first = word_codes(raw, off[lo : hi + 1])
                pairs: set[tuple[int, int]] = set()
                for k, (keys, owners) in part.seeds.items():
                    grams = tc.shingle_hashes(codes, k)
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == grams)
                    row = np.searchsorted(first, hit, side="right") - 1
                    inside = hit + k <= first[row + 1]
                    both = np.unique(np.stack([row[inside], at[hit[inside]]], axis=1), axis=0)
                    for r, s in both.tolist():
                        pairs.update((r, j) for j in owners[s])
                for r, j in sorted(pairs):
                    item, text = part.words[j], codes[first[r] : first[r + 1]]
                    tiles = greedy_tiles(item, text, min(part.seed, len(item)))
                    covered = sum(k for *_, k in tiles)
                    if covered >= threshold * len(item):
                        found.append((lo + r, part.ids[j], covered / len(item), [list(x) for x in tiles]))
            if found:
                rows, ids, cover, tiles = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        batch.column(2).take(pa.array(rows)),
                        pa.array(ids, pa.int64()),
                        pa.array(cover, pa.float64()),
                        pa.array(tiles, pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=["doc", "h", "item_id", "coverage", "tiles"],
                )

    return tc.mapped(docs, scan, "doc long, h long, item_id long, coverage double, tiles array<array<long>>")


def contaminated(
    frame: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seed: int = 5,
    threshold: float = 0.5,
    part_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, item_id, coverage, tiles) of the documents in which tiles cover at least `threshold` of an item's words:
    one row per document and item. tiles: [place in item, place in text, words]."""
    spark = frame.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // part_bytes))
    docs = frame.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    docs = docs.where("text is not null").withColumn("h", F.xxhash64("text"))
    scratch = scratch_for(spark, "stringtiling") if parts > 1 else None
    out = None
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).orderBy("i").collect()
        shared = spark.sparkContext.broadcast(_Items([r["i"] for r in own], [r["t"] for r in own], seed))
        one = _compare(docs, shared, threshold)
        if scratch:
            one = scratch.save(lambda one=one: one, "part")
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("doc").alias(id_col), F.col("h").alias("text_hash"), "item_id", "coverage", "tiles")


def worst_items(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per contaminated document (id and text): the item it covers most, and how many it covers."""
    w = Window.partitionBy(id_col, "text_hash").orderBy(F.desc("coverage"), "item_id")
    n = F.size(F.collect_set("item_id").over(Window.partitionBy(id_col, "text_hash"))).alias("n_items")
    ranked = found.select(id_col, "text_hash", "item_id", "coverage", F.size("tiles").alias("n_tiles"), n, F.row_number().over(w).alias("k"))
    return ranked.where("k = 1").drop("k")
