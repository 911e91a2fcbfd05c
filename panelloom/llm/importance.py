"""Quality selection by importance resampling: op6.

Two generative models over hashed word unigrams and bigrams are counted: of target texts (labelled of good quality and not
toxic) and of all raw texts. A document's log importance weight is the sum over its n-grams of the log ratio of the two;
documents are drawn without replacement in proportion to their weights by adding Gumbel noise and taking the top k.
(Public method: Xie et al., Data selection via importance resampling, 2023.)

The raw model counts all documents. The target model is fitted on at most `most_labelled` labelled rows, those of the
least id hashes: their ids travel to the executors, so their number is bounded. k is `fraction` of the documents with
text; by default the share of good quality among the labelled rows. The k-th key is found by counting keys in ever
finer intervals, so no task sorts all of them.

Defined results: null texts and texts without a word have weight 0 and are never drawn; a null id takes part like others
(its noise is that of no id); equal keys at the limit are all drawn; repeated rows get the same key; without labels all
texts are drawn; other columns are not looked at; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.runtime import scratch_for, ship_package

BUCKETS = 1 << 16


def ngrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the lower-cased words and pairs of words of rows lying back to back."""
    text = tc.LOWER[raw[off[0] : off[-1]]]
    starts, ends, first = tc.words_of(text, off - off[0], tc.SPACE_WORDS)
    words = tc.word_hashes(text, 0, len(text), starts, ends)
    row = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    pairs = tc.shingle_hashes(words, 2)
    whole = np.arange(len(pairs)) + 2 <= first[row[: len(pairs)] + 1]
    both = np.concatenate([words, tc.mix(pairs[whole] + np.uint64(1))])
    return np.concatenate([row, row[: len(pairs)][whole]]), (both >> np.uint64(64 - 16)).astype(np.int64)


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all texts and of the target texts; rows: text, target (0 or 1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy()
            raw, off = tc.string_buffers(batch.column(0))
            for lo, hi in tc.row_slices(off):
                row, bucket = ngrams(raw, off[lo : hi + 1])
                total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(bucket[target[lo + row] > 0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    summed = tc.mapped(rows, scan, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2 * BUCKETS rows at most
    out = np.zeros(2 * BUCKETS)
    for r in summed:
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], out[BUCKETS:]


def weights(frame: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labelled: int, seed: int) -> tuple[DataFrame, float]:
    """(id, n_ngrams, log_weight, key) of each row, and the share of good quality among the labelled rows."""
    spark = frame.sparkSession
    ship_package(spark)
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double")).alias("s")).first()["s"]
    good = labels.where(F.col(id_col).isNotNull() & (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col(id_col).cast("long").alias("__good"))
    good = good.distinct().orderBy(F.xxhash64("__good"), "__good").limit(most_labelled)
    own = frame.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t"))
    marked = own.where("__t is not null").join(F.broadcast(good), F.col("__id") == F.col("__good"), "left")
    raw, target = _counts(marked.select("__t", F.col("__good").isNotNull().cast("int").alias("g")))
    smooth = 1.0
    ratio = np.log((target + smooth) / (target.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS))
    if not target.sum():
        ratio[:] = 0
    model = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_, off = tc.string_buffers(batch.column(1))
            n, w = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi in tc.row_slices(off):
                row, bucket = ngrams(raw_, off[lo : hi + 1])
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                w[lo:hi] = np.bincount(row, weights=model.value[bucket], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(w)], names=["__id", "n_ngrams", "log_weight"])

    scored = tc.mapped(own, scan, "__id long, n_ngrams long, log_weight double")
    uniform = (F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = scored.withColumn("key", F.when(F.col("n_ngrams") > 0, F.col("log_weight") - F.log(-F.log(uniform))))
    return keyed, float(share) if share is not None else 1.0


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, rounds: int = 8) -> float:
    """A limit that at least k of the doubles in column `key` reach, and fewer than k reach beyond it, up to the resolution
    of doubles: counts in intervals, then in the interval that holds the limit, and so on."""
    row = keys.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    low, high, above = row["a"], row["b"], 0
    for _ in range(rounds):
        width = (high - low) / bins
        if not width > 0:
            break
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).cast("int")
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        counts = {r["slot"]: r["n"] for r in inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), ).collect()}
        for s in sorted(counts, reverse=True):
            if above + counts[s] >= k:
                low, high = low + s * width, low + (s + 1) * width
                break
            above += counts[s]
        if counts.get(s, 0) <= 1:
            break
    return low


def resample(
    frame: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float | None = None, most_labelled: int = 200_000, seed: int = 7
) -> DataFrame:
    """(id, n_ngrams, log_weight, key) of the documents drawn."""
    scratch = scratch_for(frame.sparkSession, "importance")
    made: list = []

    def build() -> DataFrame:
        keyed, share = weights(frame, labels, id_col, text_col, most_labelled, seed)
        made.append(share)
        return keyed

    keyed = scratch.save(build, "keys").where("key is not null")
    total = keyed.count()
    k = int(np.ceil((made[0] if fraction is None else fraction) * total))
    if k < total and total:
        keyed = keyed.where(F.col("key") >= kth_largest(keyed.select("key"), k))
    return keyed.withColumnRenamed("__id", id_col)
