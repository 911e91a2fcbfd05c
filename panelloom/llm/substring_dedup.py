"""Incremental removal of repeated word windows through a log-structured fingerprint index: op4.

Documents arrive in batches of ascending id. The index is a set of immutable runs: tables bucketed by fingerprint (the
anchor's hash; see windows.py) and sorted by it within each bucket. A new batch's anchors are bucketed likewise and
merge-joined with every run where it lies, without moving or sorting it again; what matches meets the batch: equal
extents are covered, extents that share the anchor only are verified word by word. The batch's new extents become a run of
their own, and runs are compacted into one when there are more than `max_runs`. No batch reads the texts of earlier ones
except to verify.

Defined results: null text has no words and keeps the empty text; texts below the window's length keep all; a null id is
compared with nothing; rows of one id never remove from each other (only a smaller id does); repeated rows yield a row
each; an empty table yields no rows; other columns are not looked at, and those named in `keep` come back with their row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.llm import windows as wn
from panelloom.runtime import Scratch, scratch_for, ship_package


def word_matcher(units: wn.Units) -> wn.Matcher:
    """Finds equal windows of runs that share an anchor by their words."""

    def match(ext: list[bytes], doc: np.ndarray, kh: np.ndarray, eh: np.ndarray, nw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run, window = [], []
        lo = 0
        while lo < len(kh):
            hi = int(np.searchsorted(kh, kh[lo], side="right"))
            if int(doc[lo:hi].min()) != int(doc[lo:hi].max()):
                least: dict[bytes, int] = {}
                listed = [list(wn.content_windows(ext[r], units, int(nw[r]))) for r in range(lo, hi)]
                for r, own in enumerate(listed, lo):
                    d = int(doc[r])
                    for w in own:
                        if least.get(w, d) >= d:
                            least[w] = d
                for r, own in enumerate(listed, lo):
                    d = int(doc[r])
                    for i, w in enumerate(own):
                        if least[w] < d:
                            run.append(r)
                            window.append(i)
            lo = hi
        return np.array(run, np.int64), np.array(window, np.int64)

    return match


class FingerprintIndex:
    """Sorted immutable runs of (anchor, extent, least document, place) and what the batches so far have yielded."""

    def __init__(self, scratch: Scratch, max_runs: int = 2):
        self.scratch, self.max_runs = scratch, max_runs
        self.runs: list[DataFrame] = []
        self.found: list[DataFrame] = []
        self._pending: DataFrame | None = None  # the last batch's new extents, a run once another batch comes
        self.compactions = 0

    def add(self, make: Callable[[], DataFrame], first_new: int) -> DataFrame:
        """Merge a batch, whose ids are first_new and above, with the index; the rows of compare_runs for it."""
        records = self.scratch.save(make, "records")
        self._settle()
        matching = [self.matching(run, records) for run in self.runs]
        found = self.scratch.save(lambda: wn.compare_runs(functools.reduce(DataFrame.unionByName, matching, records), first_new), "found")
        self.found.append(found)
        # markers stay with the run: its hot anchors are dealt by extent
        new = found.where(wn.kind() == wn.CLASS).withColumn("mark", F.col("mark") + (wn.RECORD - wn.CLASS))
        self._pending = new.unionByName(records.where(wn.kind() == wn.MARKER))
        return found

    @staticmethod
    def matching(run: DataFrame, records: DataFrame) -> DataFrame:
        """The rows of a run whose anchors a batch has: a merge join in the run's order."""
        anchors = records.where(wn.kind() != wn.COVERED).select("kh").distinct()
        return run.join(anchors.hint("merge"), "kh", "left_semi")

    def _settle(self) -> None:
        if self._pending is not None:
            pending, self._pending = self._pending, None
            self.runs.append(self.scratch.save_sorted(lambda: pending, "kh", ["kh", "eh"], "run"))
            if len(self.runs) > self.max_runs:
                self.compact()

    def compact(self) -> None:
        """Write all runs as one. Their extents differ, so compaction merges and never has to choose."""
        runs = self.runs
        self.runs = [self.scratch.save_sorted(lambda: functools.reduce(DataFrame.unionByName, runs), "kh", ["kh", "eh"], "compacted")]
        self.compactions += 1


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """First ids of up to `batches` parts of about equal counts (the first part begins at the least id)."""
    shares = [i / batches for i in range(1, batches)]
    row = docs.where("doc is not null").agg(F.min("doc").alias("low"), F.percentile_approx("doc", shares or [0.5], 1000).alias("cuts")).first()
    if row is None or row["low"] is None:
        return []
    return sorted({row["low"], *(row["cuts"] if shares else [])})


def remove_repeated_words(
    frame: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    anchor: int = 25,
    batches: int = 4,
    max_runs: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, the columns `keep`, n_words, n_removed, spans, left_over): each word goes that a `window`-word window covers which
    also starts in a row of smaller id. spans: the maximal removed runs of words as [start, end); left_over: the words that
    stay, joined by one space. batches: parts, by id, that the index takes in one after another; any number gives the same
    result."""
    spark = frame.sparkSession
    ship_package(spark)
    units = wn.Units(words=True, window=window, anchor=anchor)
    scratch = scratch_for(spark, "substringdedup")
    docs = wn.usable(frame, id_col, text_col)
    index = FingerprintIndex(scratch, max_runs)
    bounds = batch_bounds(docs, batches) or [0]
    for low, high in zip(bounds, [*bounds[1:], None], strict=True):
        part = docs.where(F.col("doc") >= low)
        part = part if high is None else part.where(F.col("doc") < high)
        index.add(lambda part=part: wn.runs(part, units), low)
    found = functools.reduce(DataFrame.unionByName, index.found)
    asked = found.where(wn.kind() == wn.REQUEST).distinct()
    fetched = scratch.save(lambda: wn.extents(docs, asked, units), "extents")
    spans = scratch.save(lambda: wn.matched_windows(fetched, word_matcher(units), units), "spans")
    both = wn.covered_spans(found, units).unionByName(spans)
    whole = wn.usable(frame, id_col, text_col, keep)
    kept_names = [f"__k{i}" for i in range(len(keep))]

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            raw, off = tc.string_buffers(batch.column(2))
            counts, removed, lists, kept = [], [], [], []
            for i, gone in enumerate(wn.span_lists(batch.column(3))):
                words = raw[off[i] : off[i + 1]].tobytes().split()  # at space, \t, \n, \v, \f and \r
                edges = [0, *gone.ravel().tolist(), len(words)]
                kept.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]).decode())
                counts.append(len(words))
                removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                lists.append(gone.tolist())
            made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[4:]], names=["doc", "n_words", "n_removed", "spans", "left_over", *kept_names])

    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in whole.schema.fields if f.name in kept_names)
    out = tc.mapped(wn.with_spans(whole, both), cut, "doc long, n_words long, n_removed long, spans array<array<long>>, left_over string" + extra)
    own = [F.col(a).alias(b) for a, b in zip(kept_names, keep, strict=True)]
    return out.select(F.col("doc").alias(id_col), *own, "n_words", "n_removed", "spans", "left_over")
