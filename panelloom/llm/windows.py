"""Windows of fixed length that also start in an earlier document: the common part of two operators.

Units are the bytes or the words of a text; a window is `window` consecutive units. Hashing every window of a corpus
would move many times the corpus, so windows are represented by anchors. In each window the position whose k units
hash lowest (the leftmost of equals) is its anchor: a choice that depends on the window's content alone, so equal
windows have equal anchors at equal places. The windows of one document that share an anchor are consecutive; they form
a *run*, and the units that they cover are the run's *extent*. One record per run is shuffled, by the hash of its
anchor:

* runs with equal extents (by fingerprints that no structure of the texts defeats, see textcore.py) have equal windows, so
  all but those of the least document are covered outright, however many copies there are;
* of runs that share the anchor but not the extent, those of each extent's least document are fetched again and their
  windows compared unit by unit.

Each window belongs to exactly one run. Anchors in a line that very many texts share have very many extents. A task that
meets `HOT_EXTENTS` of them deals that anchor's runs by anchor and extent from then on, asks for all that are not covered,
and sends one marker by the anchor alone, so that the runs which other tasks dealt by the anchor are asked for as well:
no task gets all runs of such an anchor, and what is compared stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc

#: kh, eh: hashes of anchor and extent. place: first window, number of windows and the anchor's place in the extent, in
#: one number; mark: tag and kind. Rows are many, so they are kept narrow; `unpacked` has the parts.
RUN_SCHEMA = "kh long, eh long, doc long, place long, mark long"
FIELDS = ["kh", "eh", "doc", "place", "mark"]
#: Kinds of rows. Runs are RECORD, or COVERED where a smaller document of the same batch has the extent already; the
#: comparison of runs yields REQUEST and CLASS. As its input, MARKER stands for an anchor that other tasks dealt by extent.
COVERED, REQUEST, CLASS, RECORD = 0, 1, 2, 3
MARKER = CLASS
#: Bit of a run that is dealt by anchor and extent.
HOT = 4
#: Extents of one anchor in a task beyond which it is hot, and how many anchors a task counts.
HOT_EXTENTS, COUNTED = 8, 1 << 16
#: The extent of markers; no run has it.
NO_EXTENT = np.iinfo(np.int64).min
#: Windows of one text handled at once.
SEGMENT = 1 << 18


@dataclass(frozen=True)
class Units:
    """What a window consists of. words: else bytes. anchor: units per anchor."""

    words: bool
    window: int
    anchor: int

    def __post_init__(self) -> None:
        if not 0 < self.anchor <= self.window or self.window >= 4096:
            raise ValueError("an anchor must fit a window, and a window have fewer than 4096 units")

    def codes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, or the 64-bit hash of each word, of the rows, and each row's first unit (n+1 long)."""
        if not self.words:
            return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts, ends, first = tc.words_of(raw, offsets, tc.SPACE_WORDS)
        return tc.word_hashes(raw, int(offsets[0]), int(offsets[-1]), starts, ends), first


def kind() -> Column:
    return F.col("mark").bitwiseAND(F.lit(3).cast("long"))


def unpacked(rows: DataFrame) -> DataFrame:
    """Runs with tag, s, nw and off as columns of their own."""
    low = F.lit(4095).cast("long")
    return rows.select(
        "kh",
        "eh",
        "doc",
        F.shiftright("mark", 3).cast("int").alias("tag"),
        F.shiftright("place", 24).cast("int").alias("s"),
        F.shiftright("place", 12).bitwiseAND(low).cast("int").alias("nw"),
        F.col("place").bitwiseAND(low).cast("int").alias("off"),
    )


def usable(frame: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, tag, text, __k0, ... of the columns `keep`). tag tells rows of one id with different texts apart; it is 0 where
    ids are unique."""
    own = frame.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep))
    )
    repeated = own.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1).count() > 0
    tag = _tags(own) if repeated else own.withColumn("tag", F.lit(0))
    return tag.select("doc", "tag", "text", *(f"__k{i}" for i in range(len(keep))))


def _tags(own: DataFrame) -> DataFrame:
    """Rows of one id get a tag by their text: the number of its hash among the id's."""
    hashed = own.withColumn("__h", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    several = hashed.where("doc is not null").select("doc", "__h").distinct()
    several = several.join(several.groupBy("doc").count().where("count > 1").select("doc"), "doc", "left_semi")
    numbered = several.withColumn("tag", F.row_number().over(Window.partitionBy("doc").orderBy("__h")) - 1)
    return hashed.join(numbered, ["doc", "__h"], "left").withColumn("tag", F.coalesce("tag", F.lit(0)))


def runs(docs: DataFrame, units: Units) -> DataFrame:
    """A record for each run of windows with one anchor, and markers of hot anchors."""
    width = units.window - units.anchor + 1

    def cut(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple]:
        """(anchor, extent, row, first window, windows, anchor's place) of the runs of rows lying back to back."""
        codes, bounds = units.codes(raw, off)
        for at in range(0, max(0, len(codes) - units.window + 1), SEGMENT):
            part = codes[at : at + SEGMENT + units.window - 1]
            prefix = tc.prefix_hash(part if units.words else tc.BYTE_CODE[part])
            grams = tc.gram_hashes(prefix, units.anchor)
            anchor = tc.leftmost_minima(grams, width)
            start = np.arange(len(anchor))
            row = np.searchsorted(bounds, start + at, side="right") - 1
            inside = start + at + units.window <= bounds[row + 1]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(anchor))
            first, last = first[inside[first]], last[inside[first]]
            whose, ends = row[first], last - 1 + units.window
            extent = tc.fingerprints(tc.fingerprint_prefix(part), first, ends) if units.words else tc.content_hashes(part, first, ends)
            yield grams[anchor[first]], extent, whose, first + at - bounds[whose], last - first, anchor[first] - first

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = HotAnchors()
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, off = tc.string_buffers(batch.column(2))
            parts = [(kh, eh, lo + row, *rest) for lo, hi in tc.row_slices(off) for kh, eh, row, *rest in cut(raw, off[lo : hi + 1])]
            if not parts:
                continue
            kh, eh, row, s, nw, o = (np.concatenate(x) for x in zip(*parts, strict=True))
            kh, eh, doc = kh.view(np.int64), eh.view(np.int64), ids[row]
            eh = np.where(eh == NO_EXTENT, NO_EXTENT + 1, eh)
            covered, hot, fresh = counted.judge(kh, eh, doc)
            columns = [kh, eh, doc, (s << 24) | (nw << 12) | o, tags[row].astype(np.int64) * 8 + np.where(covered, COVERED, RECORD) + np.where(hot, HOT, 0)]
            if len(fresh):
                markers = [fresh, np.full(len(fresh), NO_EXTENT), np.full(len(fresh), NO_EXTENT), np.zeros(len(fresh), np.int64), np.full(len(fresh), MARKER)]
                columns = [np.concatenate(x) for x in zip(columns, markers, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=FIELDS)

    return tc.mapped(docs.where("doc is not null and text is not null"), scan, RUN_SCHEMA)


class HotAnchors:
    """What a task has seen of anchors with several extents."""

    def __init__(self):
        self.keys, self.extents = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def judge(self, kh: np.ndarray, eh: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(covered, hot, anchors that became hot): runs whose extent a smaller document of the batch has, so that what
        very many texts share is not shuffled by its hash; and runs of hot anchors."""
        order = np.lexsort((doc, eh, kh))
        k, e, d = kh[order], eh[order], doc[order]
        new_k = np.ones(len(k), bool)
        new_k[1:] = k[1:] != k[:-1]
        new = new_k.copy()
        new[1:] |= e[1:] != e[:-1]
        covered = np.empty(len(k), bool)
        covered[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = np.flatnonzero(new_k)
        own, several = k[at], np.add.reduceat(new, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        seen = np.where(self.keys[place] == own, self.extents[place], 0) if len(self.keys) else np.zeros(len(own), np.int64)
        total = seen + several
        hot_key = total >= HOT_EXTENTS
        fresh = own[hot_key & (seen < HOT_EXTENTS)]
        hot = np.empty(len(k), bool)
        hot[order] = hot_key[np.cumsum(new_k) - 1]
        keep = (several > 1) | (seen > 0)
        keys, extents = np.concatenate([own[keep], self.keys]), np.concatenate([total[keep], self.extents])
        self.keys, first = np.unique(keys, return_index=True)  # of a key seen before, the new total comes first
        self.extents = extents[first]
        if len(self.keys) > COUNTED:
            most = np.sort(np.argpartition(self.extents, -COUNTED)[-COUNTED:])
            self.keys, self.extents = self.keys[most], self.extents[most]
        return covered, hot, fresh


def compare_runs(records: DataFrame, first_new: int | None = None) -> DataFrame:
    """Rows of kind COVERED (a smaller document has the same extent), REQUEST (the anchor has other extents: compare
    windows) and, where first_new is given, CLASS (the first run of an extent that no document below first_new has).

    Streams over the sorted records; beyond a batch it keeps the runs of one document and anchor at most.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (kh, eh, least doc of that extent)
        several = False  # whether the current anchor has shown a second extent
        held: list[pa.RecordBatch] = []  # runs of the current anchor's first extent and least document
        for batch in batches:
            mark = batch.column(4).to_numpy()
            passed = mark & 3 == COVERED
            if passed.any():
                yield _with_kind(batch, passed, COVERED)
                batch = batch.filter(pa.array(~passed))
            if not batch.num_rows:
                continue
            kh, eh, doc, _, mark = (x.to_numpy() for x in batch.columns)
            run, hot = mark & 3 != MARKER, mark & HOT > 0
            n = len(kh)
            new_k = np.ones(n, bool)
            new_k[1:] = kh[1:] != kh[:-1]
            new_e = new_k.copy()
            new_e[1:] |= eh[1:] != eh[:-1]
            if last is not None:
                new_k[0] = kh[0] != last[0]
                new_e[0] = new_k[0] or eh[0] != last[1]
            class_at = np.flatnonzero(new_e)
            k_at = np.flatnonzero(new_k)
            class_of = np.cumsum(new_e) - 1  # -1: goes on with the extent of the batch before
            k_of = np.cumsum(new_k) - 1
            least = np.where(class_of >= 0, doc[class_at[np.maximum(class_of, 0)]] if len(class_at) else 0, last[2] if last else 0)
            covered = (doc > least) & run
            per_k = np.bincount(k_of[class_at] + 1, minlength=len(k_at) + 1)  # extents that begin here, by anchor
            multi = per_k > 1
            multi[0] = several or per_k[0] > 0
            if held and per_k[0] > 0:
                yield from held
                held = []
            elif len(k_at):
                held = []
            ask = ~covered & run & (multi[k_of + 1] | hot)
            if len(k_at):  # the last anchor may go on in the next batch
                several = bool(multi[-1])
            else:
                several = bool(multi[0])
            tail = ~covered & run & ~hot & ~multi[k_of + 1] & (k_of == k_of[-1])
            kinds = [(covered, COVERED), (ask, REQUEST)]
            if first_new is not None:
                head = np.zeros(n, bool)
                head[class_at] = (doc[class_at] >= first_new) & run[class_at]
                kinds.append((head, CLASS))
            for mask, kind in kinds:
                if mask.any():
                    yield _with_kind(batch, mask, kind)
            if tail.any() and not several:
                held.append(_with_kind(batch, tail, REQUEST))
            last = (kh[-1], eh[-1], least[-1])

    by_extent = F.col("mark").bitwiseAND(F.lit(HOT).cast("long")) > 0
    route = F.when(kind() == COVERED, F.xxhash64("doc", "place")).when(by_extent, F.xxhash64("kh", "eh")).otherwise(F.col("kh"))
    dealt = records.select(*FIELDS).repartition(route).sortWithinPartitions("kh", "eh", "doc", "mark", "place")
    return tc.mapped(dealt, scan, RUN_SCHEMA)


def _with_kind(batch: pa.RecordBatch, mask: np.ndarray, kind: int) -> pa.RecordBatch:
    part = batch.filter(pa.array(mask))
    hashes = part.columns[:2]
    if kind == COVERED:  # nothing asks for them any more
        hashes = [pa.array(np.zeros(part.num_rows, np.int64))] * 2
    mark = (part.column(4).to_numpy() & ~3) | kind
    return pa.RecordBatch.from_arrays([*hashes, *part.columns[2:4], pa.array(mark)], names=FIELDS)


def extents(docs: DataFrame, requests: DataFrame, units: Units) -> DataFrame:
    """Requests with the units of their extents: bytes as they are, words joined by one space."""
    wanted = unpacked(requests).groupBy("doc", "tag").agg(F.collect_list(F.struct("kh", "eh", "s", "nw", "off")).alias("asked"))
    joined = docs.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tc.string_buffers(batch.column(2))
            asked = batch.column(3)
            first = np.asarray(asked.offsets)
            field = {f.name: asked.values.field(i).to_numpy() for i, f in enumerate(asked.type.value_type)}
            for lo, hi in tc.row_slices(off):
                pick = slice(int(first[lo]), int(first[hi]))
                k = np.diff(first[lo : hi + 1])
                row = np.repeat(np.arange(hi - lo), k)
                s, e = field["s"][pick].astype(np.int64), field["s"][pick].astype(np.int64) + field["nw"][pick] - 1 + units.window
                if units.words:
                    content, edge = [], np.append(0, np.cumsum(k)).tolist()
                    s_, e_ = s.tolist(), e.tolist()
                    for i in range(hi - lo):
                        if k[i]:
                            words = raw[off[lo + i] : off[lo + i + 1]].tobytes().split()  # at the same characters
                            content += [b" ".join(words[s_[j] : e_[j]]) for j in range(edge[i], edge[i + 1])]
                else:
                    base = off[lo:hi][row]
                    content = [raw[x:y].tobytes() for x, y in zip((base + s).tolist(), (base + e).tolist(), strict=True)]
                whose = lo + row
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(field["kh"][pick]),
                        pa.array(field["eh"][pick]),
                        batch.column(0).take(pa.array(whose)),
                        batch.column(1).take(pa.array(whose)),
                        pa.array(field["s"][pick]),
                        pa.array(field["nw"][pick]),
                        pa.array(field["off"][pick]),
                        pa.array(content, pa.binary()),
                    ],
                    names=["kh", "eh", "doc", "tag", "s", "nw", "off", "ext"],
                )

    return tc.mapped(joined, cut, "kh long, eh long, doc long, tag int, s int, nw int, off int, ext binary")


#: Compares the windows of runs with one anchor. Gets extents, doc, kh, eh, nw and off of runs sorted by kh and eh; yields
#: the runs and the window numbers within them that a smaller document has as well.
Matcher = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def matched_windows(found: DataFrame, matcher: Matcher, units: Units, most: int = 1 << 14) -> DataFrame:
    """(doc, tag, s, e): windows of the fetched runs that also start in a smaller document.

    Groups of up to `most` runs per anchor go to `matcher` whole. Beyond, each window becomes a row and is compared
    with the equal windows only, by hash and then by content, so no group of unbounded size meets in one task.
    """
    crowded = found.groupBy("kh").agg(F.count("*").alias("n")).where(F.col("n") > most).select("kh")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            kh = held.column("kh").to_numpy()
            if len(kh) < 4096:
                continue
            keep = int(np.searchsorted(kh, kh[-1]))
            if keep:
                yield from _block(held.slice(0, keep), matcher, units)
                held = held.slice(keep)
        if held is not None and held.num_rows:
            yield from _block(held, matcher, units)

    fields = ["kh", "eh", "doc", "tag", "s", "nw", "off", "ext"]
    small = found.join(crowded, "kh", "left_anti").select(*fields).repartition("kh").sortWithinPartitions("kh", "eh", "doc")
    spans = tc.mapped(small, blocks, "doc long, tag int, s int, e int")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ext in enumerate(batch.column(7).to_pylist()):
                doc, tag, s, nw = (batch.column(j)[i].as_py() for j in (2, 3, 4, 5))
                windows = list(content_windows(ext, units, nw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows, pa.binary()), pa.array([doc] * nw, pa.int64()), pa.array([tag] * nw, pa.int32()), pa.array(np.arange(s, s + nw, dtype=np.int32))],
                    names=["w", "doc", "tag", "s"],
                )

    large = tc.mapped(found.join(crowded, "kh", "left_semi").select(*fields), explode, "w binary, doc long, tag int, s int")
    least = large.groupBy("w").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").drop("last")
    hot = large.join(least, "w").where("doc > least").select("doc", "tag", "s", (F.col("s") + units.window).alias("e"))
    return spans.unionByName(hot)


def content_windows(ext: bytes, units: Units, n: int) -> Iterator[bytes]:
    """The n windows of an extent."""
    if not units.words:
        for i in range(n):
            yield ext[i : i + units.window]
        return
    gaps = [-1, *(i for i, b in enumerate(ext) if b == 32), len(ext)]
    for i in range(n):
        yield ext[gaps[i] + 1 : gaps[i + units.window]]


def _block(table: pa.Table, matcher: Matcher, units: Units) -> Iterator[pa.RecordBatch]:
    kh, eh, doc, nw, off = (table.column(c).to_numpy() for c in ("kh", "eh", "doc", "nw", "off"))
    run, window = matcher(table.column("ext").to_pylist(), doc, kh, eh, nw, off)
    if len(run):
        order = np.lexsort((window, run))
        run, window = run[order], window[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)
        last = window[np.append(np.flatnonzero(new)[1:], len(run)) - 1]
        run, window = run[new], window[new]
        start = table.column("s").to_numpy()[run] + window
        end = table.column("s").to_numpy()[run] + last + units.window
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[run]),
                pa.array(table.column("tag").to_numpy()[run]),
                pa.array(start.astype(np.int32)),
                pa.array(end.astype(np.int32)),
            ],
            names=["doc", "tag", "s", "e"],
        )


def covered_spans(found: DataFrame, units: Units) -> DataFrame:
    """(doc, tag, s, e) of the runs that are covered outright."""
    return unpacked(found.where(kind() == COVERED)).select("doc", "tag", "s", (F.col("s") + F.col("nw") - 1 + units.window).alias("e"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, tag, text, spans, what else docs has): documents with the list of their spans (null: none)."""
    listed = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return docs.join(listed, ["doc", "tag"], "left").select("doc", "tag", "text", "spans", *docs.columns[3:])


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of (n, 2) spans as sorted maximal runs; touching ones are one run."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def span_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The merged spans of each row of an array<struct<s,e>> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first, values = np.asarray(column.offsets), column.values
    both = np.stack([values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64) if len(values) else np.zeros((0, 2), np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield merged(both[first[i] : first[i + 1]] if valid[i] else both[:0])


def id_column(name: str) -> Column:
    return F.col("doc").alias(name)
