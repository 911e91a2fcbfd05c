"""N-gram Jaccard self-join by size-banded tiles with hashed bitmap signatures: op2.

1. Each text becomes its set of word n-grams (64-bit hashes, sorted; see textcore.py for why texts built to collide do
   not). Sets of equal size and equal sums of two hashes of their n-grams form one class; from then on one member, that
   of the least id, stands for it.
2. A fixed table of counters, indexed by hash bits, orders the n-grams from rare to frequent. Two sets of the wanted
   similarity share an n-gram among the first (1 - t) * size + 1 of each, so a class enters tiles for each of these only:
   passages that many texts share come last in the order and make no tiles.
3. Sizes fall into bands so wide that two sets of the wanted similarity are in one band or in neighbours. A tile is a
   token and a band: it holds the token's classes of that band, and those of the band below as partners for these.
   Within a tile only pairs whose bitmap signatures leave the similarity possible go on: every bit that differs is an
   n-gram in one set only, so the bit count bounds the overlap from above.
4. What remains is decided by intersecting the sorted hash arrays.

Tiles first yield a spanning forest of their possible links, of the highest bounds, not all pairs; what these links
connect needs no further look. A second pass over the tiles that still hold several components tests every pair of
different components that a longer signature leaves possible. Tiles of more than `TILE` classes are dealt out in
blocks by hash: first within blocks, then one class per component in blocks dealt anew, last pairs of blocks. So no link
between components is lost, and a group of copies costs a number of tests in proportion to it. A token that the counters
call frequent is dealt by token and class from the start, so that no task gets all its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.llm.components import components
from panelloom.runtime import Scratch, scratch_for, ship_package

SKETCH_BITS = 18
#: 64-bit words of a signature, and of its folded form for the first pass.
SIGNATURE_WORDS, FOLDED = 32, 8
TILE = 4096
#: Occurrences by the counters up to which no token is dealt out in parts.
FREQUENT = 1024


def _sets(raw: np.ndarray, off: np.ndarray, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the rows' distinct n-grams, sorted by row and hash."""
    text = raw[off[0] : off[-1]]
    text = tc.LOWER[text] if lower else text
    bounds = off - off[0]
    starts, ends, first = tc.words_of(text, bounds, tc.SPACE_WORDS)
    words = tc.word_hashes(text, 0, len(text), starts, ends)
    grams = tc.shingle_hashes(words, n)
    row = np.searchsorted(first, np.arange(len(grams)), side="right") - 1
    whole = np.arange(len(grams)) + n <= first[row + 1]
    grams, row = grams[whole], row[whole]
    count = np.diff(first)
    for k in range(1, n):  # texts of fewer words: all of them
        short = np.flatnonzero(count == k)
        if len(short):
            alone = tc.shingle_hashes(words, k)[first[short]]
            grams, row = np.concatenate([grams, alone]), np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], row[new]


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Wrapping sum of the values of each row (rows sorted)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    at = np.searchsorted(row, np.arange(rows + 1))
    return total[at[1:]] - total[at[:-1]]


def _profile(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """Per row: set size, two hashes and the signature; per task: counts of n-grams by hash bits (node null)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["node", "doc", "n", "h1", "h2", "sig", "long_sig"]
        for batch in batches:
            raw, off = tc.string_buffers(batch.column(2))
            for lo, hi in tc.row_slices(off):
                grams, row = _sets(raw, off[lo : hi + 1], n, lower)
                counts += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                sig = np.zeros((hi - lo, SIGNATURE_WORDS), np.uint64)
                bit = (tc.mix(grams + np.uint64(5)) >> np.uint64(32)).astype(np.int64) % (64 * SIGNATURE_WORDS)
                key = np.unique(row * (64 * SIGNATURE_WORDS) + bit)
                np.bitwise_or.at(sig.ravel(), key // 64, np.uint64(1) << (key % 64).astype(np.uint64))
                size = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(size.astype(np.int64)),
                        pa.array(_sums(tc.mix(grams), row, hi - lo).view(np.int64)),
                        pa.array(_sums(tc.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), row, hi - lo).view(np.int64)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.array(_long_signatures(grams, size), pa.binary()),
                    ],
                    names=names,
                )
        at = np.flatnonzero(counts)
        if len(at):
            none, zero = pa.array([None], pa.int64()), pa.array([0], pa.int64())
            packed = [pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([counts[at].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([none, none, zero, zero, zero, *packed], names=names)

    return tc.mapped(docs, scan, "node long, doc long, n long, h1 long, h2 long, sig binary, long_sig binary")


def _long_signatures(grams: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bitmap per row of at least four bits for each n-gram, a power of two."""
    out, at = [], 0
    hashed = tc.mix(grams + np.uint64(9))
    for n in size.tolist():
        bits = max(64, 1 << (4 * n - 1).bit_length()) if n else 64
        mark = np.zeros(bits, bool)
        mark[(hashed[at : at + n] & np.uint64(bits - 1)).astype(np.int64)] = True
        out.append(np.packbits(mark).tobytes())
        at += n
    return out


def _plausible(n_a: int, n_b: int, a: bytes, b: bytes, num: int, den: int) -> bool:
    """Whether long signatures leave the similarity possible; the longer one is folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    bound = (n_a + n_b - int(np.bitwise_count(x ^ y).sum(dtype=np.int64))) // 2
    return bound * (den + num) >= num * (n_a + n_b)


def _frequencies(profile: DataFrame) -> np.ndarray:
    """The counters summed over all tasks; their number is fixed, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(at, np.int32)] += np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sig"])

    parts = profile.where("node is null").select("sig", "long_sig").repartition(8)
    parts = tc.mapped(parts, add, "sig binary").collect()
    return sum((np.frombuffer(bytes(r["sig"]), np.int64) for r in parts), np.zeros(1 << SKETCH_BITS, np.int64))


def _tiles(docs: DataFrame, n: int, lower: bool, num: int, den: int, order: np.ndarray) -> DataFrame:
    """(token, node, n): the classes of each token that two classes or more may share."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    frequent = max(FREQUENT, int(16 * order.mean()))  # far more than what tokens have that meet in a counter by chance

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            raw, off = tc.string_buffers(batch.column(2))
            seen: set[tuple] = set()  # classes of this batch: of its copies the least node is enough
            for lo, hi in tc.row_slices(off):
                grams, row = _sets(raw, off[lo : hi + 1], n, lower)
                size = np.bincount(row, minlength=hi - lo)
                h1 = _sums(tc.mix(grams), row, hi - lo).view(np.int64)
                first = np.concatenate([[0], np.cumsum(size)])
                new = np.zeros(hi - lo, bool)
                for i in np.argsort(nodes[lo:hi], kind="stable").tolist():
                    key = (int(size[i]), int(h1[i]))
                    if key not in seen:
                        seen.add(key)
                        new[i] = True
                own = new[row]
                grams, row = grams[own], row[own]
                often = shared.value[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                by = np.lexsort((grams, often, row))
                grams, row, often = grams[by], row[by], often[by]
                begin = np.searchsorted(row, np.arange(hi - lo))
                keep = np.arange(len(grams)) - begin[row] < (size - -(-size * num // den) + 1)[row]
                keep &= often > 1  # what stands once has no partner
                grams, row, often = grams[keep], row[keep], often[keep]
                # frequent ones are dealt by class, in as many parts as they may fill
                salt = np.where(often > frequent, (h1[row] & 0x7FFFFFFF) % (often // frequent + 1), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(h1[row]), pa.array(nodes[lo + row]), pa.array(size[row].astype(np.int32)), pa.array(salt.astype(np.int32))],
                    names=["token", "h1", "node", "n", "salt"],
                )

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, several = None, None, False  # held: the first class of a tile that has shown no second one
        for batch in batches:
            if not batch.num_rows:
                continue
            token, h1, salt = (batch.column(i).to_numpy() for i in (0, 1, 4))
            new_t = np.ones(len(token), bool)
            new_t[1:] = token[1:] != token[:-1]
            new_c = new_t.copy()
            new_c[1:] |= h1[1:] != h1[:-1]
            if last is not None and token[0] == last[0]:
                new_t[0], new_c[0] = False, h1[0] != last[1]
            else:
                held, several = None, False
            tile = np.cumsum(new_t)  # 0: goes on from the batch before
            classes = np.bincount(tile[new_c], minlength=tile[-1] + 1)
            many = classes > 1
            many[0] = several or (held is not None and classes[0] > 0)
            many[tile[salt >= 0]] = True  # other parts may hold its partners
            if many[0] and held is not None:
                yield held
                held = None
            keep = new_c & many[tile]
            if keep.any():
                yield _columns(batch, keep)
            if new_t.any():
                several = bool(many[-1])
                held = None if several else _columns(batch, new_c & (tile == tile[-1]))
            else:
                several = bool(many[0])
            last = (token[-1], h1[-1])

    def _columns(batch: pa.RecordBatch, mask: np.ndarray) -> pa.RecordBatch:
        part = batch.filter(pa.array(mask))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3)], names=["token", "node", "n"])

    rows = tc.mapped(docs, scan, "token long, h1 long, node long, n int, salt int")
    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "h1", "node")
    return tc.mapped(dealt, shared_only, "token long, node long, n int")


def _banded(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Tiles by token and band, with side 3 for classes of the band itself and 1 for partners from the band below.

    A band is a little wider than the greatest ratio of sizes, so that rounding parts no pair."""
    width = math.log(den / num) * 1.001 if num < den else 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")
    places = F.array(F.struct(band.alias("band"), F.lit(3).alias("side")), F.struct((band + 1).alias("band"), F.lit(1).alias("side")))
    return tiles.select("token", "node", "n", F.explode(places).alias("p")).select("token", "node", "n", "p.band", "p.side")


def _possible(n_i: np.ndarray, n_j: np.ndarray, s_i: np.ndarray, s_j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and signatures leave the similarity possible."""
    both = n_i + n_j
    bound = (both - np.bitwise_count(s_i ^ s_j).sum(axis=-1, dtype=np.int64)) // 2
    return (bound * (den + num) >= num * both) & (np.minimum(n_i, n_j) * den >= num * np.maximum(n_i, n_j))


def _forest(node: np.ndarray, size: np.ndarray, sig: np.ndarray, comp: np.ndarray, num: int, den: int) -> tuple[list, list]:
    """Edges of a spanning forest of the possible links of a tile, greatest bound on the similarity first (Prim)."""
    a, b = [], []
    left = np.arange(len(node))
    best, parent = np.full(len(node), -1.0), np.zeros(len(node), np.int64)
    while len(left):
        k = int(np.argmax(best[left]))
        i = left[k]
        if best[i] >= 0 and comp[parent[i]] != comp[i]:
            a.append(node[parent[i]])
            b.append(node[i])
        left = np.delete(left, k)
        both = size[i] + size[left]
        bound = (both - np.bitwise_count(sig[i] ^ sig[left]).sum(axis=-1, dtype=np.int64)) // 2
        possible = (bound * (den + num) >= num * both) & (np.minimum(size[i], size[left]) * den >= num * np.maximum(size[i], size[left]))
        value = np.where(possible, bound / np.maximum(both - bound, 1) + (comp[left] == comp[i]), -1.0)
        closer = value > best[left]
        best[left[closer]] = value[closer]
        parent[left[closer]] = i
    return a, b


def _candidates(tiles: DataFrame, keys: list[str], num: int, den: int, every: bool) -> DataFrame:
    """Distinct (a, b) from tiles of (keys, side, node, n, sig, comp). every: all possible pairs of different
    components, else a forest. side: bits that two rows must have between them to be a wanted pair: 1 and 2 for the band,
    4 and 8 for the blocks."""

    def work(table: pa.Table) -> tuple[list, list]:
        node, size, comp, side = (table.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
        size = size.astype(np.int64)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(node), -1)
        key = [table.column(k).to_numpy() for k in keys]
        new = np.ones(len(node), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        at = np.append(np.flatnonzero(new), len(node))
        length = np.diff(at)
        a, b = [], []
        two = at[:-1][length == 2]
        ok = (comp[two] != comp[two + 1]) & _possible(size[two], size[two + 1], sig[two], sig[two + 1], num, den)
        a.append(node[two[ok]])
        b.append(node[two[ok] + 1])
        for lo, hi in zip(at[:-1][length > 2].tolist(), at[1:][length > 2].tolist(), strict=True):
            if (comp[lo:hi] == comp[lo]).all():
                continue
            if not every:
                x, y = _forest(node[lo:hi], size[lo:hi], sig[lo:hi], comp[lo:hi], num, den)
                a.append(np.array(x, np.int64))
                b.append(np.array(y, np.int64))
                continue
            rows = lo + np.argsort(size[lo:hi], kind="stable")
            for k, i in enumerate(rows[:-1]):
                reach = np.searchsorted(size[rows], size[i] * den // num, side="right")
                j = rows[k + 1 : reach]
                j = j[(comp[j] != comp[i]) & ((side[j] | side[i]) == 15)]
                j = j[_possible(size[i], size[j], sig[i], sig[j], num, den)]
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
        return a, b

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            same = np.logical_and.reduce([held.column(k).to_numpy() == held.column(k)[-1].as_py() for k in keys]) if held.num_rows else np.zeros(0, bool)
            cut = int(held.num_rows - same.sum())
            if cut:
                yield _pairs(*work(held.slice(0, cut)))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _pairs(*work(held))

    def _pairs(a: list, b: list) -> pa.RecordBatch:
        a_, b_ = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a_, b_), pa.int64()), pa.array(np.maximum(a_, b_), pa.int64())], names=["a", "b"])

    dealt = tiles.select(*keys, "side", "node", "n", "sig", "comp").repartition(*keys).sortWithinPartitions(*keys, "node")
    return tc.mapped(dealt, scan, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, long_: DataFrame, scratch: Scratch, n: int, lower: bool, num: int, den: int) -> DataFrame:
    """The pairs whose sets reach the similarity: long signatures (node, n, long_sig) bound it first, sorted arrays decide."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 6)]
            ok = pa.array([_plausible(*x, num, den) for x in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    one, two = long_.toDF("a", "na", "sa"), long_.toDF("b", "nb", "sb")
    every = pairs
    pairs = scratch.save(lambda: tc.mapped(every.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb"), prune, "a long, b long"), "plausible")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tc.string_buffers(batch.column(1))
            for lo, hi in tc.row_slices(off):
                grams, row = _sets(raw, off[lo : hi + 1], n, lower)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                out = [grams[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], names=["node", "grams"])

    sets = scratch.save(lambda: tc.mapped(docs.join(wanted, "node", "left_semi").select("node", "text"), arrays, "node long, grams binary"), "sets")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs: merged in one go
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = common * den >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    return tc.mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb"), test, "a long, b long")


def near_duplicates(
    frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, lower: bool = True
) -> DataFrame:
    """(id, n_shingles, component_id): component_id is the least id reachable by links of den * |x & y| >= num * |x | y|.

    Defined results: null and blank texts have the empty set and are linked with nothing; texts of fewer words than n
    have one n-gram, all words; a null id keeps its size and has a null component; rows that share an id are one
    document with a row each; other columns are not looked at; an empty table yields no rows.
    """
    spark = frame.sparkSession
    ship_package(spark)
    scratch = scratch_for(spark, "ngramjoin")
    own = frame.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    repeated = own.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1).count() > 0
    # where ids repeat, a hash of id and text names the row and its equals
    node = F.xxhash64("doc", "text") if repeated else F.col("doc")
    docs = own.where("doc is not null").select(node.alias("node"), "doc", "text")
    profile = scratch.save(lambda: _profile(docs, n, lower), "profile")
    sizes = profile.where("node is not null")
    full = sizes.where("n > 0")
    classes = full.groupBy("n", "h1", "h2").agg(F.min("node").alias("rep"))
    order = _frequencies(profile)
    tiles = scratch.save(lambda: _tiles(docs, n, lower, num, den, order), "tiles")
    signatures, long_ = sizes.select("node", "sig"), sizes.select("node", "n", "long_sig")
    if repeated:  # else nodes are ids, each of one row
        signatures, long_ = signatures.distinct(), long_.distinct()
    banded = _banded(tiles, num, den)
    # blocks of the few tiles that are too large for one task
    large = scratch.save(lambda: banded.groupBy("token", "band").agg(F.count("*").alias("m")).where(F.col("m") > TILE), "large")
    has_large = large.limit(1).count() > 0
    small, blocked = banded, None
    if has_large:
        small = banded.join(large, ["token", "band"], "left_anti")
        blocked = banded.join(large, ["token", "band"]).withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int"))
        blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).drop("m")
    dealt = small.withColumn("block", F.lit(0))
    if has_large:
        dealt = dealt.unionByName(blocked.drop("blocks"))
    dealt = dealt.withColumn("comp", F.col("node"))
    first = scratch.save(lambda: _candidates(_signed(dealt, signatures, True), ["token", "band", "block"], num, den, every=False), "forest")
    tested = first
    edges = scratch.save(lambda: _verified(first, docs, long_, scratch, n, lower, num, den), "linked")
    if repeated:
        # by the nodes that stand for their classes, as all other edges; empty sets are no class
        stands = full.join(classes, ["n", "h1", "h2"]).select("node", "rep").distinct()
        tied = docs.select("doc", "node").join(stands, "node", "left").select("doc", F.coalesce("rep", "node").alias("node"))
        one = tied.groupBy("doc").agg(F.min("node").alias("b"))
        edges = edges.unionByName(tied.join(one, "doc").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    if has_large:
        comp = scratch.save(lambda: components(edges, scratch), "comp")
        # one class per component and tile, in blocks dealt anew
        reps = _with_component(blocked, comp).groupBy("token", "band", "comp", "blocks").agg(F.min(F.struct("node", "n")).alias("x"), F.max("side").alias("side"))
        reps = reps.select("token", "band", "side", "comp", "x.node", "x.n", F.pmod(F.xxhash64("comp", F.lit(1)), "blocks").cast("int").alias("block"))
        again = scratch.save(
            lambda: _candidates(_signed(reps, signatures, True), ["token", "band", "block"], num, den, every=False).join(tested, ["a", "b"], "left_anti"), "forest2"
        )
        more = scratch.save(lambda: _verified(again, docs, long_, scratch, n, lower, num, den), "linked2")
        edges, tested = edges.unionByName(more), tested.unionByName(again)
    comp = scratch.save(lambda: components(edges, scratch), "comp")
    # the tiles that still hold several components
    mixed = lambda t: t.join(t.groupBy("token", "band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token", "band"), ["token", "band"], "left_semi")
    rest = mixed(_with_component(small, comp)).withColumn("pi", F.lit(0)).withColumn("pj", F.lit(0))
    if has_large:
        # a row meets each block of its tile once; of a pair of blocks one row of each is wanted, within a block any two
        pairs = mixed(_with_component(blocked, comp)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.when(F.col("block") == F.col("other"), F.lit(12)).when(F.col("block") < F.col("other"), F.lit(4)).otherwise(F.lit(8))
        pairs = pairs.withColumn("side", F.col("side") + part).withColumn("pi", F.least("block", "other")).withColumn("pj", F.greatest("block", "other"))
        rest = rest.withColumn("side", F.col("side") + 12).unionByName(pairs.drop("blocks", "block", "other"))
    else:
        rest = rest.withColumn("side", F.col("side") + 12)
    final = scratch.save(
        lambda: _candidates(_signed(rest, signatures, False), ["token", "band", "pi", "pj"], num, den, every=True).join(tested, ["a", "b"], "left_anti"), "rest"
    )
    more = scratch.save(lambda: _verified(final, docs, long_, scratch, n, lower, num, den), "linked3")
    if more.limit(1).count():
        stars = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = scratch.save(lambda: components(stars.unionByName(more), scratch), "comp")
    label = comp.select(F.col("node").alias("rep"), "component")
    placed = full.join(classes, ["n", "h1", "h2"]).join(label, "rep", "left").select("node", "doc", "n", F.coalesce("component", "rep").alias("component"))
    if repeated:  # rows of one id are one document, and labels are hashes
        least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
        placed = placed.join(least, "component").select("doc", "n", "component_id")
    else:
        placed = placed.select("doc", "n", F.col("component").alias("component_id"))
    empty = sizes.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    out = placed.unionByName(empty)
    nameless = own.where("doc is null").select(F.lit(None).cast("long").alias("node"), "doc", "text")
    if nameless.limit(1).count():
        # the counters' rows have no node either; sizes of these texts are told by a node of their own
        named = nameless.withColumn("node", F.lit(0).cast("long"))
        out = out.unionByName(_profile(named, n, lower).where("node is not null").select("doc", "n", F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _signed(tiles: DataFrame, signatures: DataFrame, folded: bool) -> DataFrame:
    """Tiles with signatures; folded: their quarters, one upon the other."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, SIGNATURE_WORDS // FOLDED, FOLDED)
            short = np.bitwise_or.reduce(whole, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in short], pa.binary())], names=["node", "sig"])

    return tiles.join(tc.mapped(signatures, fold, "node long, sig binary") if folded else signatures, "node")


def _with_component(tiles: DataFrame, comp: DataFrame) -> DataFrame:
    return tiles.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
