"""The two removers of repeated windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelloom.llm.substring_dedup import remove_repeated_words
from panelloom.llm.suffix_dedup import remove_repeated_bytes
from panelloom.llm.suffix_groups import suffix_array, suffix_arrays


def brute(rows, window, units):
    """n units, covered units and spans of each (id, text)."""
    split = [(i, units(t)) for i, t in rows]
    least = {}
    for i, u in split:
        if i is not None:
            for s in range(len(u) - window + 1):
                w = tuple(u[s : s + window])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, u in split:
        gone = [False] * len(u)
        if i is not None:
            for s in range(len(u) - window + 1):
                if least[tuple(u[s : s + window])] < i:
                    gone[s : s + window] = [True] * window
        out.append((i, u, gone))
    return out


def texts(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(words)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 160))] for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        if parts and rng.random() < 0.3:
            parts[rng.randrange(len(parts))] = "edit"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(n, ""), (n + 1, None), (n + 2, "a" * 400), (n + 3, "a" * 130), (n + 4, "ab " * 300), (n + 5, "ab " * 100), (3, rows[5][1]), (4, rows[4][1]), (None, rows[2][1]), (n + 6, rows[2][1] + " tail")]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, doc string"


@pytest.mark.parametrize(("seed", "n", "words", "most"), [(1, 60, 40, 1024), (2, 40, 3, 1024), (3, 50, 400, 2)])
def test_words(spark, monkeypatch, seed, n, words, most):
    import panelloom.llm.windows as wn

    plain = wn.matched_windows
    monkeypatch.setattr(wn, "matched_windows", lambda f, m, u: plain(f, m, u, most))
    rows = texts(seed, n, words)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    want = sorted(
        (str(i), len(u), sum(g), " ".join(w for w, x in zip(u, g) if not x))
        for i, u, g in brute(rows, 20, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    )
    for batches in (1, 4) if seed == 1 else (3,):
        got = remove_repeated_words(frame, window=20, anchor=8, batches=batches).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.left_over) for r in got) == want


@pytest.mark.parametrize(("seed", "n", "words", "most"), [(1, 60, 40, 1024), (2, 30, 3, 1024), (3, 40, 400, 2)])
def test_bytes(spark, monkeypatch, seed, n, words, most):
    import panelloom.llm.windows as wn

    plain = wn.matched_windows
    monkeypatch.setattr(wn, "matched_windows", lambda f, m, u: plain(f, m, u, most))
    rows = texts(seed, n, words)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    want = []
    for i, u, g in brute(rows, 50, lambda t: (t or "").encode()):
        spans = sum(1 for k, x in enumerate(g) if x and (k == 0 or not g[k - 1]))
        want.append((str(i), len(u), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()))
    got = remove_repeated_bytes(frame).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == sorted(want)


def test_very_long_texts(spark):
    """Texts beyond a slice and a segment: a copy of the middle of one is found in the other, and nothing else."""
    rng = random.Random(7)
    words = [f"{rng.randrange(10**9)}" for _ in range(160_000)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[40_000:100_000]) + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeated_words(frame).collect()}
    assert got[1].n_removed == 0 and got[2].left_over == "start end" and got[2].n_removed == 60_000
    got = {r.doc_id: r for r in remove_repeated_bytes(frame).collect()}
    middle = len(" ".join(words[40_000:100_000]))
    assert got[1].n_removed == 0 and len(got[2].spans) == 1 and middle <= got[2].n_removed <= middle + 2


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_words(frame).count() == 0
    assert remove_repeated_bytes(frame).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, a = int(rng.integers(1, 40)), int(rng.integers(1, 4))
        rows = rng.integers(0, a, (3, n))
        want = [sorted(range(n), key=lambda i: list(r[i:])) for r in rows]
        assert [suffix_array(r) for r in rows] == want
        assert suffix_arrays(rows).tolist() == want


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_texts_built_to_collide(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64, whatever the base."""
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    tail = " ".join(f"w{i}" for i in range(59))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")]
    got = {r.doc_id: r.n_removed for r in remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 59, 3: 60}
    words = [thue_morse(64, "x ", "y "), thue_morse(64, "y ", "x ")]
    want = sorted((str(i), sum(g)) for i, _, g in brute(list(enumerate(words)), 50, str.split))
    got = remove_repeated_words(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == want
    rows = [(1, one), (2, two), (3, one + two)]
    want = sorted((i, sum(g)) for i, _, g in brute(rows, 50, lambda t: t.encode()))
    got = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == want


def test_common_line(spark):
    """A line in nearly all documents, with other text around it: its anchors are dealt by extent."""
    rng = random.Random(9)
    line = " ".join(f"common{i}" for i in range(30))
    rows = []
    for i in range(300):
        before, after = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(40)) for _ in "ab")
        rows.append((i, f"{before} {line} {after}" if i % 10 else before))
    rows += [(400 + i, rows[i + 1][1]) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for batches in (1, 2):
        want = sorted((i, sum(g)) for i, _, g in brute(rows, 20, str.split))
        got = remove_repeated_words(frame, window=20, anchor=8, batches=batches).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == want
    want = sorted((i, sum(g)) for i, _, g in brute(rows, 50, lambda t: t.encode()))
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeated_bytes(frame).collect()) == want


def test_index_is_merged_where_it_lies(spark):
    """Runs are joined without moving or sorting them, and compacted on the way."""
    from panelloom.llm.substring_dedup import FingerprintIndex
    from panelloom.llm.windows import Units, runs
    from panelloom.runtime import Scratch, _settings, ship_package

    ship_package(spark)
    units = Units(words=True, window=20, anchor=8)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60))) for i in range(80)]
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc long, tag int, text string")
    index = FingerprintIndex(Scratch(spark, "t"), max_runs=2)
    for low in (0, 20, 40, 60):
        index.add(lambda low=low: runs(docs.where(f"doc >= {low} and doc < {low + 20}"), units), low)
    assert index.compactions == 1 and len(index.runs) == 1
    records = index.scratch.save(lambda: runs(docs, units))
    with _settings(spark, **{"spark.sql.adaptive.enabled": "false"}):
        plan = index.matching(index.runs[0], records)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    run_side = join[: join.index("Bucketed: true")]
    assert "Exchange" not in run_side and "Sort [" not in run_side


def test_kept_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "s", 1.5), (1, "c", None, 2.5), (1, "a b", "s", 1.5), (None, None, "t", None)], "doc_id long, text string, tag string, doc double")
    got = remove_repeated_words(frame, keep=("tag", "doc")).collect()
    assert sorted((str(r.doc_id), r.left_over, str(r.tag), str(r.doc)) for r in got) == [("1", "a b", "s", "1.5"), ("1", "a b", "s", "1.5"), ("1", "c", "None", "2.5"), ("None", "", "t", "None")]
