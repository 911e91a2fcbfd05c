"""The similarity join against brute force over all pairs."""

import random
import re

import pytest

import panelloom.llm.ngram_join as nj
from panelloom.llm.components import components
from panelloom.runtime import Scratch

SCHEMA = "doc_id long, text string, node string"


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        find(a)
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and a is not None and rows[j][0] is not None and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(rows[j][0])))
                parent[q] = p
    return sorted((str(a), len(s), str(find(a) if s and a is not None else a)) for (a, _), s in zip(rows, sets))


def texts(seed, n, edits):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + rng.choice("XYZ") for _ in range(rng.randint(1, 80))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(["Q", "q", "r", "s"])
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \t"), (n + 3, "one two"), (n + 4, "One  TWO"), (n + 5, "one two three"), (None, rows[0][1]), (None, None)]


@pytest.mark.parametrize(("seed", "n", "edits", "tile", "extra"), [(1, 60, 2, 4096, []), (2, 70, 3, 8, []), (3, 40, 2, 4096, [(3, "one two"), (5, None), (5, "aX bY cZ dX eY fZ")])])
def test_components(spark, monkeypatch, seed, n, edits, tile, extra):
    monkeypatch.setattr(nj, "TILE", tile)
    monkeypatch.setattr(nj, "FREQUENT", 4 if tile == 8 else 1024)
    rows = texts(seed, n, edits) + extra
    random.Random(seed).shuffle(rows)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    for k, num in ((4, 85), (3, 60)):
        got = nj.near_duplicates(frame, n=k, num=num, den=100).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, num, 100)


def test_empty(spark):
    assert nj.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(components(edges, Scratch(spark, "t")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_any_graph(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range((20, 45, 200)[seed])]
    edges += edges[:9] + [(b, a) for a, b in edges[:9]] + [(7, 7)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got)) == sorted(label.items())
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_write_once_a_round(spark):
    """A star around its greatest node takes one round of two shuffles and one table."""
    scratch = Scratch(spark, "t")
    got = dict(components(spark.createDataFrame([(50, i) for i in range(50)], "a long, b long"), scratch).collect())
    assert got == dict.fromkeys(range(51), 0) and scratch.count <= 2


def test_unique_ids_need_no_distinct_profile(spark, monkeypatch):
    """Signatures of documents with ids of their own are joined as they lie."""
    plans = []
    signed = nj._signed
    monkeypatch.setattr(nj, "_signed", lambda tiles, signatures, folded: plans.append(signatures._jdf.queryExecution().optimizedPlan().toString()) or signed(tiles, signatures, folded))
    rows = texts(1, 5, 2)[:-2]
    nj.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA))
    assert plans and not any("Aggregate" in p for p in plans)


def test_rows_of_one_id_with_different_texts(spark):
    """An id of two texts links the documents of either, whichever of equal texts' nodes hashes lowest."""
    rows = [(900, " "), (901, ""), (901, "x y z u v w"), (902, None), (902, "some words of its own")]
    for i in range(12):
        one, two = (" ".join(f"{c}{i}w{k}" for k in range(9)) for c in "ab")
        rows += [(100 + i, one), (100 + i, two), (i, one), (200 + i, two)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = nj.near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 5, 80, 100)


def test_words_built_to_collide(spark):
    """Thue-Morse words and their complements: different sets, whatever a polynomial modulo 2**64 says."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, f"{one}  X y z")]
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"{rng.randrange(10**6)}" for _ in range(150_000)]
    other = list(words)
    other[10] = "edit"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:70_000])), (4, "x" * 2_000_000)]
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_shingles for r in got}[4] == 1


def test_sizes_at_the_edge_of_bands():
    """Two sizes that allow the similarity are in one band or in neighbours."""
    import math

    for num, den in ((85, 100), (80, 100), (60, 100), (1, 2)):
        width = math.log(den / num) * 1.001
        for a in range(1, 400):
            b = a * den // num
            assert math.floor(math.log(b) / width) - math.floor(math.log(a) / width) <= 1
