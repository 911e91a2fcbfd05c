"""Greedy string tiling against a plain version, and planted passages."""

import random

import numpy as np

from panelloom.llm.string_tiling import contaminated, greedy_tiles, worst_items


def plain_tiles(item, text, least):
    """Greedy string tiling by direct comparison of all places."""
    free_i, free_t, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and free_i[i + k] and free_t[t + k] and item[i + k] == text[t + k]:
                    k += 1
                if k > best[2]:
                    best = (i, t, k)
        if best[2] < least:
            return tiles
        i, t, k = best
        tiles.append(best)
        free_i[i : i + k] = [False] * k
        free_t[t : t + k] = [False] * k


def test_tiles():
    rng = random.Random(4)
    for _ in range(150):
        text = [rng.randrange(6) for _ in range(rng.randint(0, 60))]
        item = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        if len(text) > 25 and rng.random() < 0.5:
            item = text[15:25] + [9] + text[0:8]
        got = greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        for i, t, k in got:
            assert item[i : i + k] == text[t : t + k] and k >= 3
        for x in (0, 1):  # no overlap on either side
            spans = sorted((g[x], g[x] + g[2]) for g in got)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        want = plain_tiles(item, text, 3)
        assert max((g[2] for g in got), default=0) == max((w[2] for w in want), default=0)
        if len(set(item)) == len(item):
            assert sum(g[2] for g in got) == sum(w[2] for w in want)
        # whichever of equal tiles come first, none of the least length is left
        free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
        for i, t, k in got:
            free_i[i : i + k] = free_t[t : t + k] = False
        for i in range(len(item) - 2):
            for t in range(len(text) - 2):
                assert not (free_i[i : i + 3].all() and free_t[t : t + 3].all() and item[i : i + 3] == text[t : t + 3])


def test_tiles_with_repeated_words():
    """With the same choice among equal tiles the plain version gives the same tiles."""
    rng = random.Random(6)
    for _ in range(80):
        item = [rng.randrange(2) for _ in range(rng.randint(1, 24))]
        text = [rng.randrange(2) for _ in range(rng.randint(0, 40))]
        free_i, free_t, want = [True] * len(item), [True] * len(text), []
        while True:
            found = []
            for t in range(len(text)):
                for i in range(len(item)):
                    k = 0
                    while i + k < len(item) and t + k < len(text) and free_i[i + k] and free_t[t + k] and item[i + k] == text[t + k]:
                        k += 1
                    found.append((-k, t, i))
            k, t, i = min(found, default=(0, 0, 0))
            if -k < 3:
                break
            want.append((i, t, -k))
            free_i[i : i - k] = [False] * -k
            free_t[t : t - k] = [False] * -k
        assert greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3) == sorted(want)


def test_one_word_over_and_over():
    import time

    began = time.time()
    got = greedy_tiles(np.full(1000, 7, np.uint64), np.full(1_000_000, 7, np.uint64), 5)
    assert got == [(0, 0, 1000)]
    mixed = np.array(([1, 2, 3, 4, 5, 6] * 70 + [9] * 80) * 2, np.uint64)
    text = np.tile(np.array([1, 2, 3, 4, 5, 6], np.uint64), 100_000)
    assert sum(k for *_, k in greedy_tiles(mixed, text, 5)) == 840
    assert time.time() - began < 60


def test_planted(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.sample(words, 40)) + ".") for i in range(12)] + [(50, "Solo item."), (51, None), (52, "")]
    docs, want = [], {}
    for d in range(60):
        body = [rng.choice(words) for _ in range(300)]
        if d % 3 == 0:
            i, text = items[d % 12]
            w = text.rstrip(".").split()
            parts = [w[20:40], w[0:20]] if d % 2 else [w]
            if d % 5 == 0:
                parts[0][7] = "changed"
            for p in parts:
                at = rng.randrange(len(body))
                body[at:at] = [x.upper() + "," if d % 4 == 1 else x for x in p]
            want[d] = i
        docs.append((d, " ".join(body), "x"))
    docs += [(100, "here a SOLO, item stands", "x"), (101, None, "x"), (102, "", "x"), (None, items[1][1], "x"), (100, "here a SOLO, item stands", "x")]
    want |= {100: 50, None: 1}
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (1 << 20, 900):  # the small bound takes several passes
        got = worst_items(contaminated(frame, bench, part_bytes=part)).collect()
        assert {r.doc_id: r.item_id for r in got} == want and len(got) == len(want)
    assert contaminated(frame.limit(0), bench).count() == 0
    assert contaminated(frame, bench.limit(0)).count() == 0
