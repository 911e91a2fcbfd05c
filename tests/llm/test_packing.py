"""Packing: exact round trip, no gaps, few sequences; both tokenizers agree where the fast one is used."""

import random
import zlib

import numpy as np
import pytest

from panelloom.llm import packing as pk


def test_tokenizers_agree():
    fast, exact = pk.encoders("byte_bpe_50k")
    rng = random.Random(1)
    for c in range(pk.SAFE_LIMIT):
        for text in (f"a{chr(c)}b", f" {chr(c)} ", f"{chr(c)}{chr(c)} x", f"1{chr(c)}2", f"\n{chr(c)}\n", f"it{chr(c)}s 's"):
            assert fast(text) == exact(text)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(pk.SAFE_LIMIT), rng.randrange(32, 127), 32, 10, 39])) for _ in range(60))
        assert fast(text) == exact(text)
    assert fast("a <|endoftext|> b") == exact("a <|endoftext|> b")


@pytest.mark.parametrize("n", [0, 1, 7, 400, 6000])
def test_solver(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(4, 1, n).astype(int) + 1, 1, 256)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    plan = pk.solve(histogram, 256)
    held: dict[int, int] = {}
    for times, group in plan:
        assert times > 0 and sum(k * v for k, v in group.items()) <= 256
        for k, v in group.items():
            held[k] = held.get(k, 0) + times * v
    assert held == histogram
    assert sum(t for t, _ in plan) <= max(1, -(-int(lengths.sum()) // 256)) * 1.02 + 1


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "été", "x1", "中文", "\n"]) for _ in range(rng.choice([1, 5, 40, 300]))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (None, "nameless text", "s"), (5, rows[5][1], "s"), (5, rows[5][1], "s"), (102, "<|endoftext|> inside", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = pk.pack(frame, capacity=64, with_ids=True, bucket_rows=5).collect()
    places: dict[int, list] = {}
    docs: dict[tuple, list] = {}
    for r in got:
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    _, exact = pk.encoders("byte_bpe_50k")
    for d, text, _ in rows:
        want = [*exact(text or ""), 0]
        own = sorted(docs[d], key=lambda r: r.piece)
        copies = sum(x[0] == d for x in rows)
        assert [i for r in own[::copies] for i in r.ids] == want
        assert [r.start for r in own[::copies]] == np.cumsum([0, *(r.length for r in own[::copies])])[:-1].tolist()
        assert len(want) > 64 or len(own) == copies
        assert all(r.length == 64 for r in own[copies:]) 
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 64) * 1.05 + 1
    assert pk.pack(frame.limit(0)).count() == 0


def test_program_beats_best_fit():
    """No configuration of these lengths is full (the largest holds 2045), and best fit takes 11,000 sequences."""
    histogram = {1035: 6000, 535: 6000, 523: 6000, 487: 12000}
    assert sum(t for t, _ in pk.best_fit(histogram, 2048)) == 11000
    plan = pk.solve(histogram, 2048)
    held = {n: sum(t * g.get(n, 0) for t, g in plan) for n in histogram}
    assert held == histogram and all(sum(n * k for n, k in g.items()) <= 2048 for _, g in plan)
    solution, bound = pk.fractional(histogram, 2048)
    assert 8990 <= bound <= sum(t for t, _ in solution) <= 1.005 * bound
    assert sum(t for t, _ in plan) <= 9010


@pytest.mark.parametrize("seed", range(3))
def test_program_covers(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(rng.integers(300, 1500, 60), 60000)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    solution, bound = pk.fractional(histogram, 2048)
    assert sum(t for t, _ in pk.solve(histogram, 2048)) <= sum(t for t, _ in pk.best_fit(histogram, 2048))
    for n, k in histogram.items():
        assert sum(t * g.get(n, 0) for t, g in solution) >= k * (1 - 1e-6)
    assert all(sum(n * k for n, k in g.items()) <= 2048 for _, g in solution)
    assert bound <= sum(t for t, _ in solution) <= 1.03 * bound
    assert sum(t for t, _ in pk.solve(histogram, 2048)) <= 1.03 * bound + len(histogram)


def test_added_tokens_are_theirs(spark):
    """Against a tokenizer of its own, with its settings as they come."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "é <|endoftext|> 中文", "<|endoftext|", "plain text"]
    wanted = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert wanted[0] == [64, 220, 50256, 275]
    assert [pk.tokenize(t, "byte_bpe_50k") for t in texts] == wanted
    got = pk.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {i: [*ids, 0] for i, ids in enumerate(wanted)}


def test_program_on_many_lengths():
    """With 1,700 lengths the program still covers all of them, and its plan needs no more than best fit."""
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(5.5, 1.1, 150_000).astype(int) + 1, 1, 2047)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    solution, bound = pk.fractional(histogram, 2048)
    covered = dict.fromkeys(histogram, 0.0)
    for t, g in solution:
        for n, k in g.items():
            covered[n] += t * k
    assert all(covered[n] >= k * (1 - 1e-6) for n, k in histogram.items())
    assert bound <= sum(t for t, _ in solution) <= 1.05 * bound
    plan = pk.solve(histogram, 2048)
    assert bound <= sum(t for t, _ in plan) <= sum(t for t, _ in pk.best_fit(histogram, 2048))
    assert pk.rounded(solution, histogram)[0]


def test_very_long_text(spark):
    text = "word " * 120_000 + "x" * 50_000
    rows = pk.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).collect()
    own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 1)
    n = len(pk.tokenize(text, "byte_bpe_50k")) + 1
    assert sum(x[2] for x in own) == n and all(x[2] == 2048 for x in own[1:]) and [x[0] for x in own] == list(range(len(own)))
