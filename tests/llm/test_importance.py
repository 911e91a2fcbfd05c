"""Resampling: the k-th key, weights by brute force, and separation on the given labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelloom.llm import textcore as tc
from panelloom.llm.importance import BUCKETS, kth_largest, resample


def test_kth(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 100) for _ in range(3000)] + [5.0] * 40
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 500, 1500, 3039, 3040):
        low = kth_largest(frame, k, bins=16, rounds=40)
        want = sorted(values, reverse=True)[k - 1]
        assert low <= want and sum(v >= low for v in values) == sum(v >= want for v in values)


def test_separation(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    kept = {r.doc_id for r in resample(docs, labels).collect()}
    rows = labels.collect()
    good = [r.doc_id for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.doc_id for r in rows if r.quality == 0]
    assert sum(d in kept for d in good) / len(good) > 0.95
    assert sum(d in kept for d in junk) / len(junk) < 0.25


def test_defined_results(spark):
    rows = [(i, "good words here " * 5, "x") for i in range(10)] + [(i, "bad junk spam " * 5, "x") for i in range(10, 20)]
    rows += [(30, None, "x"), (31, "", "x"), (None, "good words here", "x"), (3, "good words here " * 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, int(i < 10), 0) for i in range(20)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = resample(docs, labels, fraction=0.5).collect()
    assert len(got) >= 11 and sum(1 for r in got if r.doc_id is None or r.doc_id < 10) >= 10
    assert not {30, 31} & {r.doc_id for r in got}
    assert len(resample(docs, labels.limit(0)).collect()) == 22
    assert resample(docs.limit(0), labels).count() == 0


def grams_of(text):
    """Buckets of a text's words and pairs of words, one word at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    codes = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        codes.append(tc.content_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    pairs = [tc.mix(tc.shingle_hashes(np.array(codes[i : i + 2], np.uint64), 2) + np.uint64(1))[0] for i in range(len(codes) - 1)]
    return [int(h) >> 48 for h in codes + pairs]


def test_weights_by_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(60)]
    rows = [(i, rng.choice([" ", "\n\t"]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(70, None), (71, "")]
    labels = [(i, int(i % 3 == 0), int(i % 6 == 0)) for i in range(40)]
    target, raw = Counter(), Counter()
    for i, t in rows:
        own = grams_of(t)
        raw.update(own)
        if any(d == i and q == 1 and x == 0 for d, q, x in labels):
            target.update(own)
    p = lambda c, b: math.log((c[b] + 1) / (c.total() + BUCKETS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fraction=1.0).collect()}
    assert set(got) == {i for i, t in rows if grams_of(t)}
    for i, t in rows:
        if i in got:
            own = grams_of(t)
            assert got[i].n_ngrams == len(own)
            assert got[i].log_weight == pytest.approx(sum(p(target, b) - p(raw, b) for b in own), abs=1e-9)
    keys = sorted((r.key for r in got.values()), reverse=True)
    half = resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fraction=0.5).collect()
    assert sorted((r.key for r in half), reverse=True) == keys[: math.ceil(0.5 * len(keys))]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "good words here " * 150_000), (2, "bad " * 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_ngrams for r in resample(docs, labels, fraction=1.0).collect()} == {1: 899_999, 2: 19}
