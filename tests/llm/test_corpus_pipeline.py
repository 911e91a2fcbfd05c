"""Each stage against a plain version on that stage's own input."""

import random
import re

import pytest

import corpus_pipeline as cp
from panelloom.llm.packing import tokenize


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"en": [f"the{i}ing" for i in range(400)], "de": [f"sch{i}ung" for i in range(400)]}
    passage = [rng.choice(words["en"]) for _ in range(70)]
    items = [(i, " ".join(rng.sample(words["en"], 40))) for i in range(4)]
    docs = []
    for d in range(40):
        lang = "de" if d % 4 == 3 else "en"
        body = [rng.choice(words[lang]) for _ in range(rng.randint(80, 300))]
        if d in (5, 9, 20):
            body[30:30] = passage
        if d in (6, 14):
            body[10:10] = items[d % 4][1].split()
        docs.append((d, " ".join(body), lang, f"s{d % 3}", 0))
    near = docs[8][1].split()
    near[50] = "edited"
    docs += [(40, " ".join(near), "en", "s0", 0), (41, docs[7][1], "de", "s0", 0), (42, None, "en", "s0", 0), (43, "", "en", "s0", 0), (44, "12 34 !!", "en", "s0", 0), (45, " ".join(passage), "en", "s1", 0), (None, "no id here", "en", "s1", 0), (7, docs[7][1], "de", "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if k else None
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == cp.COLUMNS and dict(docs.dtypes)["n_chars"] == "bigint"
    after = {r.doc_id for r in seen["language"][1].collect()}
    assert after == set(range(42)) | {45}
    before, out = seen["near_duplicates"]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, words_of(t.lower())) for d, t in before.items())}
    gone = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone == {40, 41} and {r.doc_id for r in out.collect()} == set(before) - gone and out.count() == len(before) - len(gone)
    before, out = seen["repeated_passages"]
    least = {}
    for d, t in before.items():
        w = words_of(t)
        for i in range(len(w) - 49):
            least[tuple(w[i : i + 50])] = min(least.get(tuple(w[i : i + 50]), d), d)
    want = {}
    for d, t in before.items():
        w, drop = words_of(t), set()
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                drop.update(range(i, i + 50))
        if len(drop) < len(w):
            want[d] = " ".join(x for i, x in enumerate(w) if i not in drop) if drop else t
    assert 45 not in want and {r.doc_id: r.text for r in out.collect()} == want
    assert all(r.n_chars == len(r.text) for r in out.collect())
    before, out = seen["decontamination"]
    assert {r.doc_id for r in out.collect()} == set(before) - {6, 14}
    before, out = seen["packing"]
    rows = out.collect()
    for d, t in before.items():
        assert sum(r.length for r in rows if r.doc_id == d) == len(tokenize(t, "byte_bpe_50k")) + 1


def test_run(spark, folder):
    assert {r.doc_id for r in cp.run(spark, folder).collect()} == set(range(40)) - {6, 14}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_ids(spark, folder):
    """Rows of one id with unrelated texts both stay, with their own texts; equal rows are one."""
    long_ = lambda c: " ".join(f"{c}{i}" for i in range(70))
    rows = [(9, long_("a")), (9, long_("b")), (9, long_("b")), (3, long_("c")), (12, long_("c")), (15, long_("d") + " " + long_("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = cp.near_duplicate(spark, docs, folder).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(i, t) for i, t in rows if i != 12})
    twice = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows if i != 12] + [(15, rows[-1][1], "en", "s", 0)], SCHEMA)
    out = cp.repeated_passages(spark, twice, folder).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([*rows[:4], (15, long_("d")), (15, long_("d"))])


def test_empty_and_extra_columns(spark, folder):
    none = spark.createDataFrame([], SCHEMA + ", word string, node long, spans string")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, none, folder)
        assert out.count() == 0, name
        assert k == 4 or out.columns == cp.COLUMNS
    one = spark.createDataFrame([(1, "the1ing the2ing " * 3000, "en", "s", 0, "w", 5, "x"), (2, None, None, None, None, None, None, None)], SCHEMA + ", doc string, node long, spans string")
    docs = one
    for _, stage in cp.STAGES[1:4]:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} == {1, 2}


def test_unread_results_outlive_the_stages(spark, folder):
    """A stage drops what the pipeline kept, not what others have yet to read."""
    from panelloom.llm.substring_dedup import remove_repeated_words

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    mine = remove_repeated_words(docs)
    cp.decontaminate(spark, docs, folder).count()
    cp.language(spark, docs, folder).count()
    assert mine.count() == docs.count()
