"""Base counts against brute force, the plan's lack of Python, and the verdict on planted documents."""

import random
import re

from panelloom.llm.line_rules import clean_lines


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), base


def texts():
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(rng.choice(["a", "b", "c.", "dé#", "x|y", "z"]) for _ in range(rng.choice([0, 1, 2, 3, 49, 50, 120])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "same line.\n" * 40), (None, "no id " * 30), (3, rows[3][1]), (104, "a " * 9000), (105, "  nb sp  x")]
    return rows


def test_base_counts(spark):
    rows = texts()
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = clean_lines(frame).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(key((i, *brute(t))) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert clean_lines(frame.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = clean_lines(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_verdict(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(n))
    good = [prose(8), prose(20) + "\nHome | Login | About\nAll rights reserved.", prose(6) + "\nreach me at 10.1.2.3 now"]
    bad = [
        "\n".join(" | ".join(word() for _ in range(10)) for _ in range(12)),
        "\n".join(" ".join(word() + "%%%" for _ in range(12)) for _ in range(12)),
        "\n".join(" ".join(word().upper() + "!!" for _ in range(12)) for _ in range(12)),
        "\n".join("We use cookies and a privacy policy " + word() + "." for _ in range(20)) + prose(2),
        "\n".join(" ".join(word() for _ in range(12)) for _ in range(12)),
    ]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(len(rows))] == [True] * 3 + [False] * 5
    assert "Login" not in got[1].text and "rights" not in got[1].text and got[1].n_lines_removed == 2


def test_labelled_documents(spark):
    base = "/root/testdata/sf0.1"
    out = clean_lines(spark.read.parquet(f"{base}/documents.parquet")).drop("text").join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").toPandas()
    clean, junk = out[(out.quality == 1) & ~out.base_failed], out[out.quality == 0]
    assert clean.kept.mean() > 0.995
    assert junk.kept.mean() < 0.1
