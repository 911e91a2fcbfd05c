"""Base places against brute force, and what the rules add."""

import random
import re

import pytest

from panelloom.llm.license_rules import BASE, all_rules, detections, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    at, labels = [], set()
    for p, label in BASE.items():
        want = p.split()
        for i in range(len(w)):
            if w[i : i + len(want)] == want:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base(spark):
    rng = random.Random(1)
    vocabulary = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "é", "mité", "x"]
    rows = [(i, rng.choice([" ", "-", "\n", ". "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    full = ["Under the MIT License!", "apache license, version 2", "CC-BY-NC", "cc by nc cc by nc", "éunder the mit license", "under the mit licenses", "UNDER\x00the mit\nlicense"]
    rows += [(100 + i, " ".join(rng.choice(full + vocabulary) for _ in range(9))) for i in range(80)]
    rows += [(300 + i, t) for i, t in enumerate([*full, None, "", "İstanbul ſ"])] + [(None, full[0]), (100, full[0]), (100, full[0])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string").repartition(3)
    got = scan_licenses(frame).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(key((i, *brute(t))) for i, t in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert scan_licenses(frame.limit(0)).count() == 0


def test_rules():
    rules = all_rules()
    assert len(rules) >= 250
    found = lambda t: [(r.label, r.priority) for *_, r in detections(t.lower().encode(), rules, {})]
    assert found("// SPDX-License-Identifier: Apache-2.0") == [("apache-2", 100)]
    assert found("Licensed under the Apache License, Version 2.0 (the License)") == [("apache-2", 70)]
    assert found("see https://creativecommons.org/licenses/by-nc-sa/4.0/") == [("cc-by-nc-sa", 90)]
    assert [x[0] for x in found("Released under the terms of the GNU General Public License version 3, not the MIT license")] == ["gpl-3", "mit"]
    assert found("CC BY-NC-SA 4.0 license")[0][0] == "cc-by-nc-sa" and len(found("CC BY-NC-SA 4.0 license")) == 1
    assert found("nothing of the kind, submit it under the bridge") == []
    wide = found("all rights reserved " * 2000)
    assert len(wide) == 2000


BSD = """Copyright (c) 2001, A. All rights reserved. Redistribution and use in source and binary forms are permitted provided that:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions in the documentation.
"""
GRANT = "the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("text", "labels"), [
    (BSD + "THIS SOFTWARE IS PROVIDED AS IS", {"bsd-2-clause"}),
    (BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse", {"bsd-3-clause"}),
    (BSD + "3. All advertising materials mentioning features must display this. 4. Neither the name of X may be used", {"bsd-4-clause"}),
    (GRANT.format("GNU Affero General Public License", 3), {"agpl-3"}),
    (GRANT.format("GNU Lesser General Public License", "2.1"), {"lgpl-2.1"}),
    (GRANT.format("GNU General Public License", 2), {"gpl-2"}),
    ("either version 3 of the contract or any later version", set()),
    ("It was released under the MIT campus program last year", set()),
    ("released under the MIT license", {"mit"}),
    ("It is distributed under MIT.", {"mit"}),
    ("licensed under MIT and Apache-2.0", {"mit"}),
    ("published under the ISC board", set()),
    ("This library uses the Ruby license.", {"ruby"}),
    ("the JSON license", {"json"}),
    ("All rights reserved.", {"proprietary"}),
    ("(c) X. All rights reserved. Licensed under the zlib license", {"zlib"}),
    ("", set()),
])
def test_which_licence(text, labels):
    found = {r.label for *_, r in detections(text.lower().encode(), all_rules(), {})}
    assert found == labels


def test_very_long_text(spark):
    text = "gnu general public license " * 20_000 + "neither the name of " * 5000 + "x" * 100_000 + " under the MIT license"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = scan_licenses(frame).first()
    assert row.n_base == 1 and "mit" in row.labels.split(",")
