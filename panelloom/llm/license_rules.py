"""License detection by ordered signature rules: op7.

Hundreds of regular expressions: addresses, sentences and notices written by hand for one licence or family each, and the
forms in which a licence is named (a tag, a grant, a title) over a table of names. Each rule has keywords that a match must
hold, and is tried only on texts that hold them (the prefilter), a priority by its form, and a score. Of two detections the
one whose interval lies within the other's goes, unless its priority is higher; of equal intervals the higher priority
stays, then the earlier rule. Weak rules ("all rights reserved" and the like) count only in texts where no other rule does.

A name that could be anything else (mit, isc, zlib) makes a grant only if a licence, a sentence's end or another licence
follows it; sentences that several licences share name the one by what stands near them.

Base labels are found apart from that: the words of a phrase, standing one after another. They always stay.

Defined results: null text is empty, has no words and no labels; texts are looked at whole; a null id is kept as it is;
repeated rows yield a row each; other columns are not looked at; an empty table yields no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import textcore as tc
from panelloom.runtime import ship_package

#: Label, then the names a licence goes by, as words.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NAMES: dict[str, list[str]] = {
    "mit": ["mit", "expat", "x11"],
    "mit-0": ["mit no attribution", "mit 0"],
    "apache-1.1": ["apache software license 1 1", "apache 1 1"],
    "apache-2": ["apache license 2 0", "apache 2 0", "apache software license 2 0", "apache license version 2 0"],
    "bsd-2-clause": ["bsd 2 clause", "simplified bsd", "freebsd", "two clause bsd"],
    "bsd-3-clause": ["bsd 3 clause", "new bsd", "modified bsd", "three clause bsd"],
    "bsd-4-clause": ["bsd 4 clause", "original bsd", "four clause bsd"],
    "0bsd": ["0bsd", "zero clause bsd"],
    "isc": ["isc"],
    "zlib": ["zlib", "zlib libpng"],
    "gpl-1": ["gnu general public license version 1", "gpl 1 0", "gplv1"],
    "gpl-2": ["gnu general public license version 2", "gpl 2 0", "gplv2", "gnu gpl 2"],
    "gpl-3": ["gnu general public license version 3", "gpl 3 0", "gplv3", "gnu gpl 3"],
    "lgpl-2.1": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"],
    "lgpl-3": ["gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"],
    "agpl-3": ["gnu affero general public license version 3", "agpl 3 0", "agplv3"],
    "mpl-1.1": ["mozilla public license 1 1", "mpl 1 1"],
    "mpl-2": ["mozilla public license 2 0", "mozilla public license version 2 0", "mpl 2 0"],
    "epl-1": ["eclipse public license 1 0", "epl 1 0"],
    "epl-2": ["eclipse public license 2 0", "epl 2 0"],
    "cddl-1": ["common development and distribution license 1 0", "cddl 1 0"],
    "cpl-1": ["common public license 1 0", "cpl 1 0"],
    "eupl-1.2": ["european union public licence 1 2", "eupl 1 2"],
    "artistic-1": ["artistic license 1 0", "perl artistic"],
    "artistic-2": ["artistic license 2 0"],
    "boost-1": ["boost software license 1 0", "bsl 1 0"],
    "unlicense": ["the unlicense", "unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "cc0-1": ["cc0 1 0", "cc0", "creative commons zero"],
    "cc-by": ["cc by 4 0", "cc by 3 0", "creative commons attribution 4 0", "creative commons attribution"],
    "cc-by-sa": ["cc by sa 4 0", "cc by sa 3 0", "cc by sa", "creative commons attribution sharealike"],
    "cc-by-nd": ["cc by nd 4 0", "cc by nd", "creative commons attribution noderivatives"],
    "cc-by-nc": ["cc by nc 4 0", "cc by nc 3 0", "creative commons attribution noncommercial"],
    "cc-by-nc-sa": ["cc by nc sa 4 0", "cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd 4 0", "cc by nc nd", "creative commons attribution noncommercial noderivatives"],
    "odbl-1": ["open database license 1 0", "odbl 1 0"],
    "ofl-1.1": ["sil open font license 1 1", "ofl 1 1"],
    "psf-2": ["python software foundation license", "psf license 2"],
    "postgresql": ["postgresql"],
    "openssl": ["openssl"],
    "php-3": ["php license 3 01", "php 3 0"],
    "ruby": ["ruby license"],
    "vim": ["vim license"],
    "ms-pl": ["microsoft public license", "ms pl"],
    "ms-rl": ["microsoft reciprocal license", "ms rl"],
    "afl-3": ["academic free license 3 0", "afl 3 0"],
    "osl-3": ["open software license 3 0", "osl 3 0"],
    "bsl-1.1": ["business source license 1 1", "busl 1 1"],
    "sspl-1": ["server side public license", "sspl 1 0"],
    "elastic-2": ["elastic license 2 0"],
    "llama": ["llama community license"],
    "openrail": ["openrail m", "bigscience openrail"],
    "ncsa": ["university of illinois ncsa open source license", "ncsa"],
    "upl-1": ["universal permissive license 1 0", "upl 1 0"],
    "json": ["json license"],
    "gfdl-1.3": ["gnu free documentation license 1 3", "gfdl 1 3"],
}
#: Sentences of licences and notices that stand in one of them only.
SENTENCES: dict[str, list[str]] = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "apache-2": [
        "you may not use this file except in compliance with the license",
        "terms and conditions for use reproduction and distribution",
        "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version 1 1"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl-1": ["the accompanying program is provided under the terms of this eclipse public license"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "cddl-1": ["the contents of this file are subject to the terms of the common development and distribution license"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
    ],
    "boost-1": ["boost software license version 1 0 august 17th 2003", "a copy of the software and accompanying documentation covered by this license"],
    "cc0-1": ["has waived all copyright and related or neighboring rights", "the person who associated a work with this deed has dedicated the work to the public domain"],
    "cc-by": ["you must give appropriate credit provide a link to the license and indicate if changes were made"],
    "cc-by-sa": ["if you remix transform or build upon the material you must distribute your contributions under the same license as the original"],
    "cc-by-nd": ["if you remix transform or build upon the material you may not distribute the modified material"],
    "cc-by-nc": ["you may not use the material for commercial purposes"],
    "wtfpl": ["you just do what the fuck you want to"],
    "artistic-2": ["the intent is that the copyright holder maintains some artistic control over the development of that package"],
    "ofl-1.1": ["this font software is licensed under the sil open font license", "the font software may be sold as part of a larger software package but no copy"],
    "psf-2": ["psf is making python available to licensee on an as is basis"],
    "openssl": ["this product includes software developed by the openssl project for use in the openssl toolkit"],
    "php-3": ["this product includes php software freely available from"],
    "json": ["the software shall be used for good not evil"],
    "sspl-1": ["offering the program as a service includes making the service source code available"],
    "bsl-1.1": ["the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"],
    "elastic-2": ["you may not provide the software to third parties as a hosted or managed service"],
    "postgresql": ["in no event shall the university of california be liable to any party for direct indirect special incidental"],
    "vim": ["there are no restrictions on distributing unmodified copies of vim"],
    "gfdl-1.3": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
    "beerware": ["if we meet some day and you think this stuff is worth it you can buy me a beer in return"],
    "proprietary": ["unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file is strictly prohibited", "proprietary and confidential"],
    "public-domain": ["this work is in the public domain", "dedicated to the public domain", "has been placed in the public domain"],
}
#: Sentences that also stand beside other licences, and say something only alone.
WEAK: dict[str, list[str]] = {
    "proprietary": ["all rights reserved", "for internal use only", "no part of this publication may be reproduced"],
    "public-domain": ["released into the public domain"],
}
ADDRESSES: dict[str, list[str]] = {
    "mit": ["opensource.org/licenses/mit"],
    "apache-2": ["apache.org/licenses/license-2.0"],
    "gpl-3": ["gnu.org/licenses/gpl-3.0"],
    "gpl-2": ["gnu.org/licenses/old-licenses/gpl-2.0"],
    "lgpl-3": ["gnu.org/licenses/lgpl-3.0"],
    "agpl-3": ["gnu.org/licenses/agpl-3.0"],
    "mpl-2": ["mozilla.org/mpl/2.0"],
    "epl-2": ["eclipse.org/legal/epl-2.0"],
    "unlicense": ["unlicense.org"],
    "cc0-1": ["creativecommons.org/publicdomain/zero"],
    "cc-by": ["creativecommons.org/licenses/by/"],
    "cc-by-sa": ["creativecommons.org/licenses/by-sa/"],
    "cc-by-nd": ["creativecommons.org/licenses/by-nd/"],
    "cc-by-nc": ["creativecommons.org/licenses/by-nc/"],
    "cc-by-nc-sa": ["creativecommons.org/licenses/by-nc-sa/"],
    "cc-by-nc-nd": ["creativecommons.org/licenses/by-nc-nd/"],
}
GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BEFORE, _AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
#: What follows a licence's name that is nothing else: a licence, a version, the end of a clause or of the text, another one.
_NAMED = rb"(?=[ \t\r\n]*(?:[.,;:)\]\"'/|&]|$)|" + GAP + rb"(?:style" + GAP + rb")?(?:licen[sc]es?|terms|v?[0-9]|and|or|see|as|by|by the)(?![0-9a-z\x80-\xff]))"
#: Families of one sentence. The family's name stands within so many bytes before its version clause.
_GNU = {"gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl"}
_VERSIONS = {"1": "1", "2": "2", "2 1": "2.1", "3": "3"}
_NEAR = 300
#: A BSD licence is what its clauses are, and all begin alike.
_BSD_START = "redistributions in binary form must reproduce the above copyright notice"
_BSD_NAMES, _BSD_ADVERTS = rb"neither" + GAP + rb"the" + GAP + rb"names?" + GAP + rb"of", rb"all" + GAP + rb"advertising" + GAP + rb"materials" + GAP + rb"mentioning"
_BSD_REACH = 1200


@dataclass(frozen=True)
class Rule:
    """keywords: a match holds all of these. weak: counts only where no other rule does."""

    label: str
    pattern: re.Pattern
    keywords: tuple[bytes, ...]
    priority: int
    score: float
    weak: bool = False


def phrase(words: str) -> bytes:
    return GAP.join(re.escape(w.encode()) for w in words.split())


def _rule(label: str, body: bytes, keywords: tuple[str, ...], priority: int, score: float) -> Rule:
    return Rule(label, re.compile(_BEFORE + body + _AFTER), tuple(k.encode() for k in keywords), priority, score)


def _family_rules() -> list[Rule]:
    """Version clauses of the GNU licences by the name before them, and BSD licences by their clauses."""
    out = []
    for name, short in _GNU.items():
        for version, label in _VERSIONS.items():
            if (short, label) in {("gpl", "1"), ("gpl", "2"), ("gpl", "3"), ("lgpl", "2"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3")}:
                # no other GNU licence is named between the name and its version
                between = rb"(?:(?!gnu" + GAP + rb")[\x00-\xff]){0,%d}?" % _NEAR
                body = phrase(name) + between + rb"version" + GAP + phrase(version) + rb"(?!\.?[0-9])"
                out.append(_rule(f"{short}-{label}", body, (name.split()[1], "version"), 60, 0.95))
    start = phrase(_BSD_START)
    near = rb"(?=[\x00-\xff]{0,%d}?" % _BSD_REACH
    names, adverts = near + _BSD_NAMES + rb")", near + _BSD_ADVERTS + rb")"
    not_names, not_adverts = names.replace(b"(?=", b"(?!", 1), adverts.replace(b"(?=", b"(?!", 1)
    for label, tail in (("bsd-4-clause", adverts), ("bsd-3-clause", not_adverts + names), ("bsd-2-clause", not_adverts + not_names)):
        out.append(_rule(label, start + tail, ("redistributions", "reproduce"), 80, 0.95))
    return out


def all_rules() -> list[Rule]:
    """The rules in order: addresses, tags, sentences, families, grants, titles, weak sentences."""
    out = []
    for label, listed in ADDRESSES.items():
        out += [Rule(label, re.compile(re.escape(a.encode())), (a.encode(),), 90, 1.0) for a in listed]
    for label, names in NAMES.items():
        for name in names:
            out.append(_rule(label, rb"spdx-license-identifier:[ \t]*" + phrase(name), ("spdx", max(name.split(), key=len)), 100, 1.0))
    for label, listed in SENTENCES.items():
        out += [_rule(label, phrase(s), (max(s.split(), key=len),), 80, 0.95) for s in listed]
    out += _family_rules()
    verbs = rb"(?:licen[sc]ed|released|distributed|available|published|provided)"
    for label, names in NAMES.items():
        for name in names:
            rare = max(name.split(), key=len)
            under = GAP + rb"under" + GAP + rb"(?:the" + GAP + rb")?(?:terms" + GAP + rb"of" + GAP + rb")?(?:the" + GAP + rb"|an?" + GAP + rb")?"
            plain = "licen" not in name and not any(c.isdigit() for c in name.split()[-1])
            out.append(_rule(label, verbs + under + phrase(name) + (_NAMED if plain else b""), ("under", rare), 70, 0.9))
            if "licen" not in name:
                out.append(_rule(label, phrase(name) + GAP + rb"licen[sc]e", ("licen", rare), 50, 0.7))
            else:
                out.append(_rule(label, phrase(name), (rare, "licen"), 50, 0.7))
    for label, listed in WEAK.items():
        out += [Rule(label, re.compile(_BEFORE + phrase(s) + _AFTER), (max(s.split(), key=len).encode(),), 10, 0.5, True) for s in listed]
    return out


def detections(text: bytes, rules: list[Rule], present: dict[bytes, bool]) -> list[tuple[int, int, Rule]]:
    """Matches in lower-cased text after suppression. present: keywords looked up so far."""
    found = []
    for order, rule in enumerate(rules):
        ok = True
        for k in rule.keywords:
            here = present.get(k)
            if here is None:
                here = present[k] = k in text
            if not here:
                ok = False
                break
        if ok:
            found += [(m.start(), m.end(), order, rule) for m in rule.pattern.finditer(text)]
    # an interval that holds another one comes before it; equal ones by priority, then by the order of rules
    found.sort(key=lambda x: (x[0], -x[1], -x[3].priority, x[2]))
    reach: dict[int, int] = {}  # by priority: how far intervals that began so far go
    kept = []
    for s, e, _, rule in found:
        if all(end < e for priority, end in reach.items() if priority >= rule.priority):
            kept.append((s, e, rule))
        reach[rule.priority] = max(reach.get(rule.priority, 0), e)
    strong = [x for x in kept if not x[2].weak]
    return strong or kept


def scan_licenses(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): spans are [first byte, end, label]
    of what the rules detect in the UTF-8 text."""
    ship_package(frame.sparkSession)
    phrases = BASE if base is None else base

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = all_rules()
        plain = [(re.compile(_BEFORE + phrase(p) + _AFTER), max(p.split(), key=len).encode(), label) for p, label in phrases.items()]
        # a keyword of every rule, so that most texts are done after a few searches
        common = (b"licen", b"under", b"spdx", b"version", b"reserved")
        gates = tuple(sorted({min(r.keywords, key=lambda k: (k not in common, k)) for r in rules}))
        for batch in batches:
            raw, off = tc.string_buffers(batch.column(1))
            out: list[list] = [[], [], [], [], [], [], [], []]
            for lo, hi in tc.row_slices(off):
                low = tc.LOWER[raw[off[lo] : off[hi]]]
                bounds = off[lo : hi + 1] - off[lo]
                starts, _, first = tc.words_of(low, bounds, tc.ALNUM_WORDS)
                whole = low.tobytes()
                for i in range(hi - lo):
                    text = whole[bounds[i] : bounds[i + 1]]
                    places, base_labels = [], set()
                    for pattern, key, label in plain:
                        if key in text:
                            at = [m.start() for m in pattern.finditer(text)]
                            places += at
                            base_labels |= {label} if at else set()
                    found = detections(text, rules, {}) if any(g in text for g in gates) else []
                    words = np.searchsorted(starts[first[i] : first[i + 1]] - bounds[i], sorted(places)).tolist()
                    labels = base_labels | {r.label for *_, r in found}
                    score = max([r.score for *_, r in found] + [0.9] * bool(base_labels), default=0.0)
                    row = (
                        int(first[i + 1] - first[i]),
                        len(places),
                        words[0] if words else None,
                        words[-1] if words else None,
                        ",".join(sorted(base_labels)),
                        ",".join(sorted(labels)),
                        score,
                        [{"start": s, "end": e, "label": r.label} for s, e, r in found],
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            types.append(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc", *names])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    schema = (
        "doc long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " spans array<struct<start:long,end:long,label:string>>"
    )
    own = frame.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return tc.mapped(own, scan, schema).withColumnRenamed("doc", id_col)
