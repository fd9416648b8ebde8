"""Parts that need no Spark: bytes, words, hashes, codes."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from agorametrics.llm import common, decontaminate, forest, licenses, quality, repeats


def of(texts):
    return common.raw(pa.array(texts, pa.string()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**34), max_size=50))
def test_short_numbers_come_back(numbers):
    data, size = common.short(np.array(numbers, np.int64))
    assert common.long(data).tolist() == numbers and size.sum() == data.size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1 é.\n-", max_size=12)), max_size=6))
def test_words_never_cross_texts(texts):
    import re

    found, first = decontaminate.words(*of(texts))
    got = [w.decode() for w in found.to_pylist()]
    want = [re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    assert [got[a:b] for a, b in zip(first[:-1], first[1:])] == want


def test_slices_of_batches_keep_their_texts():
    batch = pa.record_batch({"text": pa.array(["ab", None, "", "cdé", "f" * 40])})
    parts = list(common.pieces([batch, batch.slice(0, 0)], most=4))
    assert [x for p in parts for x in p.column(0).to_pylist()] == ["ab", None, "", "cdé", "f" * 40]
    data, offsets = common.raw(batch.column(0).slice(2, 2))
    assert data.tobytes().decode() == "cdé" and offsets.tolist() == [0, 0, 4]


def test_word_hash_depends_on_the_word_only():
    data, offsets = of(["xx yy xx", "yy"])
    starts, ends = common.spans(common.WORD[data], offsets)
    h = common.word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=260), min_size=1, max_size=5), st.integers(0, 3))
def test_run_ends_mark_what_repeats(texts, copies):
    """All contexts in one group: every byte of a repeated window is marked and no other."""
    texts = sorted({t for t in texts if len(t) >= 20} | {"ab" * 15 + t for t in texts[:copies]})
    if not texts:
        return
    length = 20
    data, first = of(texts)
    x, y, match = repeats.run_ends(data, first, np.zeros(len(texts), np.int64), length)
    gone = np.zeros(data.size, bool)
    for p, m in zip(np.concatenate([x, y]), np.concatenate([match, match])):
        gone[p:p + m] = True
    want = np.zeros(data.size, bool)
    windows = {}
    for t, a in zip(texts, first):
        for i in range(len(t) - length + 1):
            windows.setdefault(t[i:i + length], []).append(a + i)
    for places in windows.values():
        if len(places) > 1:
            for p in places:
                want[p:p + length] = True
    assert (gone == want).all()


def test_places_are_alike_for_equal_windows_whatever_the_parts(monkeypatch):
    rng = np.random.default_rng(1)
    shared = "".join(rng.choice(list("abcdef "), 700))
    texts = ["x" * 50 + shared + "q", shared + "y" * 900, "z" * 199, ""]
    data, offsets = of(texts)

    def windows(part):
        monkeypatch.setattr(repeats, "PART", part)
        out = set()
        for text, at, size, fp, _ in repeats.places(data, offsets, 200, 32):
            for t, a, s, f in zip(text, at, size, fp):
                out |= {(int(t), int(a) + i, int(f)) for i in range(s - 199)}
        return out

    whole = windows(1 << 20)
    assert whole == windows(300) == windows(77)
    assert {(t, a) for t, a, _ in whole} == {(t, i) for t, x in enumerate(texts) for i in range(len(x) - 199)}
    first = {a - 50: f for t, a, f in whole if t == 0}
    second = {a: f for t, a, f in whole if t == 1}
    assert all(first[i] == second[i] for i in range(501))


def test_ranges_unite():
    of_, s, e = repeats.united(np.array([1, 0, 0, 0, 1]), np.array([5, 0, 3, 10, 2]), np.array([9, 3, 7, 12, 4]))
    assert list(zip(of_.tolist(), s.tolist(), e.tolist())) == [(0, 0, 7), (0, 10, 12), (1, 2, 4), (1, 5, 9)]


def test_prefixes_shorten_until_the_recall_is_met():
    lengths = [forest.prefix_length(0.8, r) for r in (0.5, 0.99, 0.9999, 0.9999999)]
    assert lengths == sorted(lengths, reverse=True) and lengths[0] == forest.DEPTH
    k = forest.prefix_length()
    assert 1 - (1 - 0.8**k) ** forest.TREES >= forest.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** forest.TREES


def test_shingle_sets():
    values, first = forest.sets(*of(["a b c d e f", "A, b. c d e f!", "a b", "", "a b c d e f a b c d e f", None]))
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 1, 0, 6, 0] and sets[0] < sets[4]


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(3)
    chain = np.array([0, 0, 0, 0, 1, 2, 2])
    z, steps = rng.normal(size=7), rng.normal(size=(2, 2))
    good, joint = quality.marginals(z, chain, steps)
    for c in np.unique(chain):
        at = np.flatnonzero(chain == c)
        total, mean, pair = 0.0, np.zeros(at.size), np.zeros((at.size, 2, 2))
        for code in range(2**at.size):
            y = [(code >> i) & 1 for i in range(at.size)]
            weight = np.exp(sum(z[a] * v for a, v in zip(at, y)) + sum(steps[a, b] for a, b in zip(y, y[1:])))
            total += weight
            mean += weight * np.array(y)
            for i in range(1, at.size):
                pair[i, y[i - 1], y[i]] += weight
        assert np.allclose(good[at], mean / total) and np.allclose(joint[at], pair / total)


def test_near_phrases_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = rng.integers(0, 4, 40)
        lengths = [15, 25]
        bounds = np.array([0, 16])
        at = np.concatenate([np.arange(15), 16 + np.arange(25)])
        phrase, slop = rng.integers(0, 4, 3), int(rng.integers(0, 4))
        places = [at[words == w] for w in phrase]
        if any(p.size == 0 for p in places):
            continue
        low, high = decontaminate.near(places, slop, bounds)
        want = {(a, c + 1) for a in places[0] for b in places[1] for c in places[2]
                if a < b < c and c - a < 3 + slop and np.searchsorted(bounds, a, "right") == np.searchsorted(bounds, c, "right")}
        got = set(zip(low.tolist(), high.tolist()))
        assert got <= want and bool(got) == bool(want) and sum(lengths) == 40
        exact = decontaminate.exact(places)
        assert set(exact.tolist()) == {a for a, c in want if c - a == 3}


def test_licence_rules():
    text = ("Intro line.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "
            "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. Licensed under the Apache License, Version 2.0.")
    known = {licenses.normalised(s): i for i, s in licenses.SENTENCES.items()}
    found = [(n, known[licenses.normalised(s)]) for n, s in enumerate(licenses._BREAK.split(text)) if licenses.normalised(s) in known]
    assert [m[0] for m in licenses.matches(found, licenses.RULES)] == ["MIT", "Apache-2.0"]
    assert licenses.matches([(0, "mit-grant"), (9, "mit-include"), (10, "mit-as-is")], licenses.RULES) == []
    assert licenses.matches([(3, "apache-2.0-notice"), (4, "apache-2.0-use"), (6, "apache-2.0-copy")], licenses.RULES) == [("Apache-2.0", 3, 6)]


@pytest.mark.parametrize("rows", [[], [(0, "mit-notice"), (1, "mit-notice")]])
def test_every_occurrence_counts(rows):
    assert len(licenses.matches(rows, licenses.RULES)) == len(rows)


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_2 = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ALL_APACHE = ["apache-2.0-notice", "apache-2.0-use", "apache-2.0-copy"]
GENUINE = [
    (MIT, "MIT", ["mit-grant", "mit-include", "mit-as-is"]),
    (BSD_2 + BSD_END, "BSD-2-Clause", ["bsd-redistribution", "bsd-binary"]),
    (BSD_3 + BSD_END, "BSD-3-Clause", ["bsd-redistribution", "bsd-binary", "bsd-endorse"]),
    (GPL, "GPL-3.0", ["gpl-free", "gpl-hope", "gpl-implied"]),
    (GPL.replace("software:", "software;"), "GPL-3.0", ["gpl-software", "gpl-terms", "gpl-hope", "gpl-implied"]),
    (APACHE, "Apache-2.0", ALL_APACHE),
]


def identified(text):
    known = {licenses.form(s): i for i, s in licenses.SENTENCES.items()}
    known |= {licenses.form(s): i for i, forms in licenses.FORMS.items() for s in forms}
    return licenses.identified(text, licenses.Known(known))


@pytest.mark.parametrize("text, licence, ids", GENUINE)
@pytest.mark.parametrize("mark, end", [("", "\n"), ("# ", "\n"), (" * ", "\n"), ("// ", "\r\n"), (None, "\n")])
def test_genuine_headers(text, licence, ids, mark, end):
    if mark is None:  # wrapped elsewhere
        import textwrap

        text = "\n\n".join(textwrap.fill(" ".join(p.split()), 50) for p in text.split("\n\n"))
    n, found = identified("".join((mark or "") + line + end for line in text.split("\n")))
    assert [i for _, i in found] == ids and [m[0] for m in licenses.matches(found, licenses.RULES)] == [licence]
    assert found[-1][0] < n


def test_lines_and_sentences():
    assert identified("A title\nReleased under the MIT License\nand more of it\nover lines. Released under\nthe MIT License") == (4, [(1, "mit-notice"), (3, "mit-notice")])
    assert identified("It was not\nreleased under the MIT License before.") == (1, [])
    assert identified("MIT License\n" + MIT.split("\n\n")[2])[1] == [(1, "mit-grant")]
    assert identified("one\n***\ntwo\nstill two") == (2, [])
    assert identified("") == (0, []) and identified(" \n\n ") == (0, [])


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""


@pytest.mark.parametrize(("text", "licence"), [
    (BSD, ["BSD-2-Clause"]),
    (BSD + """   * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""", ["BSD-3-Clause"]),
    (BSD + "3. The name of the author may not be used to endorse or promote products derived\nfrom this software without specific prior written permission.", ["BSD-3-Clause"]),
    ("// SPDX-License-Identifier: MIT\nint main;", ["MIT"]), ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]), ("/* SPDX-License-Identifier: LGPL-2.1-only */", ["LGPL-2.1"]),
    ("SPDX-License-Identifier: NOT-A-LICENCE", []), ("The Mozilla Public License 2.0 is long", []), ("Mozilla Public License, version 2.0.", ["MPL-2.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed", ["MPL-2.0"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.", ["GPL-2.0"]),
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("Neither the name of the game nor the rules are clear.", []),
])
def test_notices_and_owners(text, licence):
    _, found = identified(text)
    assert [m[0] for m in licenses.matches(found, licenses.RULES)] == licence


def test_matches_equal_brute_force():
    """Every way to lay rules over the identifiers, longest first, then the first."""
    import random

    r = random.Random(2)
    names = ["a", "b", "c"]
    rules = [("X", ("a", "b")), ("Y", ("a", "b", "c")), ("Z", ("c",)), ("W", ("b", "b"))]
    for _ in range(400):
        found, at = [], 0
        for _ in range(r.randint(0, 9)):
            at += r.randint(1, 3)
            found.append((at, r.choice(names)))
        spots = []
        for licence, rule in rules:
            for k in range(len(found)):
                part = found[k:k + len(rule)]
                if [i for _, i in part] == list(rule) and all(q - p <= licenses.GAP + 1 for (p, _), (q, _) in zip(part, part[1:], strict=False)):
                    spots.append((len(rule), k, licence))
        free, want = set(range(len(found))), []
        while spots:
            size, k, licence = min(spots, key=lambda s: (-s[0], s[1], s[2]))
            spots.remove((size, k, licence))
            if set(range(k, k + size)) <= free:
                free -= set(range(k, k + size))
                want.append((licence, found[k][0], found[k + size - 1][0]))
        assert licenses.matches(found, rules) == sorted(want, key=lambda m: m[1:])
