"""Licence scans by sentence rules.

A text's sentences (up to ``.``, ``!``, ``?`` or ``;`` before white space, or a line without a letter
or digit) are normalised: lower case, everything but letters, digits and dots inside words becomes one
blank, line breaks and comment marks too, so wrapped headers are whole. Whole lines that are a known
sentence are one by themselves, the most lines first. Known normalised sentences have identifiers; a
rule is an ordered sequence of identifiers. A rule matches where its identifiers follow each other in
the text with at most ``GAP`` other sentences between two. Of overlapping matches the longest wins,
then the first. A ``*`` in a known sentence stands for any words, such as an owner's name.

Null and empty texts have no sentences and no match; an empty table gives no rows. Repeated rows are
scanned alike, very long texts whole; other columns are left aside. Sentences and rules are configuration: parameters of the operator, part of the task.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from agorametrics.llm.common import pieces

GAP = 1

# Known sentences, normalised, by identifier.
SENTENCES = {
    "apache-2.0-notice": "licensed under the apache license version 2.0",
    "apache-2.0-use": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at",
    "bsd-redistribution": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4.0",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-software": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied",
}

# Other forms of these sentences, as they are cut from the licences' own texts.
FORMS = {
    "apache-2.0-notice": (
        "licensed under the apache license version 2.0 the license",
        "the asf licenses this file to you under the apache license version 2.0 the license",
    ),
    "apache-2.0-copy": (
        "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
        "you may obtain a copy of the license at https www.apache.org licenses license 2.0",
    ),
    "bsd-endorse": tuple(
        f"neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for who in ("the university", "the organization", "copyright holder")),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-include": (
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    ),
    "mit-as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
}

# Sentences with a name in them.
FORMS["bsd-endorse"] += (
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "neither the name of * nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission",
)

# Notices of one sentence: licence, and its form.
NOTICES = [
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("MPL-2.0", "mozilla public license 2.0"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at *"),
    ("EPL-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution *"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "distributed under the boost software license version 1.0"),
    ("Zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("WTFPL", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("CC0-1.0", "to the extent possible under law * has waived all copyright and related or neighboring rights to *"),
]
NOTICES += [(f"CC-{kind.upper().replace(' ', '-')}-4.0", form) for kind, name in (
    ("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"),
    ("by nc nd", "attribution noncommercial noderivatives")) for form in (
    f"licensed under cc {kind} 4.0", f"this work is licensed under a creative commons {name} 4.0 international license")]
# The headers of the GNU licences are one form: name, version, the kind of work.
GNU = [("GPL", "gnu general public license", ("1", "2")), ("LGPL", "gnu lesser general public license", ("2.1", "3")),
       ("LGPL", "gnu library general public license", ("2",)), ("AGPL", "gnu affero general public license", ("3",))]
NOTICES += [
    (f"{short}-{version if '.' in version else version + '.0'}",
     f"this {work} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {version} of the license or at your option any later version")
    for short, name, versions in GNU for version in versions for work in ("program", "library", "file")]
# Names that may stand behind SPDX-License-Identifier.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only
GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1
PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL X11 Zlib""".split()
NOTICES += [(re.sub("-(only|or-later)$", "", name), f"spdx license identifier {re.sub('[^0-9a-z.]+', ' ', name.lower())}") for name in SPDX]

# Ordered rules: licence, and the identifiers that make it up.
RULES = [
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-use", "apache-2.0-copy")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-binary", "bsd-endorse")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty")),
    ("GPL-3.0", ("gpl-free", "gpl-hope", "gpl-implied")),
    ("GPL-3.0", ("gpl-software", "gpl-terms", "gpl-hope", "gpl-implied")),
    ("MIT", ("mit-grant", "mit-include", "mit-as-is")),
    ("MIT", ("mit-notice",)),
]
# Some of them write semicolons, which end sentences here.
_TERMS = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_EITHER = "either version {} of the license or at your option any later version"
for _short, _name, _versions in [*GNU, ("GPL", "gnu general public license", ("3",))]:
    SENTENCES[f"gnu-terms-{_name.replace(' ', '-')}"] = _TERMS.format(_name)
    for _version in _versions:
        SENTENCES[f"gnu-either-{_version}"] = _EITHER.format(_version)
        _licence = f"{_short}-{_version if '.' in _version else _version + '.0'}"
        RULES.append((_licence, (f"gnu-terms-{_name.replace(' ', '-')}", f"gnu-either-{_version}")))
        if _licence != "GPL-3.0":
            NOTICES.append((_licence, f"{_TERMS.format(_name)} {_EITHER.format(_version)}"))
for _k, (_licence, _form) in enumerate(NOTICES):
    SENTENCES[f"notice-{_k}-{_licence.lower()}"] = _form
    RULES.append((_licence, (f"notice-{_k}-{_licence.lower()}",)))

_NO_WORD = r"[^0-9A-Za-z\u0080-\U0010ffff\n]"
# a full stop behind one of these ends no sentence
_SHORT = "".join(rf"(?<!\b(?i:{word}))" for word in ("inc", "ltd", "corp", "co", "v"))
_BREAK = re.compile(rf"{_SHORT}[.!?;]+(?=\s|$)|\n(?:{_NO_WORD}*\n)+")
_REST = re.compile(r"[^0-9a-z.\u0080-\U0010ffff]+|\.(?![0-9a-z])|(?<![0-9a-z])\.")


def normalised(sentence: str) -> str:
    return _REST.sub(" ", sentence.lower()).strip()


def form(sentence: str) -> str:
    """A known sentence, normalised around its placeholders."""
    return " * ".join(normalised(part) for part in sentence.split("*")).strip()


class Known:
    """Identifiers by normalised sentence; those with a ``*`` by what stands around it."""

    def __init__(self, by_text: dict[str, str]):
        self.exact = {s: i for s, i in by_text.items() if "*" not in s}
        self.open = [(re.compile(".+?".join(map(re.escape, s.split("*")))), i) for s, i in by_text.items() if "*" in s]
        self.longest = max(map(len, by_text), default=0) + (200 if self.open else 0)  # a name is no longer than that
        words = "|".join(sorted({re.escape(s.split(" ", 1)[0]) for s in by_text}))
        # lines that start like a known sentence: others are never normalised
        self.heads = re.compile(rf"^{_NO_WORD}*(?:{words})(?![0-9A-Za-z])", re.IGNORECASE | re.MULTILINE)

    def get(self, sentence: str) -> str | None:
        found = self.exact.get(sentence)
        if found is None:
            found = next((i for pattern, i in self.open if pattern.fullmatch(sentence)), None)
        return found


def identified(text: str, sentences: Known) -> tuple[int, list[tuple[int, str]]]:
    """How many sentences a text has, and (sentence number, identifier) of the known ones."""
    heads = sentences.heads
    found, at = [], 0
    for sentence in _BREAK.split(text):
        if not sentence or sentence.isspace():
            continue
        if not heads.search(sentence):
            at += 1
            continue
        lines = sentence.split("\n")
        plain: dict[int, str] = {}
        k, other = 0, False
        while k < len(lines):
            known, end, so_far = None, k, ""
            if heads.match(lines[k]):
                for j in range(k, len(lines)):
                    if j not in plain:
                        plain[j] = normalised(lines[j])
                    so_far = f"{so_far} {plain[j]}".strip()
                    if len(so_far) > sentences.longest:
                        break
                    hit = sentences.get(so_far)
                    if hit:
                        known, end = hit, j
            if known:
                at += other
                found.append((at, known))
                at, other = at + 1, False
            else:
                other = other or bool(lines[k].strip())
            k = end + 1
        at += other
    return at, found


def matches(found: list[tuple[int, str]], rules: list[tuple[str, tuple[str, ...]]], gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, first sentence, last sentence) of the matches in (sentence number, identifier)."""
    every = []
    for licence, rule in rules:
        for k in range(len(found) - len(rule) + 1):
            part = found[k:k + len(rule)]
            near = all(b[0] - a[0] <= gap + 1 for a, b in zip(part, part[1:], strict=False))
            if near and tuple(i for _, i in part) == rule:
                every.append((-len(rule), k, licence))
    taken: set[int] = set()
    out = []
    for size, k, licence in sorted(every):
        places = range(k, k - size)
        if taken.isdisjoint(places):
            taken.update(places)
            out.append((licence, found[k][0], found[k - size - 1][0]))
    return sorted(out, key=lambda m: m[1:])


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None, gap: int = GAP,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, identifiers (in order), matches (licence, first, last) of every document."""
    rules = rules or RULES
    by_text = {form(s): i for i, s in (sentences or SENTENCES).items()}
    if not sentences:
        by_text |= {form(s): i for i, forms in FORMS.items() for s in forms}
    known = Known(by_text)
    kind = "doc_id long, n_sentences long, identifiers array<string>, matches array<struct<licence:string,first:long,last:long>>"

    def run(batches):
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("identifiers", pa.list_(pa.string())),
            ("matches", pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))])
        for batch in pieces(batches):
            n, identifiers, found_ = [], [], []
            for own in batch.column(1).to_pylist():
                at, found = identified(own or "", known)
                n.append(at)
                identifiers.append([i for _, i in found])
                found_.append([dict(zip(("licence", "first", "last"), m, strict=True)) for m in matches(found, rules, gap)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(identifiers, schema.field(2).type), pa.array(found_, schema.field(3).type)], schema=schema)

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, kind)
