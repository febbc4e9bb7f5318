"""License scans by a positional rare-token index.

Words: A-Z lower-cased, runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, over whole texts. Document frequencies of the
template words are counted over all documents (a bounded vocabulary); each template posts its places of highest IDF, so
many (a share of 1 - MATCH of its words, and VOTES more) that a place where MATCH of its words agree gets VOTES votes in
any case. A file looks up all of its words that are posted and intersects the postings by relative position (place in the
file less place in the template). Words may have been put in or left out, so votes count together, and words may agree, within
a band around an offset: `half` places to either side, a sixth of the template's words, 2 to 4. Wherever a band has enough
votes the template is aligned with the file (a longest common subsequence inside the band), and its label is taken if a
mandatory key phrase stands at its place, give or take the band, and MATCH of the template's words agree.
Short fixed phrases (BASE) are found wherever their words stand consecutively; their labels are kept.

Score: the largest agreement of a labelled alignment; 1 if a base phrase stands; 0 without a label.

Defined cases: null text counts as empty (no words, labels ''); a null id is returned as it is; repeated rows get the
same result each; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_parts, table

VOTES, MATCH = 3, 0.75
_DELIMS = bytes(c for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
_TABLE = bytes(0x20 if c in _DELIMS else c for c in range(256))

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Template texts of public licences' notices, with label and key phrases (one of which must stand in place).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("apache license version 2 0",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0", "creative commons attribution 3 0")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0", "cc by nc 3 0", "cc by nc 2 0")),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0", "cc by sa 3 0", "cc by sa 2 0")),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0", "cc by 3 0", "cc by 2 0")),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("creative commons attribution noderivatives",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit", ("creative commons attribution noncommercial",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("permission is granted to anyone to use this software for any purpose",)),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ("any person or organization obtaining a copy",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("artistic", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License", ("artistic license",)),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", ("bsd style license",)),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("copies or substantial portions of the software",)),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", ("unless required by applicable law or agreed to in writing",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0)", ("waived all copyright and related or neighboring rights",)),
    ("bsd", "BSD 3-Clause License", ("bsd 3 clause license", "bsd 2 clause license")),
    ("gpl", "Licensed under the GPLv3", ("gplv3", "gplv2", "gpl v3", "gpl v2")),
    ("lgpl", "Licensed under the LGPLv3", ("lgplv3", "lgplv2", "lgpl v3", "lgpl v2")),
    ("cc0", "Licensed under CC0 1.0", ("cc0 1 0",)),
)

# Short identifiers of licences, with their labels.
SPDX = (
    ("mit", "MIT"), ("isc", "ISC"), ("apache", "Apache-2.0"), ("gpl", "GPL-2.0"), ("gpl", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"), ("mpl", "MPL-2.0"),
    ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("boost", "BSL-1.0"), ("epl", "EPL-2.0"), ("artistic", "Artistic-2.0"), ("wtfpl", "WTFPL"), ("cc0", "CC0-1.0"),
    ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("cc-by-nd", "CC-BY-ND-4.0"),
)
TEMPLATES += tuple((label, f"SPDX-License-Identifier: {name}", (f"spdx license identifier {name}",)) for label, name in SPDX)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def places(found: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of the phrase among the words."""
    n, first = len(phrase), phrase[0]
    out, at = [], -1
    try:
        while True:
            at = found.index(first, at + 1)
            if found[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


class Index:
    """Postings (template, place) of each template's rarest places."""

    def __init__(self, templates, df: dict[bytes, int], n: int):
        self.words = [words(t) for _, t, _ in templates]
        self.labels = [label for label, _, _ in templates]
        self.half = [max(2, min(4, len(t) // 6)) for t in self.words]
        #: Key phrases, and their place less the band, if the template has them itself.
        self.keys = [[(key := words(p), next((i - half for i in places(t, key)), None)) for p in keys] for (_, _, keys), t, half in zip(templates, self.words, self.half)]
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for t in self.words for w in t}
        self.post: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.words):
            rare = sorted(range(len(t)), key=lambda i: (-self.idf[t[i]], t[i], i))
            for i in rare[: math.ceil((1 - MATCH) * len(t)) + VOTES]:
                self.post[t[i]].append((k, i))
        self.rare = frozenset(self.post)

    def aligned(self, found: list[bytes], k: int, offset: int) -> float:
        """Share of template k's words that agree in order within the band around this offset, if a key phrase stands there; else 0."""
        t, half = self.words[k], self.half[k]
        start, n = offset - half, len(found)
        part = found[max(0, start) : max(0, offset + len(t) + half)]
        at = max(0, start)
        if not any(any(low is None or low <= p + at - offset <= low + 2 * half for p in places(part, key)) for key, low in self.keys[k]):
            return 0.0
        width = 2 * half + 1
        best = [0] * (width + 1)  # of the words so far, up to each place of the band; one more for what the band leaves behind
        for i, w in enumerate(t):
            now, left = [0] * (width + 1), 0
            for d in range(width):
                p = start + i + d
                left = max(left, best[d + 1], best[d] + (0 <= p < n and found[p] == w))
                now[d] = left
            now[width] = left
            best = now
        return best[width - 1] / len(t)

    def scan(self, found: list[bytes]) -> dict[str, float]:
        """Labels with their largest agreement."""
        look = self.rare.intersection(found)
        if not look:
            return {}
        votes: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(found):
            if w in look:
                for k, j in self.post[w]:
                    votes[k].append(i - j)
        out: dict[str, float] = {}
        for k, offsets in votes.items():
            need, half = min(VOTES, len(self.words[k])), self.half[k]
            offsets.sort()
            done = None
            for first, last in zip(offsets, offsets[need - 1 :]):
                if last - first <= 2 * half:
                    for offset in range(last - half if done is None else max(done + 1, last - half), first + half + 1):
                        done = offset
                        if (got := self.aligned(found, k, offset)) >= MATCH:
                            out[self.labels[k]] = max(out.get(self.labels[k], 0.0), got)
        return out


def frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, over all documents; and their number."""
    vocabulary = frozenset(w for _, t, _ in templates for w in words(t))

    def run(batches):
        total, df = 0, defaultdict(int)
        for b in batches:
            for t in (x.as_py() for x in b.column(0)):
                total += 1
                for w in vocabulary.intersection(words(t)):
                    df[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode("utf-8", "replace") for w in df), None], pa.string()), pa.array([*df.values(), total], pa.int64())], names=["word", "n"])

    rows = in_parts(docs.select("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    found = {r["word"]: r["n"] for r in rows}
    n = found.pop(None, 0)
    return {w.encode(): c for w, c in found.items()}, n


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the findings of every document."""
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES, *frequencies(docs.select(F.col(text_col).alias("text")))))
    base = [(words(p), label) for p, label in BASE]

    def one(x: Index, text: str | None) -> tuple:
        found = words(text)
        at = [(i, label) for p, label in base for i in places(found, p)]
        more = x.scan(found)
        own = {label for _, label in at}
        starts = [i for i, _ in at]
        return (len(found), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more.keys())), 1.0 if own else max(more.values(), default=0.0))

    def run(batches):
        x = index.value
        for b in batches:
            cols = list(zip(*[one(x, t.as_py()) for t in b.column(1)])) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    src = in_parts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, {SCHEMA}")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
