"""License scan by patience alignment.

A license is looked for in stretches of a text that begin with a word of the template and hold a
fixed multiple (STRETCHES) of its words, so that up to two words may stand beside each of its own.  A stretch is
aligned with the template by patience: words that occur once in both are anchors, the longest increasing
subsequence of their positions is kept, and the gaps between anchors are aligned in the same way,
recursively, after equal words at their ends are matched.  Coverage is the share of the template's
words that are aligned; the shortest stretch that reaches COVERAGE counts.  Of a template's stretches
that meet, the best is reported.

Only stretches that can reach COVERAGE are aligned: those that hold so many of the template's words, each
counted as often as in the template at most.  Whatever is aligned is common to both, so nothing is lost.

Words are runs of letters, digits, and dots or hyphens within, lower-cased.

Defined cases: null and empty texts hold no license; a template without words is never found;
several licenses of a text are each reported, and a notice within a
longer license too; of equal stretches that meet the first is reported; rows that repeat a doc_id are each judged; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table
from .textscan import pieces

COVERAGE = 0.8
#: Words of a stretch for each word of the template, shortest first.
STRETCHES = (1.1, 1.5, 2.0, 3.0)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# Public license texts, and the notices by which longer ones are applied.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ordered by the first) whose second rises (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(piles[k - 1] if k else -1)
        tops[k : k + 1], piles[k : k + 1] = [b], [n]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), by patience, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: n for n, w in enumerate(b[k:m], k) if once_b[w] == 1}
        anchors = _increasing([(n, place[w]) for n, w in enumerate(a[i:j], i) if w in place and once_a[w] == 1])
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names, self.words = list(templates), [words(t) for t in templates.values()]
        self.counts = [Counter(w) for w in self.words]
        self.least = [math.ceil(COVERAGE * len(w)) for w in self.words]
        self.holders: dict[str, list[int]] = {}
        for n, counts in enumerate(self.counts):
            for w in counts:
                self.holders.setdefault(w, []).append(n)

    def starts(self, n: int, own: list[str], places: list[int], size: int) -> list[int]:
        """The places (of words of template n) where a stretch of size words can reach COVERAGE."""
        many, held, common, end, out = self.counts[n], Counter(), 0, 0, []
        for at in places:
            while end < len(places) and places[end] < at + size:
                w = own[places[end]]
                held[w] += 1
                common += held[w] <= many[w]
                end += 1
            if common >= self.least[n]:
                out.append(at)
            common -= held[own[at]] <= many[own[at]]
            held[own[at]] -= 1
        return out

    def find(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, aligned words, first word, last word), in text order."""
        own = words(text)
        places: dict[int, list[int]] = {}
        for at, w in enumerate(own):
            if w in self.holders:
                for n in self.holders[w]:
                    places.setdefault(n, []).append(at)
        out = []
        for n, found in places.items():
            template, least = self.words[n], self.least[n]
            sizes = [math.ceil(x * len(template)) for x in STRETCHES]
            # Without least words of the template near enough there is no need to count.
            if len(found) < least or all(b - a >= sizes[-1] for a, b in zip(found, found[least - 1 :], strict=False)):
                continue
            able = {at: [] for at in self.starts(n, own, found, sizes[-1])}
            for size in sizes if able else ():
                for at in self.starts(n, own, found, size):
                    able[at].append(size)
            best, whole = [], -1
            for at in sorted(able):
                if at <= whole:  # within a stretch that covers all of the template
                    continue
                for size in able[at]:
                    same = align(own[at : at + size], template)
                    if len(same) >= least:
                        best.append((len(same), at + same[0][0], at + same[-1][0]))
                        if len(same) == len(template):
                            whole = best[-1][2]
                        break
            best.sort(key=lambda x: (-x[0], x[1], x[2]))
            taken: list[tuple[int, int]] = []
            for size, first, last in best:
                if all(last < f or first > e for f, e in taken):
                    taken.append((first, last))
                    out.append((self.names[n], size / len(template), size, first, last))
        return sorted(out, key=lambda x: (x[3], x[0]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, n_aligned, first_word, last_word) for every license of every text."""

    def run(batches):
        known = Templates(templates or TEMPLATES)
        for batch in batches:
            for piece in pieces(batch):
                out = [(d.as_py(), *f) for d, t in zip(piece.column("doc_id"), piece.column("text"), strict=True) for f in known.find(t.as_py() or "")]
                if out:
                    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "license", "coverage", "n_aligned", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, coverage double, n_aligned long, first_word long, last_word long")


def op6(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))
