"""License scans by patience alignment with license templates.

Words that are unique both to a stretch of the text and to the template are anchors.
The longest increasing subsequence of them is kept, and the gaps between them are
aligned in the same way; a gap without anchors is aligned by the longest common
subsequence. A template's coverage is the part of its words that are aligned.

Before that, exact bounds rule out most of the work: coverage c of a template of m
words leaves at most m - ceil(c m) of its words out, so one of any set of more words
than that must be in the text, and the stretch of text must hold that many of its words.
One more word aligns one more at most, so a stretch that lacks n is tried again when n
more of the template's words have come: work follows the text's length, whatever its words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import U, pieces, tokens, word_hash

COVERAGE = 0.8
#: A template of at most so many words must have all of them but those of FRAME aligned:
#: the others are what tells its license (name, kind, version) from another one.
FEW = 13
FRAME = "a an and are in into is of the this to under version work v 0 distributed general international license licensed public released software"
#: An aligned stretch may be this many times as long as the template.
STRETCH = 1.5

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE.",
    "BSD-2-Clause": f"{_BSD} {_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    f"this software without specific prior written permission. {_DISCLAIMER}",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.",
    "BSD": "Released under the BSD License",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
    "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the "
    "original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered "
    "source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from "
    "any source distribution.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "All-rights-reserved": "All rights reserved",
}


def _lis(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) that rises strictly in both."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        j = bisect_left(tails, y)
        if j == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[j], at[j] = y, k
        back[k] = at[j - 1] if j else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as places in both (Hunt and Szymanski: over equal pairs only)."""
    where: dict = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    tails: list[int] = []
    nodes: list = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, j, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            elif j < tails[k]:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of a and b. Gaps wait on a list, so depth is no limit."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        spot = {y: j for j, y in enumerate(b[j0:j1], j0) if cb[y] == 1}
        anchors = _lis([(i, spot[x]) for i, x in enumerate(a[i0:i1], i0) if ca[x] == 1 and x in spot])
        if not anchors:
            out += [(i0 + i, j0 + j) for i, j in common_subsequence(a[i0:i1], b[j0:j1])]
            continue
        pi, pj = i0, j0
        for i, j in anchors:
            todo.append((pi, i, pj, j))
            out.append((i, j))
            pi, pj = i + 1, j + 1
        todo.append((pi, i1, pj, j1))
    return sorted(out)


def alignments(template: list, text: list, least: int, first: int = 0, end: int | None = None, telling: frozenset = frozenset(), stretch: float = STRETCH) -> list[list[tuple[int, int]]]:
    """Alignments of ``template`` with stretches of ``text`` from ``first`` to ``end`` that don't
    overlap, in order: of overlapping ones that which covers most, the first of equals, if
    ``least`` words are aligned at all, those at the places ``telling`` of the template among
    them. Stretches of ``stretch`` times the template's length are tried where enough of its
    words stand."""
    have = set(template)
    end = len(text) if end is None else end
    places = [k for k in range(first, end) if text[k] in have]
    window = ceil(len(template) * stretch)
    need = Counter(template)
    out: list[list[tuple[int, int]]] = []
    begin = 0
    while begin < len(places):
        best: list[tuple[int, int]] = []
        inside: Counter = Counter()
        lo, common, wait = begin, 0, 0
        for hi in range(begin, len(places)):
            p = places[hi]
            x = text[p]
            inside[x] += 1
            common += inside[x] <= need[x]
            while p - places[lo] >= window:
                y = text[places[lo]]
                common -= inside[y] <= need[y]
                inside[y] -= 1
                lo += 1
            if best and places[lo] > best[-1][1]:
                break
            # ``common`` bounds what this stretch can align.
            wait -= 1
            if common >= least and common > len(best) and wait <= 0:
                found = [(i, places[lo] + j) for i, j in patience(template, text[places[lo] : p + 1])]
                if len(found) > len(best) and len(found) >= least and telling <= {i for i, _ in found}:
                    if best and found[0][1] > best[-1][1]:
                        out.append(best)
                    best = found
                    if len(best) == len(template):
                        break
                wait = max(least, len(best) + 1) - len(found)
        if not best:
            break
        out.append(best)
        # All that follows is tried anew, without the words of this stretch.
        begin = bisect_left(places, best[-1][1] + 1)
    return out


class Scanner:
    """Templates made ready: words as hashes, the words one of which must occur, the least aligned."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = sorted(templates)
        w = tokens(pa.array([templates[n] for n in self.names], pa.string()))
        first = w.firsts()
        self.words = [w.hash[first[k] : first[k + 1]].tolist() for k in range(len(self.names))]
        frame = set(word_hash(FRAME).tolist())
        self.telling = [frozenset(i for i, h in enumerate(x) if h not in frame) if len(x) <= FEW else frozenset() for x in self.words]
        size = (w.end - w.start).tolist()
        self.least = [max(1, ceil(coverage * len(x) - 1e-9)) for x in self.words]
        keys: dict[int, set[int]] = {}
        for k, x in enumerate(self.words):
            # Longer words are rarer. All occurrences of the chosen words together outnumber what may be missing.
            long = {h: s for h, s in zip(x, size[first[k] : first[k + 1]], strict=True)}
            many, chosen = Counter(x), 0
            for h in sorted(long, key=lambda h: (-long[h], h)):
                keys.setdefault(h, set()).add(k)
                chosen += many[h]
                if chosen > len(x) - self.least[k]:
                    break
        self.keys = np.array(sorted(keys), U)
        self.of = [sorted(keys[int(h)]) for h in self.keys]

    def scan(self, col: pa.Array) -> list[tuple[int, str, int, int, int, int]]:
        """(row, template, aligned, words, first byte, end) of every stretch of a row that covers a template."""
        w = tokens(col)
        if len(w.hash) == 0 or len(self.keys) == 0:
            return []
        at = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == w.hash)
        pairs = {(int(r), k) for r, a in {(r, a) for r, a in zip(w.row[hit].tolist(), at[hit].tolist(), strict=True)} for k in self.of[a]}
        first, out = w.firsts(), []
        by_row: dict[int, list] = {}
        for r, k in sorted(pairs):
            by_row.setdefault(r, []).append(k)
        for r, ks in sorted(by_row.items()):
            text = w.hash[first[r] : first[r + 1]].tolist()
            for _, size, k, js in sorted(self.resolved(text, ks), key=lambda x: (x[3], self.names[x[2]])):
                out.append((r, self.names[k], size, len(self.words[k]), int(w.start[first[r] + js[0]]), int(w.end[first[r] + js[1]])))
        return out

    def resolved(self, text: list, ks: list[int]) -> list[tuple[float, int, int, tuple[int, int]]]:
        """(coverage, aligned words, template, (first word, last word)) of stretches that don't
        overlap. Of overlapping ones the best is meant; a template that loses one is tried
        again in what is left between those taken."""
        taken: list[tuple[float, int, int, tuple[int, int]]] = []
        free = [(0, len(text))]
        while ks:
            found = []
            for k in ks:
                for a, b in free:
                    if b - a >= self.least[k]:
                        for x in alignments(self.words[k], text, self.least[k], a, b, self.telling[k]):
                            found.append((len(x) / len(self.words[k]), len(x), k, (x[0][1], x[-1][1])))
            lost: set[int] = set()
            # Spans taken, in order; none overlap.
            spans = sorted(x[3] for x in taken)
            for x in sorted(found, key=lambda x: (-x[0], -x[1], self.names[x[2]], x[3])):
                a, b = x[3]
                at = bisect_left(spans, (a, a))
                if (at and spans[at - 1][1] >= a) or (at < len(spans) and spans[at][0] <= b):
                    lost.add(x[2])
                else:
                    spans.insert(at, x[3])
                    taken.append(x)
            ks = sorted(lost)
            edges = [-1, *(e for s in spans for e in s), len(text)]
            free = [(edges[n] + 1, edges[n + 1]) for n in range(0, len(edges), 2)]
        return taken


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, span_start, span_end): each stretch of a text that aligns
    at least ``coverage`` of a template; places count characters from 0.

    * Case, punctuation and spacing are ignored. A text may match several templates, each
      in several stretches; of stretches that overlap, that of the highest coverage (then
      with more words, then of the first template by name) counts.
    * A template of few words must have its license's name, kind and version aligned.
    * A license repeated in a text gives a row for each stretch.
    * Null and empty texts match nothing. Repeated rows and ids each give their own
      rows; a null id stays null. Long texts are scanned whole.
    * Other columns are not read. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "t"):
                ids, rows = b.column("d"), held.value.scan(b.column("t"))
                raw = {r: b.column("t")[r].as_py().encode() for r, *_ in rows}
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([x[0] for x in rows], pa.int64())),
                        pa.array([x[1] for x in rows], pa.string()),
                        pa.array([x[2] / x[3] for x in rows], pa.float64()),
                        pa.array([len(raw[x[0]][: x[4]].decode()) for x in rows], pa.int32()),
                        pa.array([len(raw[x[0]][: x[5]].decode()) for x in rows], pa.int32()),
                    ],
                    ["doc_id", "license", "coverage", "span_start", "span_end"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, license string, coverage double, span_start int, span_end int")
