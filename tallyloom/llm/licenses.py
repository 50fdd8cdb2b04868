"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

What is compared is each line of a text, each block (lines between blank ones) and the whole text, and then every run of words, for a licence can take
several blocks of a longer text or share its line with other words. Normalising lowers A-Z and leaves words of ASCII letters and digits and of other
characters, so case, signs and spacing don't count. The Dice coefficient of two sets is at most twice the smaller size over the sum of sizes, which bounds
the sizes that a unit can have for each template: units outside all bounds, most of all text, are dropped before any comparison, and others meet only the
templates whose bounds they keep. A template whose bigrams a text has too few of can't be reached by any of its runs, which spares nearly all texts the search.

Of overlapping runs of a template the one with the greatest coefficient counts (the first of equal ones), of those of several templates the one with most
bigrams in common; a run that overlaps a line, block or text which matches with as many bigrams in common is that match and counts no second time.

Null and empty texts have no units and no licences. Of templates with equal coefficients for a unit the first name counts. A unit that repeats counts once
for each time. A text is searched whole, in one task, with work linear in its words for each template. Repeated rows and null ids stay; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import heapify, heappop, heappush
from itertools import pairwise
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import words_of

THRESHOLD = 0.8

#: Notices and short licence texts as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def bigrams(words: list[bytes]) -> frozenset:
    return frozenset(pairwise(words))


class Templates:
    """Templates with their bigrams, and for each size of a unit the templates that it can reach the threshold with."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        self.sets = {name: bigrams(words_of(texts[name])) for name in sorted(texts)}
        sizes = [len(s) for s in self.sets.values() if s]
        self.least = min((s * threshold / (2 - threshold) for s in sizes), default=1)
        self.most = max((s * (2 - threshold) / threshold for s in sizes), default=0)
        self.any = frozenset().union(*self.sets.values())

    def best(self, unit: frozenset) -> tuple[str, float, int] | None:
        """Name, coefficient and number of common bigrams."""
        n, found = len(unit), None
        for name, s in self.sets.items():
            # 2 * min / sum >= threshold is needed before the sets are looked at.
            if s and 2 * min(n, len(s)) >= self.threshold * (n + len(s)):
                c = len(unit & s)
                d = 2 * c / (n + len(s))
                if d >= self.threshold and (found is None or d > found[1]):
                    found = name, d, c
        return found

    def run_from(self, grams: list, s: frozenset, i: int, limit: int) -> tuple[float, int, int, int] | None:
        """The best run of a template that begins with the bigram i and ends by the word limit: its coefficient negated, begin, end, common bigrams.

        Such a run begins and ends with a common bigram and has the first one only once, so the scan stops where that one is met again: all scans together
        pass a text's bigrams once for each bigram of the template, however often things repeat.
        """
        seen, c, best = set(), 0, None
        for j in range(i, min(len(grams), limit - 1)):
            g = grams[j]
            if g in seen:
                if g == grams[i]:
                    break
                continue
            seen.add(g)
            if self.threshold * (len(seen) + len(s)) > 2 * len(s):
                break
            if g in s:
                c += 1
                d = 2 * c / (len(seen) + len(s))
                if d >= self.threshold and (best is None or -d < best[0]):
                    best = -d, i, j + 2, c
        return best

    def runs(self, words: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """Name, coefficient, common bigrams, first word and end of the runs of words that reach the threshold, none overlapping another."""
        grams = list(pairwise(words))
        present, found = self.any.intersection(grams), []
        for name, s in self.sets.items():
            # A run has at least its common bigrams, so 2 * c / (c + len(s)) bounds what c of them can reach.
            if not s or 2 * len(present & s) < self.threshold * (len(present & s) + len(s)):
                continue
            heap = [r for i, g in enumerate(grams) if g in s and (r := self.run_from(grams, s, i, len(words)))]
            heapify(heap)
            taken = Taken()
            while heap:
                d, i, j, c = heappop(heap)
                limit = taken.room(i)
                if j <= limit:
                    taken.add(i, j)
                    found.append((name, -d, c, i, j))
                elif i < limit and (r := self.run_from(grams, s, i, limit)):
                    heappush(heap, r)
        taken, out = Taken(), []
        for r in sorted(found, key=lambda m: (-m[2], -m[1], m[0], m[3])):
            if r[4] <= taken.room(r[3]):
                taken.add(r[3], r[4])
                out.append(r)
        return out


class Taken:
    """Stretches that don't overlap, in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def room(self, i: int) -> float:
        """Up to where it is free from i on; i where nothing is."""
        k = bisect_right(self.starts, i)
        if k and self.ends[k - 1] > i:
            return i
        return self.starts[k] if k < len(self.starts) else inf

    def add(self, i: int, j: int) -> None:
        k = bisect_right(self.starts, i)
        self.starts.insert(k, i)
        self.ends.insert(k, j)


def uncovered(runs: list[tuple], units: list[tuple]) -> list[tuple]:
    """The runs that overlap no unit with as many bigrams in common; units don't overlap each other and are in order."""
    ends, out = [u[4] for u in units], []
    for r in runs:
        k, covered = bisect_right(ends, r[3]), False
        while k < len(units) and units[k][3] < r[4] and not covered:
            covered, k = units[k][2] >= r[2], k + 1
        if not covered:
            out.append(r)
    return out


def units_of(text: str) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """The words, and from where to where each line, each block of more than one line, and the text if it has more than one block have them."""
    words, lines, blocks, block = [], [], [], []
    for line in [*(words_of(line) for line in text.split("\n")), []]:
        if line:
            block.append((len(words), len(words) + len(line)))
            words += line
        elif block:
            lines += block
            blocks.append((block[0][0], block[-1][1], len(block)))
            block = []
    return words, [lines, [(i, j) for i, j, n in blocks if n > 1], [(0, len(words))] if len(blocks) > 1 else []]


def matches(text: str | None, templates: Templates) -> list[tuple[str, float]]:
    """The best template of each unit that reaches the threshold with one, runs of words first."""
    words, tiers = units_of(text or "")
    if len(words) - 1 < templates.least or templates.any.isdisjoint(pairwise(words)):
        return []
    more, out = templates.runs(words), []
    for tier in tiers:
        found = []
        for i, j in tier:
            if j - i - 1 < templates.least or templates.any.isdisjoint(pairwise(words[i:j])):
                continue
            unit = bigrams(words[i:j])
            if templates.least <= len(unit) <= templates.most and (m := templates.best(unit)):
                found.append((*m, i, j))
        more = uncovered(more, found)
        out += found
    return [m[:2] for m in more + out]


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_matches, licenses (distinct names, sorted, joined by commas), best_license and best_dice (rounded to 6 places; null without a match)."""
    templates = docs.sparkSession.sparkContext.broadcast(Templates(texts or TEMPLATES, threshold))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [matches(t, templates.value) for t in b.column(1).to_pylist()]
            best = [min(f, key=lambda m: (-m[1], m[0])) if f else (None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({n for n, _ in f})) for f in found], pa.string()), pa.array([n for n, _ in best], pa.string()), pa.array([None if d is None else round(d, 6) for _, d in best], pa.float64())],
                ["doc_id", "n_matches", "licenses", "best_license", "best_dice"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_matches long, licenses string, best_license string, best_dice double")


def op8_licenses(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
