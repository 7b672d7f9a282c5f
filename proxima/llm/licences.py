"""Licence scans: normalised text against licence templates by Dice coefficient.

Texts and templates become lower-case words of letters and digits. Compared are
bags of word bigrams: twice the bigrams in common over the bigrams of both. A text
that matches as a whole is one unit. Other units are windows of its words, found by
position whatever the lines: for each place where a template's bigram stands, the
end that gives the highest coefficient. Of a template's windows those are chosen
that do not overlap and whose coefficients sum to the most, so licences that follow one
another, or the same one twice, are found apart. Two bags of a and b bigrams reach a
coefficient of 2 min(a, b) / (a + b) at most, so a window is at most (2 - THRESHOLD)
/ THRESHOLD times as long as its template, and only places with enough of the
template's bigrams within that length are looked at.

Overlapping windows of templates of about the same size are one licence, the one
with the higher coefficient. A template whose wording is part of a larger one's is
not listed inside a match of that. Others may overlap: both are listed.

A document is scanned where it lies: nothing is shuffled, and what tasks share is
the table of templates below. Texts are read whole.

Defined results: a null or empty text, or one without two words in a row, has no
matches. Of templates with equal coefficients the one that sorts first counts. A
repeated row is scanned each time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import ship_module, table, words_of

THRESHOLD = 0.8

#: Wordings of public licences and of the notices that refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
        OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0 notice": """This program is free software; you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51
        Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
        removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _like(name: str, *changes: tuple[str, str]) -> str:
    """A template's words with parts of them replaced, each of which it has."""
    text = " ".join(TEMPLATES[name].split())
    for old, new in changes:
        assert old in text, old
        text = text.replace(old, new)
    return text


#: Relatives, which would else be taken for the templates that they differ little from.
TEMPLATES |= {
    "BSD-3-Clause": _like("BSD-2-Clause", ("THIS SOFTWARE IS PROVIDED", """3. Neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission. THIS SOFTWARE IS PROVIDED""")),
    "AGPL-3.0 notice": _like("GPL-3.0 notice", ("GNU General", "GNU Affero General")),
    "LGPL-3.0 notice": _like("GPL-3.0 notice", ("GNU General", "GNU Lesser General")),
    "LGPL-2.1 notice": _like("GPL-2.0 notice", ("GNU General", "GNU Lesser General"), ("version 2 of", "version 2.1 of"),
                             ("This program", "This library"), ("this program", "this library")),
}


class Windows:
    """Windows of one text that match one template."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, size: int, times: dict[int, int], room: float, threshold: float):
        self.size, self.times, self.threshold = size, times, threshold
        self.longest = int(size / room + 1e-9)
        behind = np.searchsorted(at, at + self.longest)
        self.starts = np.flatnonzero(behind - np.arange(len(at)) >= size * room - 1e-9).tolist()
        self.at, self.ids = at.tolist(), ids.tolist()
        self.ends: dict[int, tuple[float, int] | None] = {}

    def chosen(self, hidden: np.ndarray | None) -> list[tuple[float, int, int]]:
        """(coefficient, start, end) of windows that do not overlap, clear of what is hidden."""
        shut = np.flatnonzero(hidden) if hidden is not None else np.zeros(0, np.int64)
        found = []
        for index in self.starts:
            start, limit = self.at[index], self.at[-1] + 1
            if len(shut):
                if hidden[start]:
                    continue
                k = int(np.searchsorted(shut, start))
                limit = int(shut[k]) if k < len(shut) else limit
            if index not in self.ends:
                self.ends[index] = self.best(index, self.at[-1] + 1)
            best = self.ends[index]
            if best and best[1] > limit:
                best = self.best(index, limit)
            if best:
                found.append((best[0], start, best[1]))
        begins = [x[1] for x in found]
        # total[i]: the most that windows from the i-th on sum to
        total, follow = [0.0] * (len(found) + 1), [0] * len(found)
        for i in range(len(found) - 1, -1, -1):
            follow[i] = bisect_left(begins, found[i][2])
            total[i] = max(total[i + 1], found[i][0] + total[follow[i]])
        out, i = [], 0
        while i < len(found):
            if total[i] > total[i + 1]:
                out.append(found[i])
                i = follow[i]
            else:
                i += 1
        return out

    def best(self, start: int, limit: int) -> tuple[float, int] | None:
        """Coefficient and end of the best window from a start, before ``limit``."""
        at, ids, times, size = self.at, self.ids, self.times, self.size
        first, held, most, end = at[start], 0, 0.0, 0
        limit = min(limit, first + self.longest)
        used: dict[int, int] = {}
        for j in range(start, len(at)):
            place = at[j]
            if place >= limit:
                break
            n = used.get(ids[j], 0)
            if n < times[ids[j]]:
                used[ids[j]] = n + 1
                held += 1
                dice = 2.0 * held / (place + 1 - first + size)
                if dice > most:
                    most, end = dice, place + 1
        return (most, end) if most >= self.threshold else None


class Templates:
    """The templates' bags of bigrams by size; ``place`` numbers the bigrams that any has, -1 for others."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.ids: dict[bytes, int] = {}
        coded = {n: np.array([self.ids.setdefault(w, len(self.ids)) for w in words_of(t)], np.int64)
                 for n, t in templates.items()}
        self.base = len(self.ids)
        held = []
        for name, ids in coded.items():
            pairs, counts = np.unique(ids[:-1] * self.base + ids[1:], return_counts=True)
            held.append((int(counts.sum()), name, pairs, counts))
        self.held = sorted(held, key=lambda x: x[:2])
        self.sizes = [x[0] for x in self.held]
        known = np.unique(np.concatenate([x[2] for x in held]))
        self.place = np.full(self.base * self.base, -1, np.int32)
        self.place[known] = np.arange(len(known))
        self.bags = np.zeros((len(held), len(known)), np.int64)
        for k, (_, _, pairs, counts) in enumerate(self.held):
            self.bags[k, self.place[pairs]] = counts
        self.times = [dict(zip(np.flatnonzero(b).tolist(), b[b > 0].tolist())) for b in self.bags]
        self.has = self.bags > 0
        alike = THRESHOLD / (2.0 - THRESHOLD)
        #: those that a match of each template keeps from being listed at the same place, itself included
        self.hides: list[list[int]] = [[] for _ in held]
        #: how many templates deep a template's wording lies in larger ones; these are looked for first
        self.depth = [0] * len(held)
        for k in reversed(range(len(held))):
            for m, size in enumerate(self.sizes):
                part = m < k and size < alike * self.sizes[k] and (
                    int(np.minimum(self.bags[k], self.bags[m]).sum()) >= THRESHOLD * size)
                if part:
                    self.depth[m] = max(self.depth[m], self.depth[k] + 1)
                if part or min(size, self.sizes[k]) >= alike * max(size, self.sizes[k]):
                    self.hides[k].append(m)

    def best(self, pairs: np.ndarray, size: int, threshold: float) -> tuple[str, float] | None:
        """The closest template of a unit with ``size`` bigrams, ``pairs`` those of them that are known."""
        room = threshold / (2.0 - threshold)
        low, high = bisect_left(self.sizes, size * room - 1e-9), bisect_right(self.sizes, size / room + 1e-9)
        if low == high:
            return None
        own, counts = np.unique(pairs, return_counts=True)
        found = None
        for other, name, theirs, times in self.held[low:high]:
            _, i, j = np.intersect1d(own, theirs, assume_unique=True, return_indices=True)
            dice = 2.0 * int(np.minimum(counts[i], times[j]).sum()) / (size + other)
            if dice >= threshold and (found is None or (-dice, name) < (-found[1], found[0])):
                found = (name, dice)
        return found

    def scan(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
        """(licence, first line, line behind the last, coefficient) of each unit that matches, in order."""
        get, ids, bounds = self.ids.get, [], [0]
        for line in (text or "").split("\n"):
            ids += [get(w, -1) for w in words_of(line)]
            bounds.append(len(ids))
        if len(ids) < 2:
            return []
        code = np.array(ids, np.int64)
        pairs = np.where((code[:-1] >= 0) & (code[1:] >= 0), code[:-1] * self.base + code[1:], -1)
        place = np.where(pairs >= 0, self.place[pairs], -1)
        at = np.flatnonzero(place >= 0)
        if not len(at):
            return []
        room, known = threshold / (2.0 - threshold), place[at]
        hidden = {}
        out: list[tuple[str, int, int, float]] = []

        def take(k: int, start: int, end: int) -> None:
            for m in self.hides[k]:
                hidden.setdefault(m, np.zeros(len(pairs), bool))[start:end] = True

        whole = self.best(pairs[at], len(pairs), threshold)
        if whole:
            out.append((whole[0], 0, len(bounds) - 1, whole[1]))
            take(next(k for k, x in enumerate(self.held) if x[1] == whole[0]), 0, len(pairs))
        windows: dict[int, Windows] = {}
        enough = np.array(self.sizes) * room - 1e-9
        for k in np.flatnonzero(self.has[:, known].sum(1) >= np.maximum(enough, 1)).tolist():
            own = self.has[k, known]
            windows[k] = Windows(at[own], known[own], self.sizes[k], self.times[k], room, threshold)
        for depth in sorted({self.depth[k] for k in windows}):
            todo = {k for k in windows if self.depth[k] == depth}
            while todo:
                found = sorted((-dice, self.held[k][1], start, end, k)
                               for k in todo for dice, start, end in windows[k].chosen(hidden.get(k)))
                # those that others have cut are chosen anew
                todo = set()
                for dice, name, start, end, k in found:
                    if k in hidden and hidden[k][start:end].any():
                        todo.add(k)
                        continue
                    take(k, start, end)
                    # the window's words are those from start to end, both included
                    lines = np.searchsorted(bounds, [start, end], "right")
                    out.append((name, int(lines[0]) - 1, int(lines[1]), -dice))
        return sorted(out, key=lambda m: m[1:3])


def licences(docs: DataFrame, text: Column, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> Column:
    """array<struct<licence, start_line, end_line, dice>> of each text."""
    ship_module(__name__)

    @F.pandas_udf("array<struct<licence:string,start_line:int,end_line:int,dice:double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, names = Templates(templates), ("licence", "start_line", "end_line", "dice")
        for texts in batches:
            yield pd.Series([[dict(zip(names, m)) for m in own.scan(t, threshold)] for t in texts], dtype=object)

    return scan(text)


def op5_licences(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", licences(docs, F.col("text")).alias("found"))
    top = F.get(F.array_sort(F.transform("found", lambda m: F.struct((-m["dice"]).alias("d"), m["licence"].alias("n")))), F.lit(0))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_matches"), top["n"].alias("licence"), (-top["d"]).alias("dice"),
        F.concat_ws(",", F.transform("found", lambda m: F.concat_ws(
            ":", m["licence"], m["start_line"].cast("string"), m["end_line"].cast("string")))).alias("matches"),
    )
