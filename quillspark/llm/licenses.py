"""License scans: a generalised suffix automaton over the words of licence templates.

The automaton holds every factor of every template. Streaming a text word by word gives its
matching statistics: after each word, the longest run ending there that occurs in a template.
A base phrase stands where the run is at least the phrase and the state's suffixes hold it.
Maximal long runs are chained: of the runs of one template that go on in the text and in the template, the chain that
covers most words of the template is its span; a template with enough of its words covered gives its label, one of
few words only if all of them stand there.

The templates here are the whole texts of short licences and the notices that longer ones ask for;
``templates_from`` reads others, such as the bodies of long licences, from a folder of text files.

Empty and null texts have no words, null positions and empty labels; score 0. Rows are
treated one by one; memory is bounded by one text and the templates.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

# Base phrases and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu_notice(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free
Software Foundation, {version}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along
with this program."""


# Texts and notices of well-known public licences, and their labels.
TEMPLATES = (
    (
        "mit",
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}""",
    ),
    ("bsd-2", f"{_BSD_TWO} {_BSD_AS_IS}"),
    (
        "bsd-3",
        f"""{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. {_BSD_AS_IS}""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License.""",
    ),
    ("gpl-2", _gnu_notice("GNU General Public License", "either version 2 of the License, or (at your option) any later version")),
    ("gpl-3", _gnu_notice("GNU General Public License", "either version 3 of the License, or (at your option) any later version")),
    ("lgpl-2.1", _gnu_notice("GNU Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version")),
    ("lgpl-3", _gnu_notice("GNU Lesser General Public License", "either version 3 of the License, or (at your option) any later version")),
    ("agpl-3", _gnu_notice("GNU Affero General Public License", "either version 3 of the License, or (at your option) any later version")),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
)


def templates_from(folder: str) -> tuple[tuple[str, str], ...]:
    """(label, text) of every ``*.txt`` file of a folder on the driver; the label is the file's name."""
    import pathlib

    return tuple((f.stem, f.read_text(errors="replace")) for f in sorted(pathlib.Path(folder).glob("*.txt")))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


class SuffixAutomaton:
    """All factors of a set of word sequences; ``where`` has a (template, end) for each state."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.where = [-1], [0], [(-1, -1)]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((t, i + 1))
        self._spread()

    def _new(self, length: int, moves: dict, link: int) -> int:
        self.next.append(dict(moves))
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.next[q], self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: str) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        here, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = here
            p = self.link[p]
        if p >= 0:
            # the clone, if one is made, takes over both links
            self.link[here] = self._split(p, self.next[p][w], w)
        return here

    def _spread(self) -> None:
        """Every state learns the template ends of the states whose suffix it is."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]

    def walk(self, words: list[str]):
        """The matching statistics: (state, length) after each word."""
        s, n, step, link, length = 0, 0, self.next, self.link, self.length
        for w in words:
            to = step[s].get(w)
            while to is None and s:
                s = link[s]
                n = length[s]
                to = step[s].get(w)
            if to is None:
                n = 0
            else:
                s, n = to, n + 1
            yield s, n


class Scanner:
    """Base places, template spans and labels of a text."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, least_run: int = 3, least_cover: float = 0.6, few: int = 12):
        self.labels = [label for label, _ in templates]
        self.words = [words_of(t) for _, t in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.auto = SuffixAutomaton([*self.words, *[p for p, _ in self.phrases]])
        self.templates, self.least_run = len(self.words), least_run
        # words of a template that its chain must cover: all of them if it has few
        self.least = [len(w) if len(w) <= few else max(few, least_cover * len(w)) for w in self.words]
        # the phrases that end at a state: those in its own ends as whole sequences, if the run is long enough
        self.base_at: list[list[tuple[int, int]]] = [[] for _ in self.auto.next]
        at = {}
        for i, (words, _) in enumerate(self.phrases):
            s = 0
            for w in words:
                s = self.auto.next[s][w]
            at.setdefault(s, []).append((len(words), i))
        for s in sorted(range(1, len(self.auto.next)), key=self.auto.length.__getitem__):
            self.base_at[s] = at.get(s, []) + self.base_at[max(0, self.auto.link[s])]
        self.alphabet = {w for x in self.words for w in x} | {w for p, _ in self.phrases for w in p}

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(words, base places (start, label), template spans (label, first word, end word, share of the template))."""
        words = words_of(text)
        if self.alphabet.isdisjoint(words):
            return len(words), [], []
        base, runs, before = [], [], (0, 0)
        for i, now in enumerate(self.auto.walk(words)):
            s, n = now
            if n:
                base += [(i + 1 - k, self.phrases[p][1]) for k, p in self.base_at[s] if k <= n]
            if before[1] >= self.least_run and n <= before[1]:
                runs.append((i - before[1], i, before[0]))
            before = now
        if before[1] >= self.least_run:
            runs.append((len(words) - before[1], len(words), before[0]))
        return len(words), base, self.chain(runs)

    def chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, end word, share) by chains of runs (text start, text end, state), in order of their ends.

        Runs of one template follow each other in a chain if both text and template go on, with a gap in the text no
        longer than the template; where they overlap, a run adds only what the one before it did not cover. The chain
        that covers most is taken first, then the best of what stands before and after it.
        """
        at_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, s in runs:
            for t, at in self.auto.ends[s]:
                if t < self.templates:
                    at_template.setdefault(t, []).append((start, end, at))
        done = []
        for t, own in at_template.items():
            n, own = len(self.words[t]), sorted(own, key=lambda r: (r[1], r[2]))
            best, link, first = [], [], 0
            for i, (start, end, at) in enumerate(own):
                score, back = end - start, -1
                while own[first][1] < start - n:
                    first += 1
                for j in range(first, i):
                    gain = min(end - start, end - own[j][1], at - own[j][2])
                    if gain > 0 and own[j][0] <= start and best[j] + gain > score:
                        score, back = best[j] + gain, j
                best.append(score)
                link.append(back)
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(own)), key=lambda i: (-best[i], own[i][1])):
                if best[i] < self.least[t]:
                    break
                k = i
                while link[k] >= 0:
                    k = link[k]
                start, end = own[k][0], own[i][1]
                if all(end <= a or b <= start for a, b in taken):
                    taken.append((start, end))
                    done.append((self.labels[t], start, end, min(1.0, best[i] / n)))
        return sorted(done, key=lambda x: (x[1], x[2], x[0]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """(id, n_words, base array<struct<start,label>>, spans array<struct<label,start,end,share>>); offsets in words from 0."""
    shared = df.sparkSession.sparkContext.broadcast((templates, phrases))
    state: dict = {}
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if "scanner" not in state:
            state["scanner"] = Scanner(*shared.value)
        found = [state["scanner"].scan(t) for t in texts_of(part)]
        return pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": s, "label": x} for s, x in base] for _, base, _ in found], base_type),
                pa.array([[{"label": a, "start": s, "end": e, "share": c} for a, s, e, c in spans] for _, _, spans in found], span_type),
            ],
            ["id", "n_words", "base", "spans"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df, run, f"id {kind}, n_words long, base array<struct<start:long,label:string>>, spans array<struct<label:string,start:long,end:long,share:double>>", id_col, text_col)


def license_digests(documents: DataFrame) -> DataFrame:
    """The digest columns of ``scan`` for a table with doc_id and text.

    ``score`` is 1 where a base phrase stands, else the largest covered share of a template, else 0.
    """
    from pyspark.sql import functions as F

    base, spans = F.col("base.label"), F.col("spans.label")
    return scan(documents).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, spans))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )
