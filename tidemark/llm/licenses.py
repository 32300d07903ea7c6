"""License scans: winnowed fingerprints of template paragraphs pick candidates in an inverted index, banded alignment reports spans."""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Words of a gram, grams of a winnowing window (so a shared run of GRAM + WINDOW - 1 words always meets), half
#: width of the alignment band, least share of a template's words that a match aligns.
GRAM, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.8
#: Paragraphs of fewer words are listed by every gram; a longer one must be met once in so many words to be aligned.
EVERY = HIT_EVERY = 20
CACHE_WORDS = 300_000
#: Bytes of templates that may go to every worker.
TEMPLATES_BOUND = 8_000_000

#: Names, notices and whole texts of common licenses, a line for each paragraph.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-name": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "BSD-name": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-text": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0-text": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "Unlicense-text": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "Apache-2.0-notice": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}
#: Fixed value: the third condition, between the second and the disclaimer.
BSD_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: The notice of the GNU licenses, their names and versions.
GNU_NOTICE = """
This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>."""
GNU = {
    "GPL-2.0-notice": ("program", "General Public License", "2"),
    "GPL-3.0-notice": ("program", "General Public License", "3"),
    "AGPL-3.0-notice": ("program", "Affero General Public License", "3"),
    "LGPL-2.1-notice": ("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": ("program", "Lesser General Public License", "3"),
}
TEMPLATES |= {key: GNU_NOTICE.format(work=work, name=name, version=version) for key, (work, name, version) in GNU.items()}
*_conditions, _disclaimer = TEMPLATES["BSD-2-Clause"].split("\n")
TEMPLATES["BSD-3-Clause"] = "\n".join([*_conditions, BSD_ENDORSEMENT, _disclaimer])

#: Short names of licenses, several for some; a name of two words alone is too common to count.
SHORT = {
    "MIT-short": "the MIT License\nMIT License Copyright\nlicensed under MIT",
    "Apache-2.0-short": "Apache License 2.0\nApache License Version 2.0\nApache 2.0 License",
    "BSD-short": "the BSD License\nBSD License Copyright",
    "BSD-2-Clause-short": "BSD 2-Clause License",
    "BSD-3-Clause-short": "BSD 3-Clause License",
    "GPL-2.0-short": "GNU GPL v2\nGNU General Public License version 2\nGNU General Public License v2.0",
    "GPL-3.0-short": "GNU GPL v3\nGNU General Public License version 3\nGNU General Public License v3.0",
    "LGPL-2.1-short": "GNU LGPL v2.1\nGNU Lesser General Public License version 2.1",
    "LGPL-3.0-short": "GNU LGPL v3\nGNU Lesser General Public License version 3",
    "AGPL-3.0-short": "GNU AGPL v3\nGNU Affero General Public License version 3",
    "MPL-2.0-short": "Mozilla Public License 2.0\nMozilla Public License version 2.0",
    "EPL-2.0-short": "Eclipse Public License 2.0\nEclipse Public License v2.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
}
#: Identifiers that follow ``SPDX-License-Identifier:``.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 ISC Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
TEMPLATES |= SHORT | {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in SPDX}
#: Words that tell licenses and their clauses apart; like numbers, a match must have just those of its template.
TELLING = frozenset(
    "mit apache bsd gnu gpl gplv2 gplv3 lgpl agpl lesser library affero mozilla mpl eclipse epl isc zlib unlicense bsl boost cc cc0 by nc nd sa commons attribution noncommercial noderivatives noderivs sharealike clause only later".split()
)

WORD = regex.compile(r"[^\W_]+")


#: Words in front of a short name that make it another one.
MODIFIED = [["lesser"], ["affero"], ["library"], ["non"], ["not"]]


def telling(words: list[str]) -> list[str]:
    """The words that decide which license and version it is, in order."""
    return [w for w in words if w in TELLING or any(c.isdigit() for c in w)]


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def grams(h: np.ndarray) -> np.ndarray:
    """A hash for each run of GRAM words."""
    out = np.zeros(max(0, len(h) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def winnowed(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the grams that are least in some window."""
    if len(g) <= WINDOW:
        at = np.array([int(g.argmin())]) if len(g) else np.empty(0, int)
        return at, g[at]
    views = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.unique(np.arange(len(views)) + views.argmin(1))
    return at, g[at]


class Index:
    """Paragraphs of templates by fingerprint. A paragraph of fewer than GRAM words counts with the one before it, or after it at the start."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.known = Hashes()
        self.names, self.total = [name for name, _ in templates], [0] * len(templates)
        self.of, self.words, self.telling = [], [], []  # template, words, and words that must be exact, of each paragraph
        entries: dict[int, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(templates):
            parts: list[list[str]] = []
            for words in (WORD.findall(p.lower()) for p in (text or "").split("\n")):
                if parts and (len(words) < GRAM or len(parts[-1]) < GRAM):
                    parts[-1] = parts[-1] + words
                elif words:
                    parts.append(words)
            for words in parts:
                h = self.hashes(words)
                g = grams(h)
                # both sides are winnowed; of short paragraphs, which an edit can leave without a whole window, every gram is listed
                at, g = winnowed(g) if len(h) >= EVERY else (np.arange(len(g)), g)
                for place, value in zip(at.tolist(), g.tolist(), strict=True):
                    entries.setdefault(value, []).append((len(self.words), place))
                self.total[k] += len(h)
                self.of.append(k)
                self.words.append(h)
                self.telling.append(telling(words))
        self.entries = entries
        self.keys = np.array(sorted(entries), np.uint64)
        # a run of fewer words may lie between two kept grams of a text, so all its grams are looked up for these
        tiny = {p for p, h in enumerate(self.words) if len(h) < GRAM + WINDOW - 1}
        self.tiny = np.array(sorted(v for v, places in entries.items() if any(p in tiny for p, _ in places)), np.uint64)

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def candidates(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(paragraph, diagonal) pairs that fingerprints meet; a diagonal is text place less paragraph place. Diagonals of one
        strip of the band are aligned once, along the one met most; long paragraphs must be met once in HIT_EVERY words."""
        every = grams(h)
        at, _ = winnowed(every)
        if not len(self.keys) or not len(at):
            return []
        if len(self.tiny):
            at = np.union1d(at, np.flatnonzero(self.tiny[np.minimum(np.searchsorted(self.tiny, every), len(self.tiny) - 1)] == every))
        g = every[at]
        place = np.searchsorted(self.keys, g)
        hit = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == g)
        met = Counter((p, int(at[i]) - k) for i in hit for p, k in self.entries[int(g[i])])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        strips: Counter = Counter()
        for (p, d), n in met.items():
            strip = p, d // band(len(self.words[p]))
            strips[strip] += n
            best[strip] = max(best.get(strip, (0, 0)), (n, -d))
        near = lambda p, s: strips[p, s - 1] + strips[p, s] + strips[p, s + 1]
        return [(p, -d) for (p, s), (_, d) in best.items() if near(p, s) * HIT_EVERY >= len(self.words[p]) - HIT_EVERY]


def band(words: int) -> int:
    """Half width of the alignment band of a paragraph: copies that follow one another stay in bands of their own."""
    return min(BAND, max(1, (words - 1) // 2))


def align(text: np.ndarray, template: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Most template words matched in order within ``band`` of a diagonal (longest common subsequence in the band), and the
    first and last matched place of the text."""
    half = band(len(template))
    lo = diagonal - half
    width = 2 * half + 1
    score = np.zeros(width + 1, int)
    first = np.full(width + 1, -1)
    last = np.full(width + 1, -1)
    for j in range(len(template)):
        # cell c of row j stands for text place lo + j + c; row j - 1 is shifted by one cell
        new, nf, nl = score.copy(), first.copy(), last.copy()
        new[:-1], nf[:-1], nl[:-1] = score[1:], first[1:], last[1:]  # skip the template word
        for c in range(width):
            i = lo + j + c
            if 0 <= i < len(text) and text[i] == template[j] and score[c] + 1 > new[c]:
                new[c], nf[c], nl[c] = score[c] + 1, (i if first[c] < 0 else first[c]), i
            if c and new[c - 1] > new[c]:  # skip the text word
                new[c], nf[c], nl[c] = new[c - 1], nf[c - 1], nl[c - 1]
        score, first, last = new, nf, nl
    c = int(score.argmax())
    return int(score[c]), int(first[c]), int(last[c])


def scan_text(text: str | None, index: Index) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, start, stop, words matched) of each match in a whole text, characters, stop exclusive.

    A paragraph is found where COVERAGE of its words align; of overlapping places of one paragraph the best stays, and copies
    are all reported. Found paragraphs of a template that follow one another in its order are one match, whose coverage is
    their matched words over all words of the template. A match goes if better ones (more matched words, then more coverage) hold
    over half of its place. Numbers, names of licenses and of their clauses must be those of the paragraph, in its order, if it has any or is
    short; in a short one words put in count like words left out.
    """
    if not text:
        return []
    words = WORD.findall(text.lower())
    h = index.hashes(words)
    found = index.candidates(h)
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) != len(h):  # lower-casing changed the words' number
        words = [text[a:b].lower() for a, b in spans]
        h = index.hashes(words)
        found = index.candidates(h)
    out = []
    for p, d in found:
        n, a, b = align(h, index.words[p], d)
        size, exact = len(index.words[p]), index.telling[p]
        short = size < EVERY
        if n and n / (size + (b + 1 - a - n if short else 0)) >= COVERAGE and (not (short or exact) or telling(words[a : b + 1]) == exact) and not (short and words[max(a - 1, 0) : a] in MODIFIED):
            out.append((-n / len(index.words[p]), a, b + 1, p, n))
    taken: dict[int, list[tuple[int, int]]] = {}
    kept = []
    for x in sorted(out):
        own = taken.setdefault(x[3], [])
        at = bisect.bisect(own, (x[1], x[2]))
        if not (at and own[at - 1][1] > x[1] or at < len(own) and own[at][0] < x[2]):
            own.insert(at, (x[1], x[2]))
            kept.append((index.of[x[3]], x[1], x[3], x[2], x[4]))
    matches: list[list[int]] = []  # template, first word, stop word, matched words, last paragraph
    for k, a, p, b, n in sorted(kept):
        if matches and matches[-1][0] == k and matches[-1][4] < p and a >= matches[-1][2]:
            matches[-1][2:] = b, matches[-1][3] + n, p
        else:
            matches.append([k, a, b, n, p])
    said, covered = [], np.zeros(len(h), bool)
    for n, coverage, a, b, k in sorted(((-n, -n / index.total[k], a, b, k) for k, a, b, n, _ in matches)):
        if 2 * int(covered[a:b].sum()) <= b - a:
            said.append((index.names[k], -coverage, spans[a][0], spans[b - 1][1], -n))
            covered[a:b] = True
    return sorted(said, key=lambda m: (m[2], m[3], m[0]))


def alternatives(templates: dict[str, str]) -> list[tuple[str, str]]:
    """(name, text) of all templates; the lines of a short name are templates of their own."""
    return sorted((name, one) for name, text in templates.items() for one in (text.split("\n") if name in SHORT and text else [text]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, start, stop, words of every template match in every whole text.

    A document without a match has no row, nor has a null or empty text; repeated rows are reported each time; other
    columns are left out. Templates of fewer than GRAM words can't be found; all templates' bytes must be under
    TEMPLATES_BOUND, since all go to every worker. One pass, no shuffle.
    """
    listed = alternatives(TEMPLATES if templates is None else templates)
    if sum(len((t or "").encode()) for _, t in listed) > TEMPLATES_BOUND:
        raise ValueError("the templates exceed TEMPLATES_BOUND")
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            rows = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in scan_text(t.as_py(), index)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "coverage", "start", "stop", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, start int, stop int, words int")
