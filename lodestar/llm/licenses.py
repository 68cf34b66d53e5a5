"""License notices in documents.

Words are runs of ASCII letters and digits, lower-cased. Word trigrams of the templates are winnowed into an inverted
index, and so are those of a document: a run of 5 unchanged words always leaves both sides a fingerprint in common.
Templates of up to ``SHORT`` words keep every trigram and are met by every trigram of a document. Hits on neighbouring
diagonals become one band; a band with at least ``share`` of the template's fingerprints is a candidate. A banded alignment
of the template against that stretch of the document gives the matched words (coverage = matched words / template
words), and the span from the first to the last of them in code points. Reported notices do not overlap.

The templates given here are notices and the short licenses as a whole; ``read_templates`` adds whole texts from a folder
of files. Defined results: null or empty text has no match; rows that repeat a doc_id are each scanned; of notices that
overlap, the one with most matched words is reported; a null doc_id is carried. Very long texts are scanned whole, and
only stretches around candidates are aligned. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import texts_as_bytes, window_hashes, word_hashes

_WORDS = re.compile(rb"[a-z0-9]+")
_WORDS_TEXT = re.compile("[A-Za-z0-9]+")
GRAM, WINDOW, BAND, SHORT = 3, 3, 8, 20

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _free_software(license_name: str, version: str) -> str:
    """The notice that the licenses of the GNU family ask for."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {license_name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {license_name} for more details."
    )


#: Fixed values: (license, text) of notices and headers as their publishers give them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_THIRD + _BSD_AS_IS),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    *((name, _free_software(long, version)) for name, long, version in (
        ("GPL-2.0", "GNU General Public License", "2"),
        ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"),
    )),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "ISC")),
]


def read_templates(folder: str) -> list[tuple[str, str]]:
    """A template for each file of a folder of whole license texts, named by the file."""
    return [(p.name, p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file()]


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the least gram, the rightmost of equal ones, of every window."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(v)) + WINDOW - 1 - np.argmin(v[:, ::-1], axis=1))


def align(template: np.ndarray, doc: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last matched place in ``doc``) of the longest common subsequence near a diagonal."""
    none = (0, -1, -1)
    prev: dict[int, tuple[int, int, int]] = {}
    best = none
    for i, t in enumerate(template.tolist()):
        row: dict[int, tuple[int, int, int]] = {}
        left = none
        for j in range(max(0, i + shift - band), min(len(doc), i + shift + band + 1)):
            up, diagonal = prev.get(j, none), prev.get(j - 1, none)
            got = max(left, up, key=lambda c: c[0])
            if doc[j] == t and diagonal[0] + 1 > got[0]:
                got = (diagonal[0] + 1, diagonal[1] if diagonal[0] else j, j)
            row[j] = left = got
            if got[0] > best[0]:
                best = got
        prev = row
    return best


def bands(shifts: list[int], band: int) -> list[tuple[int, int]]:
    """(diagonal, hits) of the runs of diagonals up to ``band`` wide; the diagonal is the one most hits are on."""
    out, group = [], []
    for s in [*sorted(shifts), None]:
        if group and (s is None or s - group[0] > band):
            times = Counter(group)
            out.append((max(times, key=lambda d: (times[d], -d)), len(group)))
            group = []
        if s is not None:
            group.append(s)
    return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float, share: float):
        self.least, self.share, self.names, self.words, self.marks = least, share, [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        long: dict[int, list[tuple[int, int]]] = {}
        for k, (name, text) in enumerate(templates):
            h = word_hashes(_WORDS.findall(text.encode().lower()))
            g = window_hashes(h, GRAM)
            picks = range(len(g)) if len(h) <= SHORT else winnow(g).tolist()
            self.names.append(name)
            self.words.append(h)
            self.marks.append(len(picks))
            for p in picks:
                (short if len(h) <= SHORT else long).setdefault(int(g[p]), []).append((k, p))
        self.indexes = [(np.array(sorted(x), np.uint64), x) for x in (short, long)]

    def _hits(self, g: np.ndarray) -> dict[int, list[int]]:
        """By template, the diagonals of the fingerprints that the document shares with it."""
        out: dict[int, list[int]] = {}
        picks = None
        for (keys, index), every in zip(self.indexes, (True, False), strict=True):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            known = np.flatnonzero(keys[at] == g)
            if not every and len(known):
                picks = winnow(g) if picks is None else picks
                known = np.intersect1d(known, picks, assume_unique=True)
            for p in known.tolist():
                for k, q in index[int(g[p])]:
                    out.setdefault(k, []).append(p - q)
        return out

    def scan(self, text: bytes) -> list[tuple[str, int, float, int, int, int]]:
        """(license, template, coverage, matched words, start, end) of the notices in a text."""
        h = word_hashes(_WORDS.findall(text.lower()))
        g = window_hashes(h, GRAM)
        found = []
        for k, shifts in (self._hits(g) if len(g) else {}).items():
            t = self.words[k]
            band = max(1, min(BAND, len(t) // 4))  # narrow for short notices, so that neighbours stay apart
            for s, hits in bands(shifts, band // 2):
                if hits < self.share * self.marks[k]:
                    continue
                if 0 <= s <= len(h) - len(t) and np.array_equal(h[s : s + len(t)], t):
                    found.append((len(t), s, s + len(t) - 1, k))
                    continue
                lo = max(0, s - band)
                n, a, b = align(t, h[lo : max(0, s + len(t) + band)], s - lo, band)
                if n >= self.least * len(t):
                    found.append((n, lo + a, lo + b, k))
        spans, taken, out = None, bytearray(len(h)), []
        # of notices that overlap the one with most words stays, then the one that is matched more fully
        for n, a, b, k in sorted(found, key=lambda f: (-f[0], len(self.words[f[3]]), f[1], f[3])):
            if not any(taken[a : b + 1]):
                taken[a : b + 1] = b"\1" * (b + 1 - a)
                spans = spans or [m.span() for m in _WORDS_TEXT.finditer(text.decode())]
                out.append((self.names[k], k, n / len(self.words[k]), n, spans[a][0], spans[b][1]))
        return sorted(out, key=lambda r: (r[4], r[1]))


_OUT = "doc_id long, license string, template int, coverage double, n_words long, start long, end long"


def _scan(templates: list[tuple[str, str]], least: float, share: float):
    def run(batches):
        scanner = Scanner(templates, least, share)
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True) if t for m in scanner.scan(t)]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "license", "template", "coverage", "n_words", "start", "end"])

    return run


def license_notices(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, share: float = 0.1) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, license, template, coverage, n_words, start, end)``, a row a notice.

    The templates are an argument of bounded size: they travel with the tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, least, share), _OUT)
