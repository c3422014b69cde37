"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Templates are sorted into classes by their number of five-word shingles, each class up to twice the one
before. The windows of a class are three blocks of half its largest size, one block apart, so that some window
holds any run as long as a template of the class whole, and a template that is contained to 0.75 has a
Jaccard similarity of at least 0.23 with it (2/3 in the class of two, 1 in that of one). Bands have one row;
their number makes a miss rarer than one in ten thousand at that similarity. Block minima are shared by
the windows over them and by the next class, so the text is hashed once for all classes. A long text is gone
through in stretches that overlap by a window, so that memory is a few numbers a word.

The templates are a bounded table and go to every task; the texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, SPACE, as_bytes, bounded_batches, shingle_hashes, term_blocks, word_hashes

#: Share of a template's shingles that a text must hold.
CONTAINMENT = 0.75
#: Probability that no band of a matching window collides, at most.
MISS = 1e-4
#: Shingles of a text that are banded at once.
STRETCH = 1 << 15
#: Templates in one pass; more take more passes.
CHUNK = 20_000

#: License notices, short ones and whole texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
]
#: Notices of fewer than five words.
NOTICES = [("All-Rights-Reserved", "All rights reserved.")]
#: Words from which a template has more than one shingle.
LONG = 6


def similarity(k: int, least: float = CONTAINMENT) -> float:
    """The least Jaccard similarity of a window of class k with a template contained in it."""
    if k == 0:
        return 1.0
    fewest = 2 ** (k - 1) + 1
    return math.ceil(least * fewest) / (3 * 2 ** (k - 1) + fewest - math.ceil(least * fewest))


def bands(k: int, least: float = CONTAINMENT) -> int:
    s = similarity(k, least)
    return 1 if s == 1 else math.ceil(math.log(MISS) / math.log(1 - s))


def _permuted(shingles: np.ndarray, n: int) -> np.ndarray:
    """n permutations of 32-bit numbers, one a row."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.empty((n, len(x)), np.uint32)
    for i in range(n):
        y = (x ^ np.uint32(0x9E3779B9 * (i + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(15)
        out[i] = y * np.uint32(0xC2B2AE35)
    return out


class Templates:
    """Names, shingles and band values of templates."""

    def __init__(self, rows: list[tuple[str, str]], least: float = CONTAINMENT):
        self.least = least
        self.names = [name for name, _ in rows]
        self.sets = [np.unique(shingle_hashes(word_hashes(text))) for _, text in rows]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        of = [math.ceil(math.log2(len(s))) if len(s) else -1 for s in self.sets]
        for k in sorted({k for k in of if k >= 0}):
            n, keys, owners = bands(k, least), [], []
            for i, s in enumerate(self.sets):
                if of[i] == k:
                    keys.append(band_keys(_permuted(s, n).min(axis=1)[:, None]).ravel())
                    owners.append(np.full(n, i))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            self.classes[k] = key[order], owner[order]
        # templates of one shingle are found by their runs of letters and digits, at their own width
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, (_, text) in enumerate(rows):
            terms = np.concatenate([np.empty(0, np.uint64), *(h for h, _, _ in term_blocks(text))])
            if 0 < len(word_hashes(text)) < LONG and len(terms):
                whole = int(shingle_hashes(terms, len(terms))[0])
                self.short.setdefault(len(terms), {}).setdefault(whole, []).append(i)
        self.bands = max((bands(k, least) for k in self.classes), default=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """Numbers that stand for (band, value)."""
    return least.astype(np.uint64) | (np.arange(len(least), dtype=np.uint64)[:, None] << np.uint64(32))


def word_at(raw: np.ndarray, place: int) -> int:
    """The number, from 0, of the word in which the byte stands."""
    n, gap = 0, True
    for at in range(0, place + 1, BLOCK):
        space = SPACE[raw[at : min(at + BLOCK, place + 1)]]
        n += int(np.count_nonzero(~space & np.append(gap, space[:-1])))
        gap = space[-1]
    return n - 1


def short_ones(text, known: Templates) -> dict[int, int]:
    """The first word of each template of one shingle that the text holds, whatever punctuation touches it."""
    found: dict[int, int] = {}
    if not known.short:
        return found
    raw, most = as_bytes(text), max(known.short)
    terms, start = np.empty(0, np.uint64), np.empty(0, np.int64)
    for h, s, _ in term_blocks(raw):
        # what a run of terms may begin with is carried over
        terms, start = np.concatenate((terms[max(0, len(terms) - most + 1) :], h)), np.concatenate((start[max(0, len(start) - most + 1) :], s))
        for width, owners in known.short.items():
            if width > len(terms):
                continue
            shingles = shingle_hashes(terms, width)
            for at in np.flatnonzero(np.isin(shingles, np.array(list(owners), np.uint64))):
                for i in owners[int(shingles[at])]:
                    if i not in found:
                        found[i] = word_at(raw, int(start[at]))
    return found


def _hits(shingles: np.ndarray, known: Templates) -> Iterator[tuple[int, int, int]]:
    """(template, start, width) of each window that shares a band with a template."""
    minima, size = _permuted(shingles, known.bands), 1
    for k in range(max(known.classes, default=-1) + 1):
        if k > 1:  # blocks of the class before in pairs
            if minima.shape[1] % 2:
                minima = np.concatenate((minima, minima[:, -1:]), axis=1)
            minima, size = np.minimum(minima[:, ::2], minima[:, 1::2]), size * 2
        if k not in known.classes:
            continue
        own = minima[: bands(k, known.least)]
        if k:  # windows of three blocks; fewer where the text ends
            m = own.shape[1]
            padded = np.concatenate((own, own[:, -1:], own[:, -1:]), axis=1)
            own = np.minimum(np.minimum(padded[:, :m], padded[:, 1 : m + 1]), padded[:, 2:])
        keys, owners = known.classes[k]
        seen = band_keys(own)
        at = np.searchsorted(keys, seen)
        for b, w in zip(*np.nonzero(keys[np.minimum(at, len(keys) - 1)] == seen), strict=True):
            key, j = seen[b, w], at[b, w]
            while j < len(keys) and keys[j] == key:
                yield int(owners[j]), int(w) * size, 3 * size if k else 1
                j += 1


def scan(text, known: Templates) -> list[tuple[int, int, float, int]]:
    """(template, shingles held, containment, word where it starts) of each template that the text holds."""
    raw = as_bytes(text)
    shingles = shingle_hashes(word_hashes(raw))
    n = len(shingles)
    # stretches start where a block of the largest class does, and reach one window into the next
    block = 2 ** max(max(known.classes, default=0) - 1, 0)
    stretch = max(1, STRETCH // block) * block
    hits: set[tuple[int, int, int]] = set()
    for at in range(0, n, stretch):
        hits.update((i, at + start, width) for i, start, width in _hits(shingles[at : at + stretch + 3 * block], known))
    found: dict[int, tuple[int, int]] = {}
    for i, start, width in hits:
        t = known.sets[i]
        # a window's worth more on each side, for templates with insertions
        low, high = max(0, start - width), min(n, start + 2 * width)
        held = np.isin(shingles[low:high], t)
        count = len(np.unique(shingles[low:high][held]))
        if count >= known.least * len(t) and (i not in found or (-count, low) < (-found[i][0], found[i][1])):
            found[i] = (count, low + int(np.argmax(held)))
    for i, word in short_ones(raw, known).items() if n else ():
        found[i] = (1, min(word, found[i][1]) if i in found else word)
    return [(i, c, c / len(known.sets[i]), w) for i, (c, w) in sorted(found.items())]


_OUT = "doc_id long, license string, template int, n_shingles int, held int, containment double, word long"


def _scan(sent, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, held, share, word in scan(text, known):
                    rows.append((doc_id, known.names[i], base + i, len(known.sets[i]), held, round(share, 9), word))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + NOTICES, least: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, n_shingles, held, containment, word: a row for each template that a text holds.

    A-Z are lower-cased; words are separated by white space. Null, empty and short texts hold what their one
    shingle holds; a template of up to five words is held where its letters and digits stand in a row. Rows and
    templates may repeat, each is reported; null ids stay null. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for base in range(0, max(1, len(templates)), CHUNK):
        sent = docs.sparkSession.sparkContext.broadcast(Templates(templates[base : base + CHUNK], least))
        part = d.mapInArrow(_scan(sent, base), _OUT)
        out = part if out is None else out.unionByName(part)
    return out
