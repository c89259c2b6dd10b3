"""License scans: overlapping windows of whole texts against license templates.

Words are lower-cased runs of ASCII letters and digits; years from 1900 to 2099 are all one word, in texts and in
templates. Templates fall into classes by their
number of word shingles, rounded up to a power of two, c. A class reads texts in windows of 2c
shingles that start every c, so whatever passage is as long as a template lies whole in a window.

``KNOWN`` holds notices of the usual public licenses, lines of copyright and the whole texts in
``licenses``; ``TEMPLATES``, the default, are its notices of a shingle or more. A text that holds several (a notice in a body, BSD-2-Clause in BSD-3-Clause) is
reported with each; of notices that differ by a version alone, the right one has the most of its
shingles found.

A window that holds the demanded share of a template's shingles has at least a known Jaccard
similarity to it. One-row MinHash bands, as many as that bound asks for, make a true window
collide with its template but for one case in ``1 / MISS``. Windows with fewer shingles of a class's
templates than the share of its smallest can't hold any and get no signature. What collides is verified: the share of the
template's shingles, as words, that the window holds.

One row for each document and template found: its fullest window's first and last shingle.
Null, empty and wordless texts match nothing. Templates shorter than a shingle are one shingle
of all their words. A very long text has windows over its whole length. Of equally full windows the first
counts. Equal documents and repeated rows match alike; rows with a null id are reported with it. An empty
table gives an empty one. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from importlib.resources import files

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .bpe import slices
from .common import Remembered

WORD = re.compile(r"[a-z0-9]+")
YEAR = re.compile(r"(?:19|20)[0-9][0-9]")
SHINGLE, CONTAINED, MISS = 5, 0.8, 1e-6
#: Templates travel with the tasks; more are refused.
MOST_TEMPLATES = 10_000

#: Notices and sentences by which public licenses are named or begin.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{k}-{v}", f"licensed under a Creative Commons {name} {v} {port} License") for v, port in (("4.0", "International"), ("3.0", "Unported")) for k, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Notices of fewer words than a shingle. The mark © is no word, so its lines are known by their year; any year will do.
SHORT = (
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Copyright", "Copyright (c)"),
    ("Copyright", "Copyright 2000"),
)
#: Whole licenses: the files beside this module, without lines of their holders.
BODIES = tuple((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))
#: All of them: what the query looks for.
KNOWN = TEMPLATES + SHORT + BODIES


def bands_for(jaccard: float, miss: float = MISS) -> int:
    """One-row bands after which a pair of that similarity collides but for ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def least_jaccard(contained: float = CONTAINED) -> float:
    """Of a template of more than c/2 shingles with a window of 2c that holds its share of it."""
    t, window = 0.5, 2.0
    return contained * t / (window + t - contained * t)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _class(word: str) -> str:
    return "<year>" if len(word) == 4 and YEAR.fullmatch(word) else word


class Matcher:
    """The index of some templates, and what a text holds of them."""

    def __init__(self, templates=TEMPLATES, size: int = SHINGLE, contained: float = CONTAINED):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        self.size, self.contained, self.known = size, contained, Remembered(lambda w: xxhash.xxh3_64_intdigest(_class(w)))
        bands = bands_for(least_jaccard(contained))
        rng = np.random.default_rng(4)
        self.factors = rng.integers(1, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words = [WORD.findall(text.lower()) for _, text in templates]
        self.sizes = sorted({min(size, len(w)) for w in self.words if w})
        self.shingles = [frozenset(self._tuples(w, min(size, len(w)))) for w in self.words]
        self.bands: dict[tuple[int, int], dict] = {}  # (shingle size, class) -> band, value -> templates
        every, of_class = defaultdict(list), defaultdict(list)
        for i, w in enumerate(self.words):
            if w:
                n = min(size, len(w))
                c = 1 << max(0, (len(self.shingles[i]) - 1).bit_length())
                hashes = self.hashes(self.ids(w), n)
                every[n].append(hashes)
                index = self.bands.setdefault((n, c), defaultdict(list))
                for band, value in enumerate(self.signature(np.unique(hashes))):
                    index[band, int(value)].append(i)
                of_class[n, c].append(hashes)
        self.every = {n: np.unique(np.concatenate(h)) for n, h in every.items()}
        self.of_class = {(n, c): np.isin(self.every[n], np.concatenate(h)) for (n, c), h in of_class.items()}  # for each of ``every``
        # shingles that a window must share with the templates of its class to hold any of them
        self.least = {k: min(math.ceil(contained * len(set(h.tolist())) - 1e-9) for h in hs) for k, hs in of_class.items()}

    @staticmethod
    def _tuples(words: list[str], n: int) -> list[tuple]:
        words = [_class(w) for w in words]
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    def ids(self, words: list[str]) -> np.ndarray:
        self.known.trim()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def hashes(self, h: np.ndarray, n: int) -> np.ndarray:
        """Of the shingles of ``n`` words with these ids."""
        out = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n if len(out) else 0):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return out

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([_mix(hashes[None, :] * f[:, None]).min(axis=1) for f in np.array_split(self.factors, 8)])

    def find(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """template -> (first word, end word, shingles found) of its fullest window."""
        words = WORD.findall((text or "").lower())
        ids = self.ids(words)
        best: dict[int, tuple] = {}
        for n in self.sizes:
            hashes = self.hashes(ids, n)
            every = self.every[n]
            place = np.minimum(np.searchsorted(every, hashes), len(every) - 1)
            hit = np.flatnonzero(every[place] == hashes)
            if not len(hit):
                continue
            place = place[hit]
            for (size, c), index in self.bands.items():
                if size != n:
                    continue
                at = hit[self.of_class[n, c][place]]
                if len(at) < self.least[n, c]:
                    continue
                block, hits = np.unique(at // c, return_counts=True)
                hits = dict(zip(block.tolist(), hits.tolist()))
                for k in sorted({*hits, *(b - 1 for b in hits if b)}):  # window k: shingles kc to kc + 2c
                    if hits.get(k, 0) + hits.get(k + 1, 0) < self.least[n, c]:
                        continue
                    begin = k * c
                    part = hashes[begin : begin + 2 * c]
                    met = {i for b, v in enumerate(self.signature(np.unique(part)).tolist()) for i in index.get((b, v), ())}
                    own = self._tuples(words[begin : begin + len(part) + n - 1], n) if met else []
                    for i in met:
                        at = [p for p, s in enumerate(own) if s in self.shingles[i]]
                        found = len({own[p] for p in at})
                        if found and found >= self.contained * len(self.shingles[i]) - 1e-9:
                            got = (-found, begin + at[0], begin + at[-1] + n)
                            best[i] = min(best.get(i, got), got)
        return {i: (a, b, -f) for i, (f, a, b) in best.items()}


@functools.lru_cache(2)
def matcher_of(templates: tuple, size: int, contained: float) -> Matcher:
    """Built once a worker."""
    return Matcher(templates, size, contained)


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, template (number), license, first_word, end_word, n_found, n_template."""
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "template", "license", "first_word", "end_word", "n_found", "n_template"]

    def run(batches):
        matcher = matcher_of(tuple(templates), SHINGLE, contained)
        for batch in batches:
            for part in slices(batch, 4_000_000):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows += [(doc_id, i, templates[i][0], a, b, f, len(matcher.shingles[i])) for i, (a, b, f) in sorted(matcher.find(text).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, template int, license string, first_word long, end_word long, n_found long, n_template long")
