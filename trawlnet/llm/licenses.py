"""License scan: MinHash bands over overlapping windows of words retrieve templates, exact shingle containment verifies them.

A template of m words belongs to the class of the least power of two w >= m. A text is covered by windows of 2w words, each beginning w
words after the one before, so any occurrence lies wholly in some window. A window that holds the part `containment` of a template's shingles has at
least a known Jaccard similarity with it; `band_settings` picks bands and rows so that a pair that similar meets in some band
with at least the wanted probability. Pairs that meet are verified by exact containment.
A window none of whose shingles belongs to a template can't meet any, so only others are signed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks, folding_table, mix, window_hashes, words

SHINGLE = 3
CONTAINMENT = 0.8
PROBABILITY = 0.999
MATCHES = "doc_id bigint, license string, containment double, first_word int, last_word int, windows int"

#: Public licence notices and texts.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def band_settings(similarity: float, probability: float, hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows such that pairs of that Jaccard similarity share a band with that probability, within so many hashes."""
    best = None
    for rows in range(1, 9):
        bands = max(1, math.ceil(math.log(1 - probability) / math.log1p(-min(similarity**rows, 1 - 1e-12))))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band setting reaches the probability within the hashes")
    return best


class Library:
    """Templates by class of length, with shingles, and what their signatures are by band."""

    def __init__(self, templates: list[tuple[str, str]], shingle: int, containment: float, probability: float):
        w = words(pa.array([t for _, t in templates]), folding_table())
        self.names, self.shingle, self.containment = [n for n, _ in templates], shingle, containment
        self.shingles = []
        self.classes: dict[int, list[int]] = {}
        for k in range(len(templates)):
            own = w.hashes[w.bounds[k] : w.bounds[k + 1]]
            s = np.unique(window_hashes(own, shingle))
            if not len(s):
                raise ValueError(f"a template has fewer than {shingle} words: {templates[k][1]!r}")
            self.shingles.append(s)
            self.classes.setdefault(max(4, 1 << (len(own) - 1).bit_length()), []).append(k)
        self.all = np.unique(np.concatenate(self.shingles))
        self.low_bits = np.zeros(1 << 16, bool)
        self.low_bits[self.all & np.uint64(0xFFFF)] = True
        self.bands: dict[int, tuple[int, int, list[dict[int, list[int]]]]] = {}
        for width, members in self.classes.items():
            # the window has at most 2 * width - shingle + 1 shingles, containment of the template's among them
            least = min(math.ceil(containment * len(self.shingles[k])) / (2 * width - shingle + 1 + len(self.shingles[k]) - math.ceil(containment * len(self.shingles[k]))) for k in members)
            bands, rows = band_settings(least, probability)
            tables: list[dict[int, list[int]]] = [{} for _ in range(bands)]
            for k in members:
                for table, key in zip(tables, self.signature(self.shingles[k], bands, rows)):
                    table.setdefault(int(key), []).append(k)
            self.bands[width] = (bands, rows, tables)

    @staticmethod
    def signature(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """A key per band: the combined minima of its rows' hash functions."""
        seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
        least = mix(shingles[None, :] ^ seeds[:, None]).min(1).reshape(bands, rows)
        return mix((least * (2 * np.arange(rows, dtype=np.uint64) + np.uint64(1))).sum(1, dtype=np.uint64))

    def scan(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, first word, last word) of each window that holds enough of a template."""
        s = window_hashes(hashes, self.shingle)
        maybe = np.flatnonzero(self.low_bits[s & np.uint64(0xFFFF)])
        at = maybe[np.isin(s[maybe], self.all)]
        at = at[at + self.shingle <= bounds[np.searchsorted(bounds, at, "right")]]
        text = np.searchsorted(bounds, at, "right") - 1
        out = []
        for width, (bands, rows, tables) in self.bands.items():
            place = at - bounds[text]
            # a window that begins at j * width holds the shingle if j * width <= place <= (j + 2) * width - shingle
            pairs = set()
            for t, p in zip(text.tolist(), place.tolist()):
                last = p // width
                first = max(0, -(-(p + self.shingle - 2 * width) // width))
                pairs.update((t, j) for j in range(first, last + 1))
            for t, j in sorted(pairs):
                lo = bounds[t] + j * width
                hi = min(lo + 2 * width, bounds[t + 1]) - self.shingle + 1
                own = s[lo:hi]
                if not len(own):
                    continue
                found = {k for table, key in zip(tables, self.signature(np.unique(own), bands, rows)) for k in table.get(int(key), ())}
                for k in sorted(found):
                    share = np.isin(self.shingles[k], own).mean()
                    if share >= self.containment:
                        inside = np.flatnonzero(np.isin(own, self.shingles[k]))
                        first_word = int(lo - bounds[t] + inside[0])
                        out.append((t, k, float(share), first_word, int(lo - bounds[t] + inside[-1] + self.shingle - 1)))
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, shingle: int = SHINGLE, containment: float = CONTAINMENT, probability: float = PROBABILITY) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word, windows) for each row of docs (doc_id, text) and license with a match.

    A match is a window of the grid of its template's class that holds at least `containment` of the template's distinct shingles.
    containment is that of the best window, the words (folded) those from its first to its last matched one, windows the matching
    windows of all templates of the license; of equals the first window, then the first template. Null and empty texts match nothing; a null doc_id stays
    null; repeated rows give repeated results; other columns are ignored.
    """
    library = Library(templates or TEMPLATES, shingle, containment, probability)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            w = words(piece.column("text"), folding_table())
            best: dict[tuple[int, str], tuple] = {}
            count: dict[tuple[int, str], int] = {}
            for t, k, share, first, last in library.scan(w.hashes, w.bounds):
                key = (t, library.names[k])
                count[key] = count.get(key, 0) + 1
                rank = (-share, first, k)
                if key not in best or rank < best[key][0]:
                    best[key] = (rank, share, first, last)
            ids = piece.column("doc_id")
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([t for t, _ in keys], pa.int64())),
                    pa.array([n for _, n in keys], pa.string()),
                    pa.array([best[k][1] for k in keys], pa.float64()),
                    pa.array([best[k][2] for k in keys], pa.int32()),
                    pa.array([best[k][3] for k in keys], pa.int32()),
                    pa.array([count[k] for k in keys], pa.int32()),
                ],
                ["doc_id", "license", "containment", "first_word", "last_word", "windows"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, MATCHES)
