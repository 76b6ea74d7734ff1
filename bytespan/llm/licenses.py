"""Operator 8: licence texts by Dice coefficient over word bigrams.

Texts are normalised to runs of letters and digits in lower case.  Units are
the lines of a text and its blocks of several lines between blank lines.  A
unit matches the template with the largest Dice coefficient 2|A n B|/(|A|+|B|)
over distinct word bigrams, if it is ``PERCENT`` or more.  As |A n B| is at most
the smaller set, a template is compared only if its size lies within the factor
PERCENT/(200-PERCENT) of the unit's, and units with too few bigrams of any
template are passed over before any set is built.

Defined results: null or empty text, and units with fewer than two words, match
nothing; of templates with equal coefficient the name first in order wins;
repeated rows are reported each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts
from .decontaminate import grams
from .textarrays import LOWER, bounds, run_hashes, slices, text_buffer

PERCENT = 80

#: Licence statements and notices (fixed values, as their licensors word them).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, row, whether a block, and number within its row and sort."""
    start, end, row = bounds(data != 10, offsets)
    # line numbers count all line feeds before; blocks end where two follow each other
    feeds = np.r_[0, np.cumsum(data == 10)]
    line = feeds[start] - feeds[offsets[row]]
    double = np.zeros(len(data), bool)
    if len(data) > 1:
        double[:-1] = (data[:-1] == 10) & (data[1:] == 10)
    gaps = np.r_[0, np.cumsum(double)]
    block = gaps[start]
    head = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (row[1:] != row[:-1])][:len(start)])
    tail = np.r_[head[1:], len(start)] - 1
    long = tail > head
    head, tail = head[long], tail[long]
    return (np.r_[start, start[head]], np.r_[end, end[tail]], np.r_[row, row[head]],
            np.r_[np.zeros(len(start), bool), np.ones(len(head), bool)], np.r_[line, line[head]])


class Templates:
    """Bigram sets of the templates, by name and text in order."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.sets = [], []
        for name in sorted(templates):
            for text in templates[name]:
                data, offsets = text_buffer(pa.array([text]))
                h, _ = self.bigrams(data, offsets)
                if len(h):
                    self.names.append(name)
                    self.sets.append(frozenset(h.tolist()))
        self.all = np.array(sorted(set().union(*self.sets)), np.uint64)
        self.least = min(map(len, self.sets), default=0)

    @staticmethod
    def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of neighbouring words of a row, and where the pair's bytes end."""
        low = LOWER[data]
        start, end, row = bounds(_WORD[data], offsets)
        h, at = grams(run_hashes(low, start, end), row, 2)
        return h, np.stack([start[at], end[at + 1]]) if len(at) else np.zeros((2, 0), np.int64)

    def best(self, own: frozenset, percent: int) -> tuple[int, str, int] | None:
        """(twice the common bigrams, name, sum of sizes) of the best template within the size bounds."""
        found = None
        for name, t in zip(self.names, self.sets):
            n = len(own) + len(t)
            if 200 * min(len(own), len(t)) < percent * n:
                continue
            common = 2 * len(own & t)
            if 100 * common >= percent * n and (found is None or common * found[2] > found[0] * n):
                found = (common, name, n)
        return found


_FOUND = "doc_id long, unit string, line long, license string, common long, bigrams long"


def license_units(documents: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """-> doc_id, unit (line or block), line (number of its first line), license,
    common (bigrams shared), bigrams (sum of both sizes); Dice = 2 common / bigrams."""
    known = Templates(TEMPLATES if templates is None else templates)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(b.column("text"))
        out = []
        for i, j in slices(offsets):
            part, edge = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            h, span = known.bigrams(part, edge)
            hit = np.isin(h, known.all)
            if not hit.any():
                continue
            start, end, row, block, line = units(part, edge)
            # pairs whose words both lie in the unit: they are a stretch of all pairs
            a, z = np.searchsorted(span[0], start), np.searchsorted(span[1], end, "right")
            z = np.maximum(a, z)
            hits = np.r_[0, np.cumsum(hit)]
            # distinct common bigrams are at most the hits: 2 hits >= percent (own + least template)
            for u in np.flatnonzero((hits[z] - hits[a]) * 200 >= percent * (1 + known.least)).tolist():
                own = frozenset(h[a[u]:z[u]].tolist())
                if best := known.best(own, percent):
                    out.append((i + int(row[u]), "block" if block[u] else "line", int(line[u]), best[1], best[0] // 2, best[2]))
        cols = list(zip(*out)) if out else [()] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([b.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))],
                               names=[x.split()[0] for x in _FOUND.split(", ")])

    return map_batches(texts(documents), run, _FOUND)
