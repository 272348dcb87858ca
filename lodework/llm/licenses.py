"""Licence notices in text by patience alignment with templates.

Where a stretch of a text holds enough of a template's words, text and template are aligned: words that occur once in
both are anchors, their longest increasing subsequence is kept, and the gaps between anchors, and before and after
them, are aligned again in the same way; equal words at the ends of a gap match.  Coverage is the share of the
template's words that matched.  A notice is found from ``COVERAGE`` on if the words that name the licence matched.

Whether a stretch can reach the coverage is a bound that holds for every alignment, so the search loses nothing: it
must hold that share of the template's words, each as often as needed at most.

Defined results: null or empty text has no notice; each place of a notice is one row, and of overlapping notices the
one with most matched words stays, then the one with more coverage, then the earlier; equal rows give equal rows; texts are
read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodework.llm.common import blocks, id_and_text, worker_store

COVERAGE = 0.8
#: Words of text looked at for each word of a template.
ROOM = 1.5
WORDS = re.compile(r"\w+")

# Fixed values: (licence, notice); words after * name the licence and must match.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the *Apache License, Version *2.0"),
    ("Apache-2.0", """Licensed under the *Apache License, Version *2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("MIT", "Released under the *MIT License"),
    ("MIT", "Licensed under the *MIT License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software."""),
    ("GPL-3.0", "This work is licensed under the *GNU *General Public License, version *3"),
    ("GPL-2.0", "This work is licensed under the *GNU *General Public License, version *2"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the *GNU *General Public
        License as published by the Free Software Foundation, either version *3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the *GNU *General Public
        License as published by the Free Software Foundation; either version *2 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "This work is licensed under the *GNU *Lesser General Public License, version *3"),
    ("AGPL-3.0", "This work is licensed under the *GNU *Affero General Public License, version *3"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the *Mozilla Public License, v. *2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD", "Released under the *BSD License"),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and *unencumbered software released into the public domain"),
    ("CC-BY-4.0", "This work is licensed under a *Creative *Commons *Attribution *4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a *Creative *Commons *Attribution *ShareAlike *4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has *waived all copyright and related or neighboring rights to this work"),
)


def rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct integers, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    below: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        below.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def patience(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (text, template), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1 and there.get(w) == 1}
        pairs = [(place[w], j) for j, w in enumerate(template[c:d], c) if w in place]
        anchors = [pairs[k] for k in rising([i for i, _ in pairs])]
        if not anchors:
            continue
        out.extend(anchors)
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Finder:
    """Templates as numbers, and what a text has of them."""

    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE):
        self.coverage, self.number, self.names, self.words, self.named = coverage, {}, [], [], []
        for name, notice in templates:
            words, named = [], []
            for marked in re.findall(r"\*?\w+(?:\.\w+)*", notice.lower()):
                for word in WORDS.findall(marked):
                    if marked[0] == "*":
                        named.append(len(words))
                    words.append(self.number.setdefault(word, len(self.number) + 1))
            self.names.append(name)
            self.words.append(words)
            self.named.append(named)
        self.counts = np.zeros((len(self.words), len(self.number) + 1))
        for t, words in enumerate(self.words):
            np.add.at(self.counts[t], words, 1)
        self.need = np.array([coverage * len(w) for w in self.words])

    def stretches(self, words: np.ndarray, t: int):
        """Windows that may hold template ``t``, best first in each run of windows."""
        room = int(ROOM * len(self.words[t])) + 1
        held = np.concatenate([[0], np.cumsum(self.counts[t][words] > 0)])
        ends = np.minimum(np.arange(len(words)) + room, len(words))
        todo = [(0, len(words), len(words))]  # windows that start from a to b and end by limit
        while todo:
            a, b, limit = todo.pop()
            if b <= a or limit - a < self.need[t]:
                continue
            last = np.minimum(ends[a:b], limit)
            sums = held[last] - held[a:b]
            best = int(sums.argmax())
            if sums[best] < self.need[t]:
                continue
            # of neighbouring windows that hold as much, the one that aligns best counts
            level = sums[best : best + room] == sums[best]
            level = len(level) if level.all() else int(level.argmin())
            found = yield [(a + i, int(last[i])) for i in range(best, best + level)]
            if found:
                todo += [(a, min(b, found[0]), found[0]), (max(a, found[1]), b, limit)]
            else:
                todo += [(a, a + best, limit), (a + best + level, b, limit)]

    def find(self, words: list[str]) -> list[tuple[str, int, int, int, float]]:
        """(licence, template, start, end, coverage) of the notices in a text."""
        every = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        # each word counts as often as the template has it, if the text has it at all
        present = np.bincount(every, minlength=self.counts.shape[1]) > 0
        present[0] = False
        out = []
        for t in np.flatnonzero(self.counts @ present >= self.need):
            search = self.stretches(every, t)
            windows = next(search, None)
            while windows is not None:
                best, found = [], None
                for a, b in windows:
                    pairs = [(a + i, j) for i, j in patience(every[a:b].tolist(), self.words[t])]
                    if len(pairs) > len(best) and {j for _, j in pairs}.issuperset(self.named[t]):
                        best = pairs
                if best and len(best) >= self.need[t]:
                    found = (best[0][0], best[-1][0] + 1)
                    out.append((len(best), self.names[t], int(t), *found, len(best) / len(self.words[t])))
                try:
                    windows = search.send(found)
                except StopIteration:
                    windows = None
        kept: list[tuple] = []
        for _, *x in sorted(out, key=lambda x: (-x[0], -x[5], x[3], x[2])):  # most matched words first
            if not any(x[2] < y[3] and y[2] < x[3] for y in kept):
                kept.append(tuple(x))
        return sorted(kept, key=lambda x: x[2])


RESULT = "doc_id bigint, license string, template int, start bigint, end bigint, coverage double"


def notices(docs: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each licence notice: where it is (numbers of words, end exclusive) and how much of its template it has."""

    def run(batches):
        finder = worker_store(f"licences {coverage}", lambda: Finder(coverage=coverage))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                rows = [(i, *x) for i, t in zip(ids[a:b], texts[a:b], strict=True) for x in finder.find(WORDS.findall(t.lower()))]
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, RESULT)
