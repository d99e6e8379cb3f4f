"""License scan by patience alignment.

Texts and templates are compared as sequences of words (ASCII letters
lower-cased, ASCII punctuation treated as white space).  An alignment is
anchored on the words that occur exactly once in both ranges: the longest
increasing subsequence of their places is kept, and the gaps between anchors are
aligned in the same way.  A gap without anchors is matched from its two ends
as far as words are equal.  The coverage of a template is the share of its words that
are aligned.

Every place of a whole text is looked at: wherever one of a template's signal words
(words that aren't function words) stands, the stretch of one template length before
and after it is searched.  Overlapping stretches are joined and cut into windows of two
template lengths at steps of one, so each copy lies in a window whole.  One
more window, of one template length, is laid around every place of the template's lead
word, so that copies side by side don't spoil the uniqueness of words.  Where
finds overlap, the one with the most aligned words stays.
"""

from __future__ import annotations

from bisect import bisect_left
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import ready

MIN_COVERAGE = 0.8
# fixed values: wording of public license notices, and function words of English
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "mit": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
FUNCTION_WORDS = (
    "a an and any are as at be by can for form free from in is it later law may of on or person provided see that the this to "
    "use with you your work 0 2 3 4 v").split()
# end of fixed values
_BLANKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_BLANKS).split() if text else []


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j), both increasing, with a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = _increasing([(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence with increasing second parts, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def windows(hits: list[int], n: int, size: int) -> Iterator[tuple[int, int]]:
    """Windows of at most 2 * size words around the hits in a text of n words."""
    at = 0
    while at < len(hits):
        end = at
        while end + 1 < len(hits) and hits[end + 1] - hits[end] <= 2 * size:
            end += 1
        low, high = max(0, hits[at] - size), min(n, hits[end] + size + 1)
        start = low
        while True:
            yield start, min(high, start + 2 * size)
            if start + 2 * size >= high:
                break
            start += size
        at = end + 1


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.templates = {k: words_of(v.encode()) for k, v in sorted(templates.items())}
        plain = {w.encode() for w in FUNCTION_WORDS}
        # a template of function words alone is signalled by any of them
        self.signals = {k: set(w) - plain or set(w) for k, w in self.templates.items()}
        self.leads = {}
        for k, w in self.templates.items():
            once = [x for x in w if x in self.signals[k] and w.count(x) == 1] or [x for x in w if x in self.signals[k]]
            self.leads[k] = (once[0], w.index(once[0]))
        self.any_signal = set().union(*self.signals.values()) if self.signals else set()
        self.min_coverage = min_coverage

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, word after the last) of every find."""
        words = words_of(text)
        if self.any_signal.isdisjoint(words):
            return []
        hits = [(i, w) for i, w in enumerate(words) if w in self.any_signal]
        finds = set()
        for name, template in self.templates.items():
            size, (lead, lead_at) = len(template), self.leads[name]
            near = set(windows([i for i, w in hits if w in self.signals[name]], len(words), size))
            near |= {(max(0, i - lead_at), i - lead_at + size) for i, w in hits if w == lead}
            for low, high in near:
                found = align(words[low:high], template)
                if len(found) >= self.min_coverage * size:
                    finds.add((-len(found), name, low + found[0][0], low + found[-1][0] + 1))
        out: list[tuple[int, int, str, float]] = []  # none overlaps another, by place
        for n, name, first, end in sorted(finds):
            at = bisect_left(out, (first,))
            if (at == 0 or out[at - 1][1] <= first) and (at == len(out) or end <= out[at][0]):
                out.insert(at, (first, end, name, -n / len(self.templates[name])))
        return [(name, coverage, first, end) for first, end, name, coverage in out]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, coverage, first_word, end_word): the places of each
    text that cover a template by at least ``min_coverage``, none overlapping another.

    Of finds that overlap, the one with more aligned words stays, then the template
    first by name, then the earlier place.  Null and empty texts and texts without
    a template's words give no rows; templates without words are never found.  Rows
    given twice give their rows twice; null ids are kept.  Other columns are not read.
    """
    ready(docs.sparkSession)
    known = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if words_of(v.encode())}

    def run(batches):
        scanner = Scanner(known, min_coverage)
        for batch in batches:
            rows = [(i, *found) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in scanner.scan(t.as_py())]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "license_id", "coverage", "first_word", "end_word"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, license_id string, coverage double, first_word long, end_word long")
