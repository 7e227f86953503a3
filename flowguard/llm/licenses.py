"""License scans: winnowed fingerprints of templates find candidates, banded alignment measures them.

The templates' word trigrams are winnowed; an inverted index leads from a kept trigram to the
templates and places it comes from. Every trigram of a document is looked up. Hits of a template on
neighbouring diagonals make a candidate, whose template is aligned with the document's words in a
band around the diagonal. Reported are the words matched, their share of the template, and the span
in the document from the first to the last matched word.

The index grows with the templates, which are an argument of some hundred texts, not with the
documents. Tasks see one block of texts at a time.

Defined cases: null or empty texts and templates hold nothing; null ids are kept as null; repeated
rows give repeated results; an empty table gives an empty result. Other columns are neither read
nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from flowguard.llm.common import blocks, texts
from flowguard.llm.words import grams

TOKEN = re.compile(r"\w+")
GRAM, WINNOW, BAND = 3, 3, 6

#: Notices of public licences, word for word.
TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0"
                        " International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.""",
    "mit-notice": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.""",
}


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def hashes_of(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64)


def winnowed(fingerprints: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the smallest of each ``window`` consecutive fingerprints, the last of equals."""
    n = len(fingerprints)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(fingerprints[::-1]))]) if n else np.zeros(0, int)
    view = np.lib.stride_tricks.sliding_window_view(fingerprints, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        rows = []
        for t, words in enumerate(self.words):
            g = grams(hashes_of(words), GRAM)
            rows += [(int(g[p]), t, int(p)) for p in winnowed(g)]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.total = np.bincount(self.template, minlength=len(self.names))
        self.known = {w for words in self.words for w in words}


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND):
    """Best alignment of the whole template with words near a diagonal.

    Word i of the template may face words i + diagonal - band to i + diagonal + band. A match gives
    two points, a mismatch or a gap takes one; words before and after cost nothing. Returns words
    matched, and the first and the last matched word of the document.
    """
    width = 2 * band + 1
    code: dict[str, int] = {}
    t = np.array([code.setdefault(w, len(code)) for w in template])
    base = diagonal - band
    lo, hi = max(0, base), min(len(words), base + len(template) + width)
    line = np.full(len(template) + width, -1)
    line[lo - base:hi - base] = [code.get(w, -2) for w in words[lo:hi]]
    j = np.arange(width)
    score, hit = np.zeros(width), np.zeros(width, np.int64)
    first, last = np.full(width, -1), np.full(width, -1)
    for i, own in enumerate(t):
        same = line[i:i + width] == own
        across = score + np.where(same, 2, -1)
        above = np.r_[score[1:], -np.inf] - 1
        take = above > across
        src = np.where(take, np.minimum(j + 1, width - 1), j)
        new = np.where(take, above, across)
        got = same & ~take
        place = base + i + j
        n_hit = hit[src] + got
        n_first = np.where(got & (first[src] < 0), place, first[src])
        n_last = np.where(got, place, last[src])
        lifted = new + j
        best = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted >= best, j, 0))
        score, hit, first, last = best - j, n_hit[origin], n_first[origin], n_last[origin]
    end = int(np.argmax(score))
    return int(hit[end]), int(first[end]), int(last[end])


def find(index: Index, text: str, words: list[str], g: np.ndarray, min_share: float):
    """(template, start, end, matched, coverage) in one text, by start; spans in characters.

    Of findings that overlap, the one with the most matched words is kept.
    """
    at = np.searchsorted(index.keys, g)
    at[at == len(index.keys)] = 0
    hits = np.flatnonzero(index.keys[at] == g)
    if not len(hits):
        return []
    by: dict[int, list[int]] = {}
    for p in hits.tolist():
        k = int(at[p])
        while k < len(index.keys) and index.keys[k] == g[p]:
            by.setdefault(int(index.template[k]), []).append(p - int(index.place[k]))
            k += 1
    spans, found = None, []
    for t, diagonals in by.items():
        template, group = index.words[t], []
        for d in (*sorted(diagonals), None):
            if group and (d is None or d - group[0] > BAND):
                if 5 * len(group) >= index.total[t]:
                    n, first, last = align(template, words, group[len(group) // 2])
                    if n >= min_share * len(template):
                        if spans is None:
                            spans = [m.span() for m in TOKEN.finditer(text)]
                        found.append((index.names[t], spans[first][0], spans[last][1], n,
                                      n / len(template)))
                group = []
            group.append(d)
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-f[3], -f[4], f[1], f[0])):
        if all(f[2] <= k[1] or k[2] <= f[1] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[1])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES,
         min_share: float = 0.6) -> DataFrame:
    """(doc_id, license, start, end, n_matched, coverage): one row per notice found."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches):
        index = shared.value
        code = {w: xxhash.xxh3_64_intdigest(w.encode()) for w in index.known}
        for batch, values in blocks(batches):
            owners, rows = [], []
            for i, text in enumerate(values):
                lower = text.lower()
                words = TOKEN.findall(lower)
                # Words of no template can be in no fingerprint; they all hash to nought.
                g = grams(np.array([code.get(w, 0) for w in words], np.uint64), GRAM)
                # Where lower case has another length, places are those of its own.
                got = find(index, text if len(lower) == len(text) else lower, words, g,
                           min_share) if len(index.keys) else []
                owners += [i] * len(got)
                rows += got
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64()))]
                + [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "license", "start", "end", "n_matched", "coverage"])

    return texts(docs).mapInArrow(run, "doc_id long, license string, start long, end long, "
                                       "n_matched long, coverage double")
