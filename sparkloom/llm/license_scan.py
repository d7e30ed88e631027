"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms.

1. Templates are cut into words. A match at ``min_coverage`` of an n-word template with no words put
   in has at most e = n - ceil(min_coverage * n) words changed or left out, so the others hold a run
   of ceil((n - e) / (e + 1)) unedited words. Hashes of so many consecutive words, ``GRAM`` at
   most, are all indexed, so every such match meets one. Where that run is at least
   GRAM + WINNOW - 1 words, hashes are winnowed: of every ``WINNOW`` consecutive hashes the smallest
   (rightmost on ties) is kept, and any shared run of that length meets a kept one. A match with words
   put in is sure to be met only if they leave a run of that length whole. An inverted index for
   each length of a run maps a hash to (template, position).
2. Every word run of every whole text is looked up. Hits close to one diagonal of a template
   make a candidate window of the text.
3. The template is aligned with the window by dynamic programming in a band about the
   diagonal (match 0; insertion, deletion, substitution 1; the window's ends are free).
   Coverage is matched template words / template words; a window at ``min_coverage`` or more is
   reported with its span in code points. An exact copy is recognised without alignment.

Words are runs of ASCII letters, digits and non-ASCII bytes, in lower case.

Defined cases: null or empty texts, and templates without words, match nothing;
overlapping windows of a template are one candidate, further copies are further rows; of
overlapping matches of different templates all are reported; repeated rows each give
their rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, mix, pieces, read_table, runs, utf8

GRAM, WINNOW = 4, 4
#: Words by which text and template may shift against each other within one match.
BAND = 8
#: Words of templates that are sent to a task at once; more are scanned for in parts.
MAX_TEMPLATE_WORDS = 1 << 20

#: Notices as their licences word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "bsd-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "mit-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(column: pa.Array, hasher: SpanHash):
    """Yield (first row, bytes, word starts, ends, hashes, per-row ranges) of runs of rows."""
    data, offsets = utf8(pc.ascii_lower(column))
    for first, part, ends in pieces(data, offsets):
        starts, stops, bounds = runs(_WORD[part], ends)
        yield first, part, ends, starts, stops, hasher(part, starts, stops), bounds


def gram_hashes(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each ``gram`` consecutive word hashes; the caller minds row ends."""
    n = max(0, len(h) - gram + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            out = out * np.uint64(0x100000001B3) + h[i : i + n]
    return mix(out)


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the hashes that are the smallest of some window."""
    n = len(grams)
    if n <= WINNOW:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))]) if n else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    return np.unique(np.arange(len(windows)) + WINNOW - 1 - np.argmin(windows[:, ::-1], axis=1))


def unedited_run(n: int, min_coverage: float) -> int:
    """Words of the longest unedited run that a match of an n-word template is sure to hold."""
    matched = min(n, max(1, int(np.ceil(min_coverage * n - 1e-9))))
    return -(-matched // (n - matched + 1))


class Index:
    """Templates' word hashes and the inverted index of their fingerprints, by run length."""

    def __init__(self, templates: Mapping[str, str], min_coverage: float = 0.8) -> None:
        self.names = sorted(templates)
        hasher = SpanHash()
        self.words = []
        for name in self.names:
            found = [h for *_, h, _ in word_hashes(pa.array([templates[name]]), hasher)]
            self.words.append(np.concatenate(found) if found else np.zeros(0, np.uint64))
        rows: dict[int, list] = {}
        for t, w in enumerate(self.words):
            if len(w):
                run = unedited_run(len(w), min_coverage)
                g = gram_hashes(w, gram := min(GRAM, run))
                kept = winnow(g) if run >= GRAM + WINNOW - 1 else range(len(g))
                rows.setdefault(gram, []).extend((int(g[p]), t, int(p)) for p in kept)
        self.by_gram = {}
        for gram, found in rows.items():
            found.sort()
            key, template, position = zip(*found)
            self.by_gram[gram] = np.array(key, np.uint64), np.array(template, np.int64), np.array(position, np.int64)

    def arrays(self) -> tuple:
        """What makes up the index, without its class: this is what tasks are sent."""
        return self.names, self.words, self.by_gram

    @classmethod
    def of(cls, arrays: tuple) -> Index:
        index = cls.__new__(cls)
        index.names, index.words, index.by_gram = arrays
        return index

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in text, template, position in template) of every posting met by the word
        hashes of rows."""
        parts = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        for gram, (key, template, position) in self.by_gram.items():
            grams = gram_hashes(h, gram)
            lo, hi = np.searchsorted(key, grams, "left"), np.searchsorted(key, grams, "right")
            at = np.flatnonzero(hi > lo)
            row = np.searchsorted(bounds, at, "right") - 1
            fits = at + gram <= bounds[row + 1]
            at, row = at[fits], row[fits]
            n = (hi - lo)[at]
            posting = np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            parts.append((np.repeat(row, n), np.repeat(at, n), template[posting], position[posting]))
        return tuple(np.concatenate(x) for x in zip(*parts))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best alignment of the whole template within ``text``; a template word i may meet text
    words i + shift - band .. i + shift + band. Returns (matched, first, last + 1 text word)."""
    m, width, big = len(template), 2 * band + 1, 1 << 20
    # column c of row i is text position i + shift - band + c, "text words used so far"
    used = shift - band + np.arange(width)
    cost = np.where((used >= 0) & (used <= len(text)), 0, big)
    moves = np.zeros((m, width), np.int8)  # 0 diagonal, 1 template word left out, 2 text word left out
    for i in range(m):
        word = i + shift - band + np.arange(width)  # text word consumed by a diagonal step to row i + 1
        inside = (word >= 0) & (word < len(text))
        same = inside & (text[np.clip(word, 0, len(text) - 1)] == template[i])
        diagonal = np.where(inside, cost + np.where(same, 0, 1), big)
        skip = np.append(cost[1:], big) + 1  # same text position is one column further in the row above
        new = np.minimum(diagonal, skip)
        moves[i] = np.where(diagonal <= skip, 0, 1)
        # leave out text words: runs from left to right
        run = np.minimum.accumulate(new - np.arange(width)) + np.arange(width)
        reach = (run < new) & (word + 1 <= len(text))
        moves[i][reach] = 2
        cost = np.where(reach, run, new)
    c = int(np.argmin(cost))
    if cost[c] >= big:  # the window is too short for any path within the band
        return 0, 0, 0
    matched, first, last, i = 0, None, None, m
    while i > 0:
        move = moves[i - 1][c]
        word = i - 1 + shift - band + c
        if move == 0:
            if text[word] == template[i - 1]:
                matched += 1
                first, last = word, last if last is not None else word + 1
            i -= 1
        elif move == 1:
            c, i = c + 1, i - 1
        else:
            c -= 1
    return matched, (first if first is not None else 0), (last if last is not None else 0)


def scan_text(index: Index, words: np.ndarray, place: np.ndarray, template: np.ndarray, position: np.ndarray, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, last + 1 word) of one text's matches: exact copies first, then
    aligned windows that meet none of them, nor each other."""
    out = []
    begin = place - position  # where the template would begin
    for t in np.unique(template).tolist():
        own = index.words[t]
        n = len(own)
        values, times = np.unique(begin[template == t], return_counts=True)
        taken: list[tuple[int, int]] = []  # spans, in order
        for v in values.tolist():
            if v >= 0 and v + n <= len(words) and (not taken or taken[-1][1] <= v) and (words[v : v + n] == own).all():
                taken.append((v, v + n))
                out.append((t, n, v, v + n))
        copies = np.array([a for a, _ in taken], np.int64)
        if len(copies):
            at = np.clip(np.searchsorted(copies, values, "right") - 1, 0, len(copies) - 1)
            after = np.minimum(at + 1, len(copies) - 1)
            clear = (np.abs(values - copies[at]) >= n) & (np.abs(values - copies[after]) >= n)
            values, times = values[clear], times[clear]
        slack = min(BAND, max(1, n // 4))
        lo, free = 0, 0  # no window begins before the end of the last one
        while lo < len(values):
            hi = lo + 1
            while hi < len(values) and values[hi] - values[hi - 1] <= slack and values[hi] - values[lo] <= n // 2:
                hi += 1
            guess = int(values[lo + int(np.argmax(times[lo:hi]))])
            band = slack + int(values[hi - 1] - values[lo])
            left = max(free, guess - band, 0)
            part = words[left : max(left, guess + n + band)]
            if len(part):
                matched, first, last = align(own, part, guess - left, band)
                if matched and matched >= min_coverage * n - 1e-9:
                    out.append((t, matched, left + first, left + last))
                    free = left + last
            lo = hi
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = 0.8) -> DataFrame:
    """(id, template, matched_words, template_words, coverage, span_start, span_end) of every
    match; spans count code points of the text, the end exclusive."""
    names = sorted(templates)
    size = np.cumsum([len(templates[x].split()) for x in names])
    parts = [dict(some) for _, some in groupby(((x, templates[x]) for x in names), key=lambda item: int(size[names.index(item[0])]) // MAX_TEMPLATE_WORDS)]
    if len(parts) > 1:
        return reduce(DataFrame.unionAll, [scan(docs, part, id_col, text_col, min_coverage) for part in parts])
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates, min_coverage).arrays())

    def run(batches):
        index, hasher = Index.of(sent.value), SpanHash()
        for batch in batches:
            found = []
            for first, part, ends, starts, stops, h, bounds in word_hashes(batch.column(1), hasher):
                row, place, template, position = index.hits(h, bounds)
                by_row = np.argsort(row, kind="stable")
                row, place, template, position = row[by_row], place[by_row], template[by_row], position[by_row]
                for r in np.unique(row).tolist():
                    own = slice(*np.searchsorted(row, [r, r + 1]).tolist())
                    base, top = int(bounds[r]), int(bounds[r + 1])
                    matches = scan_text(index, h[base:top], place[own] - base, template[own], position[own], min_coverage)
                    if matches:
                        points = np.cumsum((part[ends[r] : ends[r + 1]] & 0xC0) != 0x80)  # code points up to each byte
                    for t, matched, a, b in matches:
                        lo, hi = int(starts[base + a] - ends[r]), int(stops[base + b - 1] - ends[r])
                        n = len(index.words[t])
                        found.append((first + r, index.names[t], matched, n, matched / n, int(points[lo]) - 1, int(points[hi - 1])))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i + 1] for x in found], k) for i, k in enumerate(kinds))], ["id", "template", "matched_words", "template_words", "coverage", "span_start", "span_end"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, template string, matched_words long, template_words long, coverage double, span_start long, span_end long").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
