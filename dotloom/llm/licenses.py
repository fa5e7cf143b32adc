"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

A document is compared line by line, and as a whole. Words are runs of letters, digits and dots
inside numbers, lower-cased; a unit's bigrams are a set. Dice = 2 |A & B| / (|A| + |B|) reaches the
threshold t only if |A| is within t / (2 - t) and (2 - t) / t times |B|, which prunes templates by
size before any comparison; and only units that hold a template's bigram are compared at all.

With ``passages`` a template is also found inside a document, across line breaks and among other
words: every window of as many words as the template has is compared. A window with t / (2 - t) of
the template's bigrams at least has as many hits close together, and only there windows are counted.
Of one template's windows that overlap the best stays, then the first. Of passages of one licence that
overlap, and of any that share half of the longer one, again the best (then the longest, by name, the
first); one that a line or a whole text already stands for does not count again.

Defined results: null is the empty text, which has no match; a unit of one word has that word as
its only gram; ties go to the higher-scoring, then alphabetically first licence; repeated rows get
a row each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, joined_names, text_of, tidy, views, word_names, words_in

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:\.[0-9]+)*")

#: Short notices and the openings of common licences; a licence may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
)

#: The notices that licences ask to be put at the head of files.
HEADERS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """The terms of licences, without copyright lines, by name of file."""
    return tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def bigrams(text: bytes) -> frozenset:
    """Distinct word pairs of a normalised unit; its only word if it has one."""
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False)) if len(words) != 1 else frozenset([(words[0],)])


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    """Templates by size and by bigram."""

    def __init__(self, templates, threshold: float):
        self.threshold = threshold
        grams = sorted((len(g), name, g) for name, g in {(n, bigrams(t.encode())) for n, t in templates})
        self.sizes = np.array([n for n, _, _ in grams])
        self.names, self.grams = [n for _, n, _ in grams], [g for _, _, g in grams]
        self.holders: dict[tuple, list[int]] = defaultdict(list)
        for i, g in enumerate(self.grams):
            for x in g:
                self.holders[x].append(i)

    def best(self, unit: frozenset) -> tuple[float, str] | None:
        """The highest (dice, name) of at least the threshold: only templates of fitting size that share a bigram."""
        t, n = self.threshold, len(unit)
        low = np.searchsorted(self.sizes, n * t / (2 - t) - 1e-9)
        high = np.searchsorted(self.sizes, n * (2 - t) / t + 1e-9, side="right")
        if low == high:
            return None
        shared: dict[int, int] = defaultdict(int)
        for x in unit:
            for i in self.holders.get(x, ()):
                if low <= i < high:
                    shared[i] += 1
        scored = [(2 * k / (n + len(self.grams[i])), self.names[i]) for i, k in shared.items()]
        fits = [x for x in scored if x[0] >= t]
        return min(fits, key=lambda x: (-x[0], x[1])) if fits else None


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _hashed_pairs(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the second word, hash) of adjacent words without regard to numbers' dots."""
    data = LOWER[data]
    start, end, row = words_in(data, offs, _LETTERS)
    word = word_names(data, start, end)
    if len(word) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pair = joined_names(word[:-1], word[1:])
    same = row[:-1] == row[1:]
    return start[1:][same], pair[same]


def _tokens(offs: np.ndarray, data: np.ndarray):
    """Starts, ends and rows of the words that ``_WORD`` finds in lower-cased bytes, never across rows."""
    start, end, row = words_in(data, offs, _LETTERS)
    if not len(start):
        return start, end, row
    digit = (data >= 48) & (data <= 57)
    goes_on = np.zeros(len(start), bool)  # dot and digits after a word belong to it
    goes_on[1:] = (start[1:] == end[:-1] + 1) & (data[end[:-1]] == 46) & digit[start[1:]] & (row[1:] == row[:-1])
    cut, at = [], []
    for i in np.flatnonzero(goes_on).tolist():
        other = np.flatnonzero(~digit[start[i] : end[i]])
        if len(other):  # the digits end the word before, the rest is a new word
            cut.append(start[i] + other[0])
            at.append(i)
    if at:
        i = np.array(at)
        start, row, goes_on = np.insert(start, i + 1, cut), np.insert(row, i + 1, row[i]), np.insert(goes_on, i + 1, False)
        end = np.insert(end, i, cut)
    new = np.flatnonzero(~goes_on)
    return start[new], end[np.r_[new[1:], len(start)] - 1], row[new]


def _token_pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    word = word_names(data, start, end)
    return joined_names(word[:-1], word[1:])


class Passages:
    """Windows of a document's words with as many words as a template."""

    def __init__(self, templates, threshold: float):
        self.threshold = threshold
        self.templates = []  # name, words, bigrams, fewest bigrams shared
        hashes = []
        for name, text in sorted(set(templates)):
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            start, end, _ = _tokens(np.array([0, len(data)]), data)
            if len(start) > 1:
                grams = bigrams(text.encode())
                self.templates.append((name, len(start), grams, int(np.ceil(len(grams) * threshold / (2 - threshold) - 1e-9))))
                hashes.append(np.unique(_token_pairs(data, start, end)))
        self.known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.member = np.array([np.isin(self.known, h) for h in hashes])

    def find(self, offs: np.ndarray, data: np.ndarray) -> dict[int, list[tuple[float, str, int, int]]]:
        """(dice, name, first byte, end) of windows that reach the threshold, by row."""
        data = LOWER[data]
        start, end, row = _tokens(offs, data)
        out: dict[int, list[tuple[float, str, int, int]]] = defaultdict(list)
        if len(start) < 2 or not len(self.known):
            return out
        pair = _token_pairs(data, start, end)
        kind = np.searchsorted(self.known, pair)
        kind[kind == len(self.known)] = 0
        hit = np.flatnonzero((self.known[kind] == pair) & (row[1:] == row[:-1]))
        kind = kind[hit]
        first = np.searchsorted(row, np.arange(len(offs)))
        for t, (name, words, grams, need) in enumerate(self.templates):
            p = hit[self.member[t, kind]]
            if len(p) < need:
                continue
            k = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] <= words - 2)
            low, high = p[k + need - 1] - (words - 2), p[k]  # starts of windows with these hits
            low, high = np.maximum(low, first[row[p[k]]]), np.minimum(high, first[row[p[k]] + 1] - words)
            same = (row[p[k]] == row[p[k + need - 1]]) & (low <= high)
            low, high, own = low[same], high[same], row[p[k]][same]
            apart = np.r_[True, (low[1:] > high[:-1] + 1) | (own[1:] != own[:-1])][: len(low)]
            cuts = np.flatnonzero(np.r_[apart, True])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                a, b = int(low[x]), int(high[y - 1])
                taken: list[int] = []
                # Best first, none over another of the same template; hashes choose, bytes decide.
                for _, i in sorted(self._reached(pair[a : b + words - 1], words - 1, self.known[self.member[t]], len(grams))):
                    at = bisect_left(taken, i)
                    if (at and i - taken[at - 1] < words) or (at < len(taken) and taken[at] - i < words):
                        continue
                    taken.insert(at, i)
                    begin, stop = int(start[a + i]), int(end[a + i + words - 1])
                    if (d := dice(bigrams(data[begin:stop].tobytes()), grams)) >= self.threshold:
                        out[int(own[x])].append((d, name, begin, stop))
        return out

    def _reached(self, pair: np.ndarray, width: int, own: np.ndarray, size: int) -> list[tuple[float, int]]:
        """(- dice, start) of the runs of ``width`` pairs whose dice reaches the threshold."""
        inside = np.isin(pair, own).tolist()
        names, counts, shared, out = pair.tolist(), Counter(), 0, []
        for i, x in enumerate(names):
            counts[x] += 1
            shared += inside[i] and counts[x] == 1
            if i >= width:
                gone = names[i - width]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                    shared -= inside[i - width]
            if i >= width - 1 and 2 * shared >= self.threshold * (len(counts) + size) - 1e-9:
                out.append((-2 * shared / (len(counts) + size), i - width + 1))
        return out


def _with_passages(units: list[tuple[float, str, int, int]], windows: list[tuple[float, str, int, int]]) -> list[tuple[float, str]]:
    """Units with a match and the passages beside them."""
    kept: dict[tuple[str, bool], list[tuple[int, int]]] = defaultdict(list)
    whole = max((b - a for _, _, a, b in units), default=0)
    for _, name, a, b in units:
        kept[name, b - a == whole].append((a, b))
    for spans in kept.values():
        spans.sort()
    out = [(d, name) for d, name, _, _ in units]
    for d, name, a, b in sorted(windows, key=lambda x: (-x[0], x[2] - x[3], x[1], x[2])):
        for (other, _), spans in kept.items():
            i = bisect_left(spans, (b, b)) - 1
            while i >= 0 and spans[i][1] > a:
                x, y = spans[i]
                if other == name or 2 * (min(b, y) - max(a, x)) >= max(b - a, y - x):
                    break
                i -= 1
            else:
                continue
            break
        else:
            spans = kept[name, False]
            spans.insert(bisect_left(spans, (a, b)), (a, b))
            out.append((d, name))
    return out


def _scan(templates, threshold: float, passages: bool):
    def run(batches):
        matcher = Matcher(templates, threshold)
        inner = Passages(templates, threshold) if passages else None
        sample = b"\n".join(t.encode() for _, t in templates)
        known = np.unique(_hashed_pairs(np.array([0, len(sample)]), np.frombuffer(sample, np.uint8))[1])
        # A unit that reaches the threshold shares this many bigrams with its template at least.
        few = max(1, int(np.ceil(min(map(len, matcher.grams)) * threshold / (2 - threshold) - 1e-9)))
        for batch in batches:
            texts = text_of(batch.column(1))
            out = []
            for _, offs, data in views(texts):
                place, pair = _hashed_pairs(offs, data)
                at = np.searchsorted(known, pair)
                at[at == len(known)] = 0
                place = place[known[at] == pair]
                cuts = np.union1d(offs, np.flatnonzero(data == 10) + 1)  # lines, never across documents
                hits = np.bincount(np.searchsorted(cuts, place, side="right") - 1, minlength=len(cuts) - 1)
                lines = np.searchsorted(cuts, offs)
                windows = inner.find(offs, data) if inner else {}
                for i in range(len(offs) - 1):
                    own = hits[lines[i] : lines[i + 1]]
                    units = [(cuts[k], cuts[k + 1]) for k in lines[i] + np.flatnonzero(own >= few)]
                    if len(own) > 1 and own.sum() >= few:
                        units.append((offs[i], offs[i + 1]))
                    matched = [(*x, int(a), int(b)) for a, b in units if (x := matcher.best(bigrams(data[a:b].tobytes())))]
                    found = _with_passages(matched, windows[i]) if i in windows else [x[:2] for x in matched]
                    best = min(found, key=lambda x: (-x[0], x[1])) if found else None
                    out.append((len(found), ",".join(sorted({n for _, n in found})), best[1] if best else None, best[0] if best else 0.0))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True))],
                ["doc_id", "n_matches", "licenses", "best_license", "best_dice"],
            )

    return run


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates=TEMPLATES, threshold: float = 0.9, passages: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_matches (units, and passages if asked for), licenses (sorted names), best_license, best_dice."""
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(tidy(_scan(tuple(templates), threshold, passages)), "doc_id long, n_matches long, licenses string, best_license string, best_dice double")


def scan_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.9) -> DataFrame:
    """:func:`scan_licenses` for notices, headers and full texts, anywhere in a document."""
    return scan_licenses(docs, text_col, id_col, (*TEMPLATES, *HEADERS, *full_texts()), threshold, passages=True)
