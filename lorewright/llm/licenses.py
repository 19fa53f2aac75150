"""Operator 2, license scans: winnowed fingerprints pick candidates, banded alignment measures them.

Each template is cut into word n-grams; the winnowed ones (the least hash of each few neighbours) form an inverted index
from hash to template and place. A document's n-grams are looked up in it; hits on one diagonal are one candidate,
and a local alignment of the template within a band around this diagonal reports the share of the template's words
that are matched, and the span of the document's words they lie in. Documents are read once and not shuffled; the index
follows the templates.

A long template, such as a full license text, drifts over many diagonals where words are left out or put between. Its hits in
a document are chained: each hit follows one before it in both texts at the least drift. The words between two neighbouring
hits of the chain, and those before the first and after the last, are aligned on their own, so the band follows the
document. Hits of a document that a template cannot have there (too few of its fingerprints) are not chained.

Templates of few words have no run of equal words to count on. All their single words are indexed, and a band of diagonals
is a candidate if it has as many hits as the coverage asks for; so nothing that an alignment would accept is missed.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, lists, map_text, mix, read_table, text_bytes
from .words import scan

#: Opening notices of widely used public licenses, as their texts recommend them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}
#: Full texts of short public licenses, without names and years.
FULL_TEXTS = {
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-3-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
GRAM, WINNOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Templates of more words have their hits chained; a chain needs this part of their fingerprints (at a coverage of 0.8, with
#: a fifth of the words left out and as many put between, about a third are left), and looks back so many hits.
LONG, FEWEST, LOOKBACK = 40, 0.1, 64
#: A chain may go over this part of the template's words without a hit, or drift by it.
REACH = 0.3
_ONE = 1 << 20
#: Templates of so many words at most are looked for by single words.
SHORT = 16
_FOLD = np.uint64(0x9FB21C651E98DF25)
_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * _FOLD ^ h[i : len(h) - n + 1 + i])
    return out


def align(template: list[int], words: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Matched words, and first and last of the document's words, of the best local alignment near a diagonal.

    A match scores 2, a substitution, insertion or deletion -1. ``diagonal``: the document word that meets the
    template's first one.
    """
    nothing = (0, 0, -1, -1)  # score, matches, first, last
    above = [nothing] * (2 * band + 2)
    best = nothing
    for i, t in enumerate(template):
        row = [nothing] * (2 * band + 2)
        for k in range(2 * band + 1):
            j = diagonal + i + k - band
            if not 0 <= j < len(words):
                continue
            score, matches, first, last = above[k]
            if words[j] == t:
                here = (score + 2, matches + 1, j if first < 0 else first, j)
            else:
                here = (score - 1, matches, first, last)
            for score, matches, first, last in (above[k + 1], row[k - 1] if k else nothing):
                if score - 1 > here[0]:
                    here = (score - 1, matches, first, last)
            if here[0] > 0:
                row[k] = here
                if here[0] > best[0]:
                    best = here
        above = row
    return best[1:]


def _block(template: np.ndarray, words: np.ndarray, free_end: bool) -> tuple[int, int]:
    """The best alignment of both from their starts on, to both ends or as far as it pays: its value, and the words gone over.

    The scores of :func:`align`; a value is the score times ``_ONE`` plus the matches, so of equal scores more matches win.
    """
    steps = np.arange(len(words) + 1, dtype=np.int64) * _ONE
    row, best, reach = -steps, 0, 0
    for t in template.tolist():
        here = np.empty_like(row)
        here[0] = row[0] - _ONE
        np.maximum(row[:-1] + np.where(words == t, 2 * _ONE + 1, -_ONE), row[1:] - _ONE, out=here[1:])
        row = np.maximum.accumulate(here + steps) - steps  # words put between
        if free_end and (top := int(row.max())) > best:
            best, reach = top, int(row.argmax())
    return (best, reach) if free_end else (int(row[-1]), len(words))


def _chain(place: np.ndarray, at: np.ndarray, reach: int) -> list[int]:
    """Numbers of the hits, sorted by ``at``, of the longest chain: each after the one before in both texts, at the least drift."""
    score, back = np.ones(len(at)), np.full(len(at), -1)
    for x in range(1, len(at)):
        low = max(0, x - LOOKBACK)
        di, dj = place[x] - place[low:x], at[x] - at[low:x]
        drift = np.abs(di - dj)
        value = np.where((di > 0) & (dj > 0) & (drift <= reach) & (di <= reach), score[low:x] + 1 - 0.5 * drift / (drift + reach), 0)
        k = int(value.argmax())
        if value[k] > 1:
            score[x], back[x] = value[k], low + k
    out, x = [], int(score.argmax())
    while x >= 0:
        out.append(x)
        x = int(back[x])
    return out[::-1]


class LicenseIndex:
    """The inverted index: hash of a winnowed n-gram, or of a short template's word, to (template, place)."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, winnow: int = WINNOW, band: int = BAND, coverage: float = COVERAGE):
        self.band, self.coverage, self.gram = band, coverage, gram
        self.words: dict[str, list[int]] = {}
        self.by_length: dict[int, dict[int, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))
        self.short: list[str] = []
        self.seeds: dict[str, tuple[int, int]] = {}
        single: list[tuple[int, int, int]] = []
        for name, text in sorted(templates.items()):
            data = np.frombuffer(text.encode(), np.uint8)
            h = scan(data, np.array([0, len(data)])).hash
            if not len(h):
                continue
            self.words[name] = h.tolist()
            if len(h) <= SHORT:
                single += [(word, len(self.short), place) for place, word in enumerate(h.tolist())]
                self.short.append(name)
                continue
            least = self.least(name)
            run = max(1, -(-least // (len(h) - least + 1)))  # equal words in a row that a match has at least
            n = min(gram, run)
            width = min(winnow, run - n + 1)
            g = _grams(h, n)
            picked = {int(np.argmin(g[i : i + width])) + i for i in range(max(1, len(g) - width + 1))}
            self.seeds[name] = (n, len(picked))
            for place in picked:
                self.by_length[n][int(g[place])].append((name, place))
        self.long = {name: np.array(words, np.uint64) for name, words in self.words.items() if len(words) > LONG}
        self.keys = {n: np.array(sorted(found), np.uint64) for n, found in self.by_length.items()}
        single.sort()
        self.single = np.array([x[0] for x in single], np.uint64)
        self.single_template, self.single_place = np.array([x[1] for x in single], np.int64), np.array([x[2] for x in single], np.int64)
        self.needed = np.array([self.least(name) for name in self.short], np.int64)

    def least(self, name: str) -> int:
        return max(1, math.ceil(self.coverage * len(self.words[name]) - 1e-9))

    def _short_hits(self, h: np.ndarray, row: np.ndarray) -> dict[tuple[int, str], list[tuple[int, int]]]:
        """(diagonal, word) of the single-word hits in bands of diagonals with enough of them, by row and template."""
        found: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
        if not len(self.short) or not len(h):
            return found
        lo, hi = np.searchsorted(self.single, h, "left"), np.searchsorted(self.single, h, "right")
        word = np.flatnonzero(hi > lo)
        n = (hi - lo)[word]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo[word], n)
        word = np.repeat(word, n)
        template, diagonal = self.single_template[entry], word - self.single_place[entry]
        # a row's diagonals follow those of the row before, so a band may touch the next row; it only makes a candidate more
        step = len(h) + SHORT + 2 * self.band + 2
        key = template * step + diagonal + SHORT
        order = np.argsort(key, kind="stable")
        key, word, template, diagonal = key[order], word[order], template[order], diagonal[order]
        last = np.searchsorted(key, key + 2 * self.band, "right")
        enough = np.flatnonzero(last - np.arange(len(key)) >= self.needed[template])
        change = np.zeros(len(key) + 1, np.int64)
        np.add.at(change, enough, 1)
        np.add.at(change, last[enough], -1)
        for i in np.flatnonzero(np.cumsum(change[:-1]) > 0).tolist():
            found[int(row[word[i]]), self.short[template[i]]].append((int(diagonal[i]), int(word[i])))
        return found

    def _centers(self, name: str, hits: list[tuple[int, int]]) -> list[int]:
        """Middles of the bands to align: around each hit; for a short template, above each one with enough hits in its band."""
        at = sorted(d for d, _ in hits)
        if len(self.words[name]) > SHORT:
            return sorted(set(at))
        least, out = self.least(name), []
        for i, d in enumerate(at):
            if i + least <= len(at) and at[i + least - 1] - d <= 2 * self.band and (not out or out[-1] != d + self.band):
                out.append(d + self.band)
        return out

    def _along(self, name: str, hits: list[tuple[int, int]], h: np.ndarray, begin: int, end: int) -> list[tuple[int, int, int]]:
        """(matched words, first, last) of the occurrences of a long template in a document's words, by chains of its hits."""
        template, (n, seeds) = self.long[name], self.seeds[name]
        fewest, reach, m = max(2, int(FEWEST * seeds)), int(REACH * len(template)) + self.band, len(template)
        out, parts = [], [(begin, end, sorted((at, at - d) for d, at in hits))]
        while parts:
            low, high, here = parts.pop()
            if len({p for _, p in here}) < fewest:
                continue
            at, place = (np.array(x) for x in zip(*here, strict=True))
            times = np.bincount(place)  # a gram that the document has again and again would crowd the others out
            rare = times[place] <= max(4, int(np.median(times[place])))
            chain = _chain(place[rare], at[rare], reach)
            if len(chain) < fewest:
                continue
            chained = list(zip(place[rare][chain].tolist(), at[rare][chain].tolist(), strict=True))
            i, j = chained[0]
            total, start, best = 0, (i, j), (0, (i, j), (i, j))
            for p, a in chained:  # the best stretch of the chain: what does not pay before it or after it is no part of it
                if p >= i and a >= j:
                    total += _block(template[i:p], h[j:a], False)[0] if p > i or a > j else 0
                    if total <= 0:
                        total, start = 0, (p, a)
                    total, i, j = total + n * (2 * _ONE + 1), p + n, a + n
                elif p - i == a - j:  # grams that overlap
                    total, i, j = total + (p + n - i) * (2 * _ONE + 1), p + n, a + n
                if total > best[0]:
                    best = (total, start, (i, j))
            total, (p, a), (i, j) = best
            before, gone = _block(template[:p][::-1], h[max(low, a - p - reach) : a][::-1], True)
            first = a - gone
            after, gone = _block(template[i:], h[j : min(high, j + m - i + reach)], True)
            matched, last = (total + before + after) & (_ONE - 1), j + gone - 1
            if matched >= self.least(name):
                out.append((matched, first, last))
                parts += [(low, first, [x for x in here if x[0] < first]), (last + 1, high, [x for x in here if x[0] > last])]
            else:  # no occurrence along this chain; the others may have one
                used = set(np.flatnonzero(rare)[chain].tolist())
                parts.append((low, high, [x for k, x in enumerate(here) if k not in used]))
        return out

    def matches(self, h: np.ndarray, row: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[str, float, int, int]]]:
        """Matches by row; word numbers are counted from the row's first word."""
        places = self._short_hits(h, row)
        for n, keys in self.keys.items():
            if len(h) < n:
                continue
            g = _grams(h, n)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for i in np.flatnonzero((keys[at] == g) & (row[: len(g)] == row[n - 1 :])).tolist():
                for name, place in self.by_length[n][int(g[i])]:
                    places[int(row[i]), name].append((i - place, i))
        out: dict[int, list[tuple[str, float, int, int]]] = defaultdict(list)
        for (r, name), hits in places.items():
            begin, template = int(first[r]), self.words[name]
            if name in self.long:
                out[r] += [(name, n / len(template), a - begin, b - begin) for n, a, b in self._along(name, hits, h, begin, int(first[r + 1]))]
                continue
            open_parts = [(begin, int(first[r + 1]), hits)]
            while open_parts:
                start, end, here = open_parts.pop()
                for d in self._centers(name, here):
                    lo, hi = max(start, d - self.band), min(end, d + len(template) + self.band + 1)
                    matched, a, b = align(template, h[lo:hi].tolist(), d - lo, self.band)
                    if matched >= self.least(name):
                        a, b = lo + a, lo + b
                        out[r].append((name, matched / len(template), a - begin, b - begin))
                        for left, right in ((start, a), (b + 1, end)):  # hits inside the match are this occurrence
                            if rest := [x for x in here if left <= x[1] < right]:
                                open_parts.append((left, right, rest))
                        break
        return out


def scan_licenses(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None, gram: int = GRAM, winnow: int = WINNOW, band: int = BAND, coverage: float = COVERAGE, carry_text: bool = True) -> DataFrame:
    """``docs`` with ``licenses``: (license, coverage, first_word, last_word) of each match, in the order of the words.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A match covers at least
    ``coverage`` of the template's words; its occurrences of one template do not overlap. A template of up to 16 words is
    found wherever an alignment on any diagonal accepts it. One of up to 40 is sure to be a candidate if its other words are
    replaced or left out (it is indexed by grams no longer than the run of equal words it then has); words put between may
    hide one only where they cut all such runs. A longer one is chained, if a tenth of its fingerprints and no gap of more
    than 0.3 of its words is there. Null and empty texts have no match. A template without words matches
    nothing. Other columns are carried; ``licenses`` of the input is replaced.
    """
    chosen = TEMPLATES | FULL_TEXTS if templates is None else templates

    def make():
        index = LicenseIndex(chosen, gram, winnow, band, coverage)

        def work(texts: pa.Array) -> list[pa.Array]:
            data, offs = text_bytes(texts)
            found, lengths = [], []
            for a, b in chunks(offs):
                tokens = scan(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                matches = index.matches(tokens.hash, tokens.row, np.searchsorted(tokens.row, np.arange(b - a + 1), "left"))
                for r in range(b - a):
                    rows = sorted(matches.get(r, ()), key=lambda m: (m[2], m[3], m[0]))
                    found += [dict(zip(("license", "coverage", "first_word", "last_word"), m, strict=True)) for m in rows]
                    lengths.append(len(rows))
            return [lists(pa.array(found, _MATCH), np.array(lengths, np.int64), _MATCH)]

        return work

    match = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
    return map_text(docs, text, make, T.StructType([T.StructField("licenses", T.ArrayType(match))]), carry_text)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
    spans = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["first_word"], m["last_word"]))
    return found.select("doc_id", F.size("licenses").alias("n_matches"), F.array_join(spans, ",").alias("spans"), F.array_max(F.transform("licenses", lambda m: m["coverage"])).alias("coverage"))
