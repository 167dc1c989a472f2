"""License scan: Dice coefficient over word bigrams between text segments and license templates.

Segments of a document are its lines and its paragraphs (runs of lines that aren't blank).
Segment and template are normalised to lower-case words; each is the set of its word bigrams. A
template matches a segment if 2 |A and B| / (|A| + |B|) >= THRESHOLD. From the sizes alone, only
templates with |B| between t/(2-t) |A| and (2-t)/t |A| can match, and a match needs at least
t (|A| + |B|) / 2 common bigrams; segments that can't reach that with any template
drop out before a set is built.

Runs of consecutive sentences, over paragraphs too, and runs of consecutive lines are segments as well, so
that a license of several paragraphs and a license sentence within a longer line are found. They are built only where a text
has enough bigrams of a template, and up to the largest size that it allows. Runs overlap each other and
lines and paragraphs; of overlapping ones, that counts which has most common bigrams beyond those
it needs, 2 |A and B| - t (|A| + |B|), then the longer; a line and its paragraph both count.

A segment belongs to the license of its best template alone.

Result: doc_id, license_id, dice (the best of the document's segments), n_segments (segments
of that license). A paragraph of a single line is that line and counts once. The SQL
has lines and paragraphs, but no runs.

Templates are notices and license sentences, and the full texts in license_texts. Those of more than LARGE bigrams
are looked for only in texts that have enough of their bigrams, so that they cost little elsewhere. The templates are
broadcast; they don't grow with the corpus.

Defined results: null and empty texts and segments of fewer than two words match nothing; a null doc_id is
carried along, one row for all such documents; repeated rows of a doc_id give the row of one;
ties between templates give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _text

THRESHOLD = 0.8
#: Bigrams beyond which a template is looked for by whole texts first.
LARGE = 400

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""

_LESSER = """{k} is free software{s} you can redistribute it and/or modify it under the terms of the GNU {n} General Public License as published by
the Free Software Foundation{c} either version {v} of the License, or (at your option) any later version. {k} is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
{n} General Public License for more details."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of
the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""

#: (license_id, text); an identifier may have several templates.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0."),
    ("GPL-3.0", _GPL.format(v=3)), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-2.0", _GPL.format(v=2)), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-2-Clause", _BSD), ("BSD-3-Clause", _BSD + _BSD3), ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("ISC", _ISC),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("LGPL-2.1", _LESSER.format(k="This library", s=";", n="Lesser", c=";", v="2.1")), ("LGPL-3.0", _LESSER.format(k="This program", s=":", n="Lesser", c=",", v="3")),
    ("AGPL-3.0", _LESSER.format(k="This program", s=":", n="Affero", c=",", v="3")), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("BSL-1.0", _BOOST), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("0BSD", _ZERO),
]


@cache
def all_templates() -> list[tuple[str, str]]:
    """TEMPLATES and the full texts, whose files are named after their identifiers; read where the query is made only."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [*TEMPLATES, *((f.stem, f.read_text("utf-8")) for f in files)]


_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:()")] = True

SCHEMA = "doc_id long, license_id string, dice double, n_segments long"


def _pairs(h: np.ndarray) -> np.ndarray:
    return _text.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


class _Group:
    """Templates that are looked for together, and what tells quickly that a segment has none of them."""

    def __init__(self, members: list[int], sets: list[np.ndarray], t: float):
        self.members = members
        self.known = np.unique(np.concatenate([*(sets[k] for k in members), np.zeros(0, np.uint64)]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        sizes = np.array([len(sets[k]) for k in members])
        self.least = t / (2 - t) * sizes.min() if len(sizes) else np.inf
        self.most = (2 - t) / t * sizes.max() if len(sizes) else 0

    def hits(self, g: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Places of the bigrams, within one text, that some template has."""
        at = np.flatnonzero(self.maybe[(g >> np.uint64(44)).astype(np.int64)] & inner)
        return at[np.isin(g[at], self.known)]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.t = threshold
        self.ids = [i for i, _ in templates]
        words = _text.Words(pa.array([x for _, x in templates], pa.string()))
        h = words.hashes()
        self.sets = [np.unique(_pairs(h[words.first[k] : words.first[k + 1]])) for k in range(len(templates))]
        some = [k for k, x in enumerate(self.sets) if len(x)]
        self.small = _Group([k for k in some if len(self.sets[k]) <= LARGE], self.sets, threshold)
        self.large = _Group([k for k in some if len(self.sets[k]) > LARGE], self.sets, threshold)

    def scan(self, column: pa.Array) -> list[tuple[int, str, float, tuple[int, int]]]:
        """(row, license, dice, words of the segment) of every match."""
        words = _text.Words(column)
        if len(words) < 2:
            return []
        g = _pairs(words.hashes())
        text_of = words.text_of
        inner = text_of[1:] == text_of[:-1]
        small, large = self.small.hits(g, inner), self.large.hits(g, inner)
        # a segment needs as many hits as the least template needs common bigrams, and so does its text
        enough = np.bincount(text_of[large], minlength=words.n_texts) >= self.t / (2 - self.t) * self.large.least
        large = large[enough[text_of[large]]]
        if not len(small) and not len(large):
            return []
        lines = np.cumsum(words.buf == 10)
        line = np.concatenate([[0], lines])[words.starts] + text_of  # a text's end ends its line too
        # a paragraph ends where two newlines have only white space between them
        newline = np.flatnonzero(words.buf == 10)
        ink = np.concatenate([[0], np.cumsum(words.buf > 32)])
        blank = newline[:-1][ink[newline[1:]] == ink[newline[:-1]]] if len(newline) > 1 else newline[:0]
        para = np.searchsorted(blank, words.starts) + text_of
        whole: dict[tuple[int, str, tuple[int, int]], tuple[float, float]] = {}
        runs: dict[tuple[int, str, tuple[int, int]], tuple[float, float]] = {}
        for group, at in ((self.small, small), (self.large, large)):
            if len(at):
                self._segments(words, g, at, (line, para), group, whole)
                self._runs(words, g, at, line, para, group.members, runs)
        return self._resolve(whole, runs, len(words))

    def _segments(self, words: _text.Words, g: np.ndarray, at: np.ndarray, kinds: tuple[np.ndarray, ...], group: _Group, out: dict) -> None:
        """Matches of lines and paragraphs: (row, license, span) to Dice and what it has beyond the threshold."""
        for seg in kinds:
            inside = at[seg[at] == seg[at + 1]]
            ids, counts = np.unique(seg[inside], return_counts=True)
            lo, hi = np.searchsorted(seg, ids, "left"), np.searchsorted(seg, ids, "right")
            # at most `counts` common bigrams and at least least/2 of them are needed
            for a, b, n in zip(lo.tolist(), hi.tolist(), counts.tolist(), strict=True):
                size = b - a - 1
                if size < group.least or n < self.t / 2 * group.least:
                    continue
                own = np.unique(g[a : b - 1])
                if len(own) > group.most:
                    continue
                for k in group.members:
                    other = self.sets[k]
                    if len(own) < self.t / (2 - self.t) * len(other) - 1e-9 or len(own) > (2 - self.t) / self.t * len(other) + 1e-9 or n < self.t * (len(own) + len(other)) / 2 - 1e-9:
                        continue
                    dice = 2 * len(np.intersect1d(own, other, assume_unique=True)) / (len(own) + len(other))
                    if dice >= self.t:
                        row = int(np.searchsorted(words.first, a, "right") - 1)
                        key = (row, self.ids[k], (a, b))
                        out[key] = max((dice, (dice - self.t) * (len(own) + len(other))), out.get(key, (0.0, 0.0)))

    def _runs(self, words: _text.Words, g: np.ndarray, at: np.ndarray, line: np.ndarray, para: np.ndarray, members: list[int], found: dict) -> None:
        """Matches of runs of sentences and of lines: (row, license, span) to Dice and what it has beyond the threshold."""
        text_of = words.text_of
        stop, blank = (np.concatenate([[0], np.cumsum(x)]) for x in (_STOP[words.buf], words.buf <= 32))
        ended = (stop[words.starts[1:]] > stop[words.ends[:-1]]) & (blank[words.starts[1:]] > blank[words.ends[:-1]])
        marks = [np.concatenate([[True], x]) for x in (ended | (para[1:] != para[:-1]), line[1:] != line[:-1])]
        for k in members:
            other = self.sets[k]
            need, most = self.t / (2 - self.t) * len(other) - 1e-9, (2 - self.t) / self.t * len(other) + 1e-9
            mine = at[np.isin(g[at], other)]
            rows, first, counts = np.unique(text_of[mine], return_index=True, return_counts=True)
            for row, f, n in zip(rows.tolist(), first.tolist(), counts.tolist(), strict=True):
                hits = mine[f : f + n]
                if n < need or len(np.unique(g[hits])) < need:
                    continue
                lo, hi = int(words.first[row]), int(words.first[row + 1])
                pairs, template = g[lo : hi - 1].tolist(), set(other.tolist())
                for mark in marks:
                    cuts = np.append(np.flatnonzero(mark[lo:hi]), hi - lo)
                    # a run that begins or ends with a unit without a hit's word is worse than the run without that unit
                    units = np.unique(np.searchsorted(cuts, np.concatenate([hits, hits + 1]) - lo, "right") - 1)
                    left = n - np.searchsorted(hits, cuts[units] + lo)
                    for a, b, size, common in _walk(pairs, template, cuts.tolist(), units[left >= need].tolist(), units.tolist(), most):
                        dice = 2 * common / (size + len(other))
                        if dice >= self.t:
                            key = (row, self.ids[k], (a + lo, b + lo))
                            found[key] = max((dice, (dice - self.t) * (size + len(other))), found.get(key, (0.0, 0.0)))

    @staticmethod
    def _resolve(whole: dict, runs: dict, n_words: int) -> list[tuple[int, str, float, tuple[int, int]]]:
        """Lines and paragraphs, and the runs that no better segment overlaps; these replace worse lines and paragraphs."""
        spans: dict[tuple[int, int], list] = {}
        old = {span for _, _, span in whole}
        for (row, lic, span), (dice, beyond) in [*whole.items(), *((k, v) for k, v in runs.items() if k[2] not in old)]:
            spans.setdefault(span, []).append((dice, beyond, row, lic))
        taken, by_run = np.zeros(n_words, bool), np.zeros(n_words, bool)
        out = []
        for span in sorted(spans, key=lambda x: (-round(max(spans[x])[1], 9), x[0] - x[1], x[0])) if len(old) < len(spans) else spans:
            a, b = span
            if (by_run if span in old else taken)[a:b].any():
                continue
            taken[a:b] = True
            by_run[a:b] |= span not in old
            best = max(spans[span])[0]
            out += [(row, lic, dice, span) for dice, _, row, lic in spans[span] if dice == best]
        return out


def _walk(pairs: list[int], template: set[int], cuts: list[int], starts: list[int], units: list[int], most: float):
    """(first word, end, different bigrams, common ones) of the runs of units that have at most `most` bigrams."""
    place = {u: i for i, u in enumerate(units)}
    for u in starts:
        a, head = cuts[u], cuts[u + 1]
        seen: set[int] = set()
        common, upto = 0, a
        for v in units[place[u] :]:
            b = cuts[v + 1]
            for x in pairs[upto : b - 1]:
                if x not in seen:
                    seen.add(x)
                    common += x in template
                    if len(seen) > most:
                        break
            if len(seen) > most:
                break
            upto = max(upto, b - 1)
            yield a, b, len(seen), common
            # once the first unit returns, longer runs are no better than those without it
            if v > u and pairs[cuts[v] : b - 1] == pairs[a : head - 1] and (pairs[head - 1] not in template or pairs[b - 1 : b] == pairs[head - 1 : head]):
                break


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and license found in it."""
    shared = docs.sparkSession.sparkContext.broadcast(all_templates() if templates is None else templates)

    def run(batches):
        scanner = Scanner(shared.value, threshold)
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            found: dict[tuple[int, str], tuple[float, int]] = {}
            for a, b in _text.slices(text):
                for row, lic, dice, _ in scanner.scan(text.slice(a, b - a)):
                    best, n = found.get((a + row, lic), (0.0, 0))
                    found[a + row, lic] = (max(best, dice), n + 1)
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [pc.take(ids, pa.array([r for r, _ in rows], pa.int64())), pa.array([x for _, x in rows], pa.string()), pa.array([found[r][0] for r in rows], pa.float64()), pa.array([found[r][1] for r in rows], pa.int64())],
                names=["doc_id", "license_id", "dice", "n_segments"],
            )

    matches = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return matches.groupBy("doc_id", "license_id").agg(F.max("dice").alias("dice"), F.max("n_segments").alias("n_segments"))


def licenses_sql(threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB."""
    values = ", ".join("({}, '{}', '{}')".format(k, i, x.replace("'", "''")) for k, (i, x) in enumerate(all_templates()))

    def words(x: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({x}), '[\\x00-/:-@\\[-^`{{-\\x7f]+'), lambda x: x <> '')"

    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH tpl AS (SELECT k, license_id, {pairs} AS b FROM (SELECT k, license_id, {words("text")} AS w FROM (VALUES {values}) v(k, license_id, text)) t),
    paras AS (SELECT doc_id, p.i AS p, regexp_split_to_array(text, '\\n[\\x00-\\x09\\x0b-\\x20]*\\n[\\x00-\\x20]*')[p.i] AS para
              FROM documents, range(1, 1 + len(regexp_split_to_array(text, '\\n[\\x00-\\x09\\x0b-\\x20]*\\n[\\x00-\\x20]*'))) p(i)),
    segs AS (SELECT doc_id, p, 0 AS l, {words("para")} AS w FROM paras
             UNION ALL SELECT doc_id, p, l.i, {words("string_split(para, chr(10))[l.i]")} FROM paras, range(1, 1 + len(string_split(para, chr(10)))) l(i)),
    sized AS (SELECT DISTINCT doc_id, p, w, {pairs} AS b FROM segs WHERE len(w) >= 2),
    dice AS (SELECT doc_id, license_id, p, w, max(2.0 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b))) AS d
             FROM sized s, tpl t WHERE len(s.b) BETWEEN {threshold} / (2 - {threshold}) * len(t.b) - 1e-9 AND (2 - {threshold}) / {threshold} * len(t.b) + 1e-9
             GROUP BY doc_id, license_id, p, w QUALIFY d = max(d) OVER (PARTITION BY doc_id, p, w))
    SELECT doc_id, license_id, max(d) AS dice, count(*) AS n_segments FROM dice WHERE d >= {threshold} GROUP BY doc_id, license_id
    """
