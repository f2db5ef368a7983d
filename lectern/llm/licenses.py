"""Licence scans: Dice coefficient over word bigrams between units of a text and licence templates.

Units are the lines, sentences and paragraphs of a text, the whole of it, and all windows of as many words as a template
has, whatever line ends they span, so that a licence of several paragraphs or wrapped lines is found inside a longer text;
of windows that overlap on and on the best one counts. Texts are normalised to words of
letters and digits in lower case, and a unit is its set of word bigrams. A template is a candidate only if its
size allows the least Dice coefficient t: |B| between t/(2-t)|A| and (2-t)/t|A|; and a unit is looked at only if it has a
bigram of any template.

Defined results: null and empty texts, and units of one word, match nothing; of equal scores the licence whose name sorts
first is best; repeated rows are scanned each; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ALNUM, LOWER, NOT_SPACE, U, byte_set, mix, over_texts, word_hashes, words

LEAST = 0.8

# Fixed texts of licences and of the notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
)

NORMAL = np.where(ALNUM[LOWER], LOWER, 0x20).astype(np.uint8)
STOPS = byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
KINDS = ("line", "sentence", "paragraph", "text")


def bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])


@dataclass
class Index:
    """names: of templates; sizes: their distinct bigrams; keys: all bigrams, sorted; member: which templates have each; lengths: of templates in bigrams."""

    names: list[str]
    sizes: np.ndarray
    keys: np.ndarray
    member: np.ndarray
    lengths: np.ndarray


def index(templates=TEMPLATES) -> Index:
    sets, lengths = [], []
    for _, text in templates:
        data = NORMAL[np.frombuffer(text.encode(), np.uint8)]
        s, e, _first = words(data, np.array([0, len(data)]), ALNUM)
        sets.append(np.unique(bigrams(word_hashes(data, s, e))))
        lengths.append(len(s) - 1)
    keys = np.unique(np.concatenate(sets))
    return Index([n for n, _ in templates], np.array(list(map(len, sets))), keys, np.stack([np.isin(keys, x) for x in sets], axis=1), np.array(lengths))


def breaks(data: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind of unit, at each byte how many of its ends stand before."""
    n = len(data)
    after = np.append(data[1:], np.uint8(0x0A)) if n else data
    line = data == 0x0A
    found = {"line": line, "sentence": line | (STOPS[data] & ~NOT_SPACE[after]), "paragraph": line & (after == 0x0A), "text": np.zeros(n, bool)}
    return {k: np.concatenate([[0], np.cumsum(x)]) for k, x in found.items()}


def matches(data: np.ndarray, bounds: np.ndarray, ix: Index, least: float) -> list[tuple[int, int, str, float, int, int]]:
    """(row, template, kind, dice, first byte, end) of units and templates with a Dice coefficient of `least` or more."""
    flat = NORMAL[data]
    s, e, first = words(flat, bounds, ALNUM)
    if len(s) < 2:
        return []
    grams = bigrams(word_hashes(flat, s, e))
    at = np.minimum(np.searchsorted(ix.keys, grams), len(ix.keys) - 1)
    known = ix.keys[at] == grams
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    known &= row[1:] == row[:-1]
    if not known.any():
        return []
    out = []
    ends = breaks(data)
    for kind in KINDS:
        part = ends[kind][s]
        unit = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (row[1:] != row[:-1])]))
        inside = unit[1:] == unit[:-1]
        some = np.unique(unit[:-1][known & inside])
        begin, stop = np.searchsorted(unit, some), np.searchsorted(unit, some, side="right")
        for u, a, b in zip(some.tolist(), begin.tolist(), stop.tolist(), strict=True):
            # Size bounds first: a unit of b - a - 1 bigrams at most can't match templates that are larger than this allows.
            fit = ix.sizes <= (2 - least) / least * (b - a - 1)
            if not fit.any():
                continue
            hits = np.unique(at[a : b - 1][known[a : b - 1]])
            # Nor, with those distinct ones that are known and all the others distinct from them, smaller ones.
            own = len(np.unique(grams[a : b - 1])) if (b - a - 1) * least / (2 - least) > ix.sizes[fit].min() or len(hits) else 0
            fit &= (ix.sizes >= least / (2 - least) * own) & (ix.sizes <= (2 - least) / least * own)
            if not fit.any():
                continue
            both = ix.member[hits][:, fit].sum(axis=0)
            dice = 2 * both / (own + ix.sizes[fit])
            for t, d in zip(np.flatnonzero(fit)[dice >= least].tolist(), dice[dice >= least].tolist(), strict=True):
                out.append((int(row[a]), t, kind, d, int(s[a]), int(e[b - 1])))
    places = np.flatnonzero(known)
    for t, (size, length) in enumerate(zip(ix.sizes.tolist(), ix.lengths.tolist(), strict=True)):
        for a, d in windows(grams, at, places[ix.member[at[places], t]], row, size, length, least):
            out.append((int(row[a]), t, "window", d, int(s[a]), int(e[a + length])))
    return out


def windows(grams: np.ndarray, at: np.ndarray, hits: np.ndarray, row: np.ndarray, size: int, length: int, least: float) -> list[tuple[int, float]]:
    """(first word, dice) of windows of `length` bigrams with `least` or more, the best of each run of starts; hits: where the template's bigrams are."""
    need = least / (2 - least) * size  # so many bigrams in common at least, since a window has no fewer of its own
    if len(hits) < need or len(grams) < length:
        return []
    total = np.zeros(len(grams) + 1, np.int64)
    total[hits + 1] = 1
    np.cumsum(total, out=total)
    starts = np.flatnonzero((total[length:] - total[:-length] >= need) & (row[length:] == row[: len(row) - length]))
    mine = np.zeros(len(grams), bool)
    mine[hits] = True
    best: list[tuple[int, float]] = []
    last = -2
    for a in starts.tolist():
        own = len(np.unique(grams[a : a + length]))
        both = len(np.unique(at[a : a + length][mine[a : a + length]]))
        dice = 2 * both / (own + size)
        if dice >= least:
            if a != last + 1:
                best.append((a, dice))
            elif dice > best[-1][1]:
                best[-1] = (a, dice)
            last = a
    return best


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit and licence that match: doc_id, license, unit (its kind), dice, matched (its text)."""
    return found(docs, templates, least, id_col, text_col).select("doc_id", F.inline("found"))


def found(docs: DataFrame, templates, least: float, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    ix = index(templates)

    def fn(data, bounds):
        out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
        for r, t, kind, dice, a, b in matches(data, bounds, ix, least):
            out[r].append({"license": ix.names[t], "unit": kind, "dice": dice, "matched": data[a:b].tobytes().decode("utf-8", "replace")})
        return [out]

    return over_texts(rows, fn, "found array<struct<license: string, unit: string, dice: double, matched: string>>", ["doc_id"])


def report(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document: doc_id, n_licenses, licenses (names, sorted), best_license and best_dice (null and 0 without any)."""
    rows = found(docs, templates, least, id_col, text_col)
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    best = F.get(F.array_sort(F.transform("found", lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("n")))), F.lit(0))
    return rows.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), best["n"].alias("best_license"), F.coalesce(-best["d"], F.lit(0.0)).alias("best_dice"))


def _oracle(least: float = LEAST) -> str:
    """SQL for report(): units by joins of bigrams; windows where enough of a template's bigrams stand in a text."""
    quoted = lambda t: t.replace("'", "''")
    rows = ", ".join(f"({k}, '{name}', '{quoted(text)}')" for k, (name, text) in enumerate(TEMPLATES))
    split = lambda t: f"list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    grams = lambda w: f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    return f"""
WITH t0 AS (SELECT k, name, {split('text')} AS w FROM (VALUES {rows}) v(k, name, text)),
t AS (SELECT k, name, len(w) - 1 AS n, list_distinct({grams('w')}) AS b FROM t0),
tb AS (SELECT k, unnest(b) AS g FROM t),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
p AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS x FROM d
  UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(x, '([.!?])([\\x20\\x09-\\x0D])', '\\1' || chr(10) || '\\2', 'g'), chr(10))) FROM d
  UNION ALL SELECT doc_id, unnest(string_split(x, chr(10) || chr(10))) FROM d UNION ALL SELECT doc_id, x FROM d),
u AS (SELECT row_number() OVER () AS u, doc_id, {split('x')} AS w FROM p),
ub AS (SELECT u, doc_id, list_distinct({grams('w')}) AS b FROM u WHERE len(w) > 1),
c AS (SELECT u, k, count(*) AS n FROM (SELECT u, unnest(b) AS g FROM ub) JOIN tb USING (g) GROUP BY 1, 2),
m1 AS (SELECT doc_id, name, 2 * c.n / (len(ub.b) + len(t.b)) AS dice FROM c JOIN ub USING (u) JOIN t USING (k)),
dw AS (SELECT doc_id, {grams('w')} AS b FROM (SELECT doc_id, {split('x')} AS w FROM d)),
h AS (SELECT doc_id, k FROM (SELECT doc_id, unnest(b) AS g FROM dw) JOIN tb USING (g) JOIN t USING (k) GROUP BY doc_id, k, len(t.b) HAVING count(*) >= {least} / (2 - {least}) * len(t.b)),
s AS (SELECT doc_id, name, t.b AS tb, dw.b[i:i + t.n - 1] AS b FROM h JOIN dw USING (doc_id) JOIN t USING (k), LATERAL (SELECT unnest(range(1, len(dw.b) - t.n + 2)) AS i)),
m2 AS (SELECT doc_id, name, 2 * len(list_intersect(list_distinct(b), tb)) / (len(list_distinct(b)) + len(tb)) AS dice FROM s),
m AS (SELECT * FROM m1 WHERE dice >= {least} UNION ALL SELECT * FROM m2 WHERE dice >= {least}),
r AS (SELECT doc_id, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS top FROM m GROUP BY 1),
z AS (SELECT m.doc_id, min(name) AS best FROM m JOIN r ON r.doc_id = m.doc_id AND dice = top GROUP BY 1)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_licenses, coalesce(r.names, '') AS licenses, z.best AS best_license, coalesce(r.top, 0.0)::DOUBLE AS best_dice
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""


ORACLE = _oracle()
