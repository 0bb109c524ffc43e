"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, slices, text_values

# Short notices by which texts state their licence (SPDX identifier, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# The same for whole licence texts of a page or less, whole and as their grants alone.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC_GRANT = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_TERMS = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
BSD_NAMES = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES += [
    ("BSD-2-Clause", f"{BSD_TERMS} {BSD_AS_IS}"),
    ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAMES} {BSD_AS_IS}"),
    ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAMES}"),
    ("BSD-2-Clause", BSD_TERMS),
    ("ISC", f"{ISC_GRANT} {ISC_AS_IS}"),
    ("ISC", ISC_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_AS_IS}"),
    ("MIT", MIT_GRANT),
]

# The same for headers of files, and for passages by which the long texts are known.
TEMPLATES += [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions"),
    ("Apache-2.0", "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."),
]

# Words before a number that is a version, and the first word of a family's names.
BEFORE_VERSION = frozenset("version v by nc sa attribution noncommercial sharealike".split())
BEFORE_NAME = "gnu"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8  # of the Dice coefficient


WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W_]+")


def words(text: str) -> tuple[str, ...]:
    """Lower-cased runs of letters and digits; dots within numbers stay."""
    return tuple(WORD.findall(text.lower()))


def bigrams(w: tuple[str, ...] | list[str]) -> Counter:
    """The multiset of word pairs; a single word counts as one pair with nothing."""
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter([(w[0], "")] if w else [])


def required(pairs) -> frozenset:
    """The pairs that tell a licence from its relatives, and that a window has to hold: version numbers and the words after GNU."""
    return frozenset(p for p in pairs if p[0] == BEFORE_NAME or p[0] in BEFORE_VERSION and p[1][:1].isdigit())


def dice(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values())
    return 2 * both / total if total else 0.0


def disjoint(found: list[tuple]) -> list[tuple]:
    """Of (_, _, first pair, last pair, ...) in order of preference, those that share no word with an earlier one."""
    firsts, lasts, out = [], [], []
    for x in found:
        k = bisect_left(firsts, x[2])
        if (k == 0 or lasts[k - 1] + 1 < x[2]) and (k == len(firsts) or x[3] + 1 < firsts[k]):
            firsts.insert(k, x[2])
            lasts.insert(k, x[3])
            out.append(x)
    return out


class Scanner:
    """Templates with the places of their pairs.

    Dice >= t needs min / max >= t / (2 - t), as the smaller multiset bounds the
    intersection.  So a template is a candidate for a text only if the text holds the least number of its
    pairs within the greatest size of a window, and only there are windows scored.
    """

    def __init__(self, templates: list[tuple[str, str]], s: Settings):
        self.t = s.threshold
        self.items = sorted(((sum((b := bigrams(words(text))).values()), name, text, b) for name, text in templates), key=lambda x: x[:3])
        self.ratio = self.t / (2 - self.t)
        self.required = [required(x[3]) for x in self.items]
        self.openers = frozenset(g for x in self.items for g in x[3])
        self.holders: dict = {}
        for k, x in enumerate(self.items):
            for g in x[3]:
                self.holders.setdefault(g, []).append(k)
        self.least = math.ceil(min((x[0] for x in self.items), default=1) * self.ratio - 1e-9)

    def windows(self, k: int, at: list[int], pairs: list[tuple[str, str]]) -> list[tuple[int, float, int, int]]:
        """(shared pairs, score, first, last) of the best disjoint windows of word pairs for one template.

        ``at`` are the places of its pairs.  A pair at a window's edge that the template
        lacks only lowers the score, so windows begin and end at such places.  A window without
        the template's version or family name is none, however alike.  With n
        pairs in the template, t n / (2 - t) have to be shared, within n (2 - t) / t.
        """
        n, t, marks = self.items[k][0], self.items[k][3], self.required[k]
        need, most = max(1, math.ceil(n * self.ratio - 1e-9)), n / self.ratio + 1e-9
        found = []
        for i in range(len(at) - need + 1):
            if at[i + need - 1] - at[i] + 1 > most:
                continue
            left, both, best, lacking = dict(t), 0, None, set(marks)
            for j in range(i, len(at)):
                size = at[j] - at[i] + 1
                if size > most:
                    break
                if left[g := pairs[at[j]]]:
                    left[g] -= 1
                    both += 1
                    lacking.discard(g)
                    score = 2 * both / (n + size)
                    if not lacking and score >= self.t - 1e-12 and (best is None or score > best[1] + 1e-12):
                        best = (both, score, at[i], at[j])
            if best:
                found.append(best)
        return disjoint(sorted(found, key=lambda x: (-x[1], x[2])))

    def scan(self, text: str) -> list[tuple[int, str, float]]:
        """(line number of the first word, licence, score) of the windows of words that match, wherever they stand.

        Of windows that share a word the one with more word pairs of its template
        counts, then the one of the higher score.
        """
        low = text.lower()
        w = WORD.findall(low)
        hits = [i for i, g in enumerate(zip(w, w[1:])) if g in self.openers]
        if len(hits) < self.least:
            return []
        pairs = list(zip(w, w[1:]))
        at: dict[int, list[int]] = {}
        for i in hits:
            for k in self.holders[pairs[i]]:
                at.setdefault(k, []).append(i)
        found = [(*x, self.items[k][1]) for k, places in at.items() for x in self.windows(k, places, pairs)]
        if not found:
            return []
        chosen = sorted(disjoint(sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4]))), key=lambda x: x[2])
        starts = [m.start() for m in WORD.finditer(low)]
        return [(low.count("\n", 0, starts[a]), name, score) for _, score, a, _, name in chosen]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hits array<struct<line, license, score>>) of each row's whole text.

    Row-local; null and empty texts have no hits, and equal texts have equal ones, row by row.  Whole texts are
    scanned, however long; all columns but the id and the hits are dropped, whatever their names.  An empty table gives
    an empty result.  The templates are a parameter and travel with the function; they are few by nature.
    """

    def run(batches):
        scanner = Scanner(templates, settings)
        kind = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, 1):
                hits = [[{"line": a, "license": b, "score": c} for a, b, c in scanner.scan(t)] for t in text_values(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, kind)], ["id", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, hits array<struct<line:int,license:string,score:double>>").withColumnRenamed("id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["score"].alias("score"), (-h["line"]).alias("line"), h["license"].alias("license"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ";")
    return scan_licenses(documents(spark, sf_dir)).select("doc_id", F.size("hits").alias("n_hits"), names.alias("licenses"), F.round(best["score"], 6).alias("best_score"))
