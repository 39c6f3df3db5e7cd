"""Licence scan: normalised text against licence templates by the Dice
coefficient over word bigrams.

Candidates are the runs of words of a text, wherever its lines break, that begin
and end with a bigram of the template (one that doesn't only lowers Dice at an
end). A template compares only with runs whose number of bigrams allows the
threshold: Dice 2c/(a+b) with c <= min(a, b) reaches t only for a between
b*t/(2-t) and b*(2-t)/t. Before that, a template drops out for a whole text that
shares fewer of its bigrams than the smallest such run needs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {more}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: (licence, template): whole licences, and the notices by which a work names one.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", _BSD.format(more="")),
    ("BSD-3-Clause", _BSD.format(more="Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("Apache-2.0", _APACHE), ("GPL-3.0", _GPL.format(kind="")), ("LGPL-3.0", _GPL.format(kind="Lesser ")), ("AGPL-3.0", _GPL.format(kind="Affero ")),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    *[(f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("0BSD", _ZERO), ("BSL-1.0", _BOOST),
    ("All-Rights-Reserved", "All rights reserved."),
]


def normalised(text: str | None) -> list[str]:
    """Lower-case words; punctuation, white space and quotation marks drop out,
    and British spelling of the noun is folded."""
    return ["license" if w == "licence" else "licensed" if w == "licenced" else w for w in _WORD.findall((text or "").lower())]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 0.0


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.templates = [(name, b, sum(b.values())) for name, b in ((n, bigrams(normalised(t))) for n, t in templates) if b]
        self.bounds = [(n * threshold / (2 - threshold), n * (2 - threshold) / threshold) for _, _, n in self.templates]
        self.of: dict[tuple[str, str], list[int]] = {}
        for k, (_, b, _) in enumerate(self.templates):
            for g in b:
                self.of.setdefault(g, []).append(k)
        self.firsts = {g[0] for g in self.of}

    def runs(self, words: list[str], k: int) -> Iterator[tuple[float, int, int]]:
        """(Dice, first word, last word) of every run that reaches the threshold
        with template k and begins and ends with one of its bigrams."""
        _, template, size = self.templates[k]
        low, high = self.bounds[k]
        shared = [(i, g) for i, g in enumerate(zip(words, words[1:])) if g in template]
        for at, (a, _) in enumerate(shared):
            common_, seen = 0, Counter()
            for b, g in shared[at:]:
                n = b - a + 1
                if n > high + 1e-9:
                    break
                seen[g] += 1
                common_ += seen[g] <= template[g]
                if n >= low - 1e-9 and 2 * common_ >= (self.threshold - 1e-9) * (n + size):
                    yield 2 * common_ / (n + size), a, b + 1

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first line, lines) of every find, in their order."""
        words = normalised(text)
        if self.firsts.isdisjoint(words):
            return []
        shared = Counter(k for g in set(zip(words, words[1:])) & self.of.keys() for k in self.of[g])
        # The shortest run that may match has `low` bigrams, and 2c >= t(a+b) then asks for this many.
        live = [k for k, n in shared.items() if n >= min(len(self.templates[k][1]), 1) and n * max(self.templates[k][1].values()) >= self.threshold * (self.bounds[k][0] + self.templates[k][2]) / 2 - 1e-9]
        out: list[tuple[int, str, float, int, int]] = []
        if not live:
            return []
        lines = [(i, normalised(line)) for i, line in enumerate((text or "").split("\n"))]
        words, line_of = [w for _, ws in lines for w in ws], [i for i, ws in lines for _ in ws]
        # Of runs that overlap, the closest one holds, then the first, then the shortest.
        taken = bytearray(len(words))
        found = [(-d, a, b, self.templates[k][0]) for k in live for d, a, b in self.runs(words, k)]
        for d, a, b, name in sorted(found):
            if taken.find(1, a, b + 1) < 0:
                taken[a : b + 1] = b"\1" * (b + 1 - a)
                out.append((a, name, -d, line_of[a], line_of[b] - line_of[a] + 1))
        return [x[1:] for x in sorted(out)]


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, first_line, n_lines: a row for each place of a whole
    text, however long, that is a licence. Of runs that overlap the closest holds;
    of equally close ones the first, then the shortest, then the least name.

    Null and empty texts have none; repeated rows are answered once each, a null
    doc_id too; an empty table gives no rows. Other columns are not read,
    whatever their names."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = [(d, *got) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for got in scanner.scan(t)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "license", "dice", "first_line", "n_lines"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, license string, dice double, first_line int, n_lines int")
