"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages of a text are its lines, its paragraphs (lines up to one without a term, comment marks being none), runs of
neighbouring lines that could match (also over a gap, while the whole run could), and the whole text of a file named
like a licence. A passage could match if enough of its weight lies on terms of any template: the cosine is at most the
root of that share, so passages below ``COSINE`` are left out without loss. Templates are single notices, SPDX tags and
long forms; a match shares at least ``EVIDENCE`` terms with its template that aren't function words. A file's own
licence is its best passage at ``COSINE`` or more; in a file named like a licence the whole text decides at ``WHOLE`` or
more. A licence file is one that is named like one or of which at least half of the words lie in lines of licence
passages (a passage around a better one doesn't count); it speaks for its directory. A file without a licence of its
own inherits from the nearest ancestor directory that has a licence file: its ancestor paths are joined with those
directories and the deepest wins.

Null and empty texts have no passage but may inherit; null paths inherit nothing; null ids are passed on. Very long texts
are read line by line, and only lines that could match are joined to longer passages. Ties go to the higher score, then
the template first in order, then the least path. Repeated rows get equal results. Extra columns play no part. Empty
table: empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, mapped, only, staged

COSINE = 0.55
WHOLE = 0.8
FILE_SHARE = 0.5
LICENSE_NAMES = r"(?i)^(un)?(licen[sc]e|copying|notice|copyright)([._-].*)?$"
EVIDENCE = 2
#: Directories whose inherited licences are broadcast; beyond, files and directories are joined by a shuffle.
BROADCAST_DIRECTORIES = 100_000
#: English function words, which alone are no sign of a licence.
FUNCTION_WORDS = frozenset("a all an and any are as at be by for from has have if in is it its no not of on or other such than that the their these this to was which with without you".split())
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
)
_GNU = {f"{family}-{version}": tuple(f"{family}-{version}{end}" for end in ("", "-only", "-or-later")) for family, version in (("GPL", "3.0"), ("GPL", "2.0"), ("LGPL", "3.0"), ("AGPL", "3.0"))}
_SPDX = {k: (k,) for k in ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-4.0", "CC0-1.0", "Unlicense", "ISC", "Zlib")} | _GNU
#: Short notices of public licences, by their public identifiers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", _MIT[0]),
    ("MIT", _MIT[1]),
    ("MIT", " ".join(_MIT)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", " ".join((_BSD[0], _BSD[1], _BSD[2], _BSD[3]))),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", " ".join((_BSD[0], _BSD[1], _BSD[3]))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("ISC", _ISC[0]),
    ("ISC", " ".join(_ISC)),
    ("Zlib", _ZLIB[1]),
    ("Zlib", " ".join(_ZLIB)),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tags in _SPDX.items() for tag in tags),
)


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(rows (template, license, term, unit weight x idf), idf of known terms, idf of unknown terms)."""
    counts = [Counter(_terms(text)) for _, text in templates]
    spread = Counter(term for c in counts for term in c)
    n = len(templates)
    idf = {term: math.log((1 + n) / (1 + df)) + 1 for term, df in spread.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        norm = math.sqrt(sum((tf * idf[t]) ** 2 for t, tf in c.items()))
        rows += [(k, name, t, tf * idf[t] / norm * idf[t]) for t, tf in sorted(c.items())]
    return rows, idf, math.log(1 + n) + 1


class _Matcher:
    """Scores bags of terms against all templates, and bounds their cosine from the terms known to any template."""

    def __init__(self, templates, least: float) -> None:
        rows, self.idf, self.unknown = template_weights(templates)
        self.names = [name for name, _ in templates]
        self.least = least
        self.evidence = [min(EVIDENCE, len(set(_terms(text)) - FUNCTION_WORDS)) for _, text in templates]
        self.weights: dict[str, list[tuple[int, float]]] = {}
        for k, _, term, weight in rows:
            self.weights.setdefault(term, []).append((k, weight))

    def could(self, known: list[str], n_unknown: int) -> bool:
        """False only if the cosine is below the least one: unknown terms weigh at least their number."""
        if not known:
            return False
        mass = sum((tf * self.idf[t]) ** 2 for t, tf in Counter(known).items())
        return mass * (1 + 1e-9) >= self.least**2 * (mass + n_unknown * self.unknown**2)

    def best(self, terms: list[str]) -> tuple[float, int] | None:
        """(score, template): the best template with evidence, the first of equal ones."""
        square, dots, signs = 0.0, {}, Counter()
        for term, tf in Counter(terms).items():
            square += (tf * self.idf.get(term, self.unknown)) ** 2
            sign = term not in FUNCTION_WORDS
            for k, weight in self.weights.get(term, ()):
                dots[k] = dots.get(k, 0.0) + tf * weight
                signs[k] += sign
        scores = {k: round(dot / math.sqrt(square), 6) for k, dot in dots.items() if signs[k] >= self.evidence[k]}
        if not scores:
            return None
        k = max(scores, key=lambda k: (scores[k], -k))
        return scores[k], k

    def passages(self, lines: list[list[str]], whole: bool):
        """(first, end) of the stretches of lines that could match."""
        known = [[t for t in line if t in self.idf] for line in lines]
        others = [len(line) - len(k) for line, k in zip(lines, known, strict=True)]

        def together(first: int, end: int) -> bool:
            return self.could([t for k in known[first:end] for t in k], sum(others[first:end]))

        found = {}
        alone = [self.could(k, n) for k, n in zip(known, others, strict=True)]
        at = 0
        while at < len(lines):
            if not lines[at]:
                at += 1
                continue
            end = at
            while end < len(lines) and lines[end]:
                end += 1
            if end - at > 1 and any(known[at:end]) and together(at, end):
                found[at, end] = True
            runs, k = [], at
            while k < end:
                if alone[k]:
                    first = k
                    while k < end and alone[k]:
                        found[k, k + 1] = True
                        k += 1
                    found[first, k] = True
                    if runs and together(runs[-1], k):
                        found[runs[-1], k] = True
                    else:
                        runs.append(first)
                else:
                    k += 1
            at = end
        if whole and any(known) and together(0, len(lines)):
            found[0, len(lines)] = True
        return list(found)

    def judged(self, text: str | None, named: bool) -> tuple[str | None, float | None, int, int]:
        """(license, score, words in lines of licence passages, words) of a text."""
        if not text:
            return None, None, 0, 0
        raw = text.split("\n")
        lines = [_terms(line) for line in raw]
        best, found = None, []
        for first, end in self.passages(lines, named):
            match = self.best([t for line in lines[first:end] for t in line])
            if match and match[0] >= self.least:
                found.append((-match[0], end - first, first, end))
                rank = (named and (first, end) == (0, len(lines)) and match[0] >= WHOLE, match[0], -match[1])
                best = rank if best is None else max(best, rank)
        taken, covered = [], set()
        for _, _, first, end in sorted(found):  # lines around a better passage aren't the notice
            if not any(first <= f and e <= end for f, e in taken):
                taken.append((first, end))
                covered.update(range(first, end))
        n_words = len(text.split())
        if best is None:
            return None, None, 0, n_words
        return self.names[-best[2]], best[1], sum(len(raw[k].split()) for k in covered), n_words


@lru_cache(maxsize=4)
def _matcher(templates, least: float) -> _Matcher:
    return _Matcher(templates, least)


def scored(distinct: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(passage, license, template, score): the best template with evidence of each distinct passage, whatever its score."""

    def run(batches):
        matcher = _matcher(templates, 0.0)
        for batch in batches:
            found = [(p, m) for p in batch.column("passage").to_pylist() if p and (m := matcher.best(_terms(p)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), pa.array([matcher.names[m[1]] for _, m in found], pa.string()), pa.array([m[1] for _, m in found], pa.int32()), pa.array([m[0] for _, m in found], pa.float64())],
                names=["passage", "license", "template", "score"],
            )

    return mapped(distinct.select("passage"), run, "passage string, license string, template int, score double")


def own_licenses(files: DataFrame, cosine: float = COSINE, templates=TEMPLATES) -> DataFrame:
    """(file, path, license, score, notice_words, n_words) per row, in one pass over the texts."""

    def run(batches):
        matcher = _matcher(templates, cosine)
        for batch in batches:
            names = [bool(p) and re.match(LICENSE_NAMES, p.rsplit("/", 1)[-1]) is not None for p in batch.column("path").to_pylist()]
            found = [matcher.judged(t.as_py(), named) for t, named in zip(batch.column("text"), names, strict=True)]
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("path"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["file", "path", "license", "score", "notice_words", "n_words"]
            )

    kind = files.schema["file"].dataType.simpleString()
    return mapped(files, run, f"file {kind}, path string, license string, score double, notice_words long, n_words long")


def ancestors(directory: Column) -> Column:
    """(dir, depth) of a directory and all above it, the root being the empty path."""

    def of(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir"), d.alias("depth")))

    return let(F.split(directory, "/"), of)


def nearest_licenses(own: DataFrame) -> DataFrame:
    """(of, inherited, inherited_from) for the directories of files without a licence that have one above them. Each
    directory is looked up once, however many files it holds."""
    speaking = own.where("is_license_file and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("first"), "path", "license")).alias("s"))
    bare = own.where("license is null and path is not null").select(F.col("dir").alias("of")).distinct().select("of", F.explode(ancestors(F.col("of"))).alias("a"))
    nearest = bare.select("of", "a.dir", "a.depth").join(speaking, "dir").groupBy("of").agg(F.max_by("s", "depth").alias("s"))
    return nearest.select("of", F.col("s.license").alias("inherited"), F.col("s.path").alias("inherited_from"))


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """(file, path, license, score, is_license_file, inherited, inherited_from, effective) per row."""
    files = only(df, file=id_col, path=path_col, text=text_col)
    own = own_licenses(files, cosine)
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.col("license").isNotNull() & (F.coalesce(name.rlike(LICENSE_NAMES), F.lit(False)) | (F.col("notice_words") >= FILE_SHARE * F.col("n_words")))
    parent = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    own = staged(own.select("file", "path", parent.alias("dir"), "license", "score", is_file.alias("is_license_file")), "own-licenses")
    nearest = staged(nearest_licenses(own), "nearest-licenses")
    nearest = F.broadcast(nearest) if nearest.count() <= BROADCAST_DIRECTORIES else nearest
    return own.join(nearest, F.col("dir") == F.col("of"), "left").select(
        "file",
        "path",
        "license",
        "score",
        "is_license_file",
        F.when(F.col("license").isNull(), F.col("inherited")).alias("inherited"),
        F.when(F.col("license").isNull(), F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("license", F.col("inherited")).alias("effective"),
    )
