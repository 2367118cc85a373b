"""Licence scan: TF-IDF cosine of sentences, paragraphs, leading comments and whole
files to licence templates (notices, standard headers, short texts in full), then inheritance from the nearest ancestor directory.

Words are hashed to 2^18 terms; document frequencies are counted over all
files (one partial count array per task, summed by term).  Every sentence, every
paragraph with its lines folded, the leading comment and the whole of every text is
compared: a bound on its cosine from the weights it shares with a
template (Cauchy-Schwarz) leaves few, whose cosine is computed exactly.  A file
whose best licence passage makes up ``FILE_SHARE`` of its words, or that has the name of a
licence file, is the licence file of its directory.  Files without a licence of
their own take that of the nearest directory above them, by joins on the
directory path.

Defined results.  Null or empty texts have no licence of their own.  Equal
cosines go to the template first by name, then the earliest passage.  ``licenses`` has
each licence of a file with its best passage, by place; of passages that overlap with
different licences the one of greater cosine counts.  Of several
licence files in a directory the smallest path counts.  A null path has no
directory and inherits nothing.  Repeated rows give repeated rows, an empty table an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.tables import written
from cohortline.llm.textnum import Words, blocks, codepoints

TERM_BITS = 18
MIN_COSINE = 0.6
FILE_SHARE = 0.2
LEADING_COMMENT = re.compile(r"""(?:/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|(?:[ \t]*(?:\#|//|--|;|%)[^\n]*(?:\n|\Z)|[ \t]*\n)+)""", re.S)
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$"

# fixed values: short notices of common public licences
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Use of this source code is governed by a BSD 2-clause license."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License version 3."],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


# standard headers, and texts in full where they are short
_WARRANTY = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details.")
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {}BE LIABLE FOR ANY "
          "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
          "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. {}"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(name: str, version: str, what: str = "This program") -> list[str]:
    """The header's first paragraph, and the header."""
    first = (f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
             f"Foundation, either version {version} of the License, or (at your option) any later version.")
    return [first, f"{first} {_WARRANTY.format(name)} You should have received a copy of the GNU {name} along with this program. "
                   "If not, see <https://www.gnu.org/licenses/>."]


_APACHE = ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
           "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
HEADERS = {
    "Apache-2.0": [_APACHE, _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
                   "language governing permissions and limitations under the License.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD-2-Clause": [_BSD.format("")],
    "BSD-3-Clause": [_BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                                 "derived from this software without specific prior written permission. ")],
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies. "
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
            "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
            "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "This library"),
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. " + _AS_IS.format("OR COPYRIGHT HOLDERS ")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
                  "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
                  "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs "
                  "and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
                  "software under copyright law. " + _AS_IS.format("")],
}
TEMPLATES = {name: TEMPLATES[name] + HEADERS.get(name, []) for name in TEMPLATES}


def _terms(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def sentences(texts: list[str], words: Words) -> np.ndarray:
    """The number of the sentence of each word: a sentence ends at a line's end or after
    ``.``, ``!`` or ``?`` before white space."""
    cp, _ = codepoints([t.lower() for t in texts])
    end = (cp == 10) | (cp == 0)
    stop = (cp == 46) | (cp == 33) | (cp == 63)
    after = np.append(cp[1:], np.uint32(0))
    end |= stop & ((after == 32) | (after == 10) | (after == 0) | (after == 9))
    return np.cumsum(end)[words.begin]


def passages(texts: list[str], words: Words, starts: np.ndarray) -> np.ndarray:
    """Word ranges, each once: sentences, paragraphs (up to a line without words), leading
    comments and whole texts."""
    n = len(words.hash)
    lines = np.cumsum(codepoints([t.lower() for t in texts])[0] == 10)
    new_text = words.doc[1:] != words.doc[:-1]
    number = sentences(texts, words)
    out = []
    for cut in (number[1:] != number[:-1], lines[words.begin[1:]] - lines[words.end[:-1] - 1] > 1, False):
        edge = np.concatenate(([0], np.flatnonzero(cut | new_text) + 1, [n]))
        out.append(np.stack([edge[:-1], edge[1:]], axis=1))
    for d in np.flatnonzero(words.count):
        low = texts[d].lower()
        m = LEADING_COMMENT.match(low, len(low) - len(low.lstrip()))
        end = np.searchsorted(words.begin, starts[d] + m.end()) if m else 0
        if end > words.first[d]:
            out.append(np.array([[words.first[d], end]]))
    return np.unique(np.concatenate(out), axis=0)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of the texts that have each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << TERM_BITS, np.int64)
        n = 0
        for b in batches:
            all_texts = b.column("text").to_pylist()
            n += len(all_texts)
            for lo, hi in blocks(all_texts):
                w = Words(all_texts[lo:hi])
                pairs = np.unique((w.doc << TERM_BITS) | _terms(w))
                df += np.bincount(pairs & ((1 << TERM_BITS) - 1), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "n"])

    rows = texts.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out, n = np.zeros(1 << TERM_BITS, np.int64), 0
    for r in rows.collect():                       # at most 2^18 terms, whatever the input
        if r["term"] < 0:
            n = r["n"]
        else:
            out[r["term"]] = r["n"]
    return n, out


class Scanner:
    def __init__(self, n: int, df: np.ndarray, templates: dict[str, list[str]] = TEMPLATES):
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.names, self.vectors = [], []
        for name in sorted(templates):
            for notice in templates[name]:
                self.names.append(name)
                self.vectors.append(self.vector(_terms(Words([notice]))))
        known = np.unique(np.concatenate([t for t, _ in self.vectors]))
        self.slot = np.full(1 << TERM_BITS, -1, np.int32)
        self.slot[known] = np.arange(len(known))
        self.square = np.zeros((len(self.vectors), len(known)))
        self.dense = np.zeros((len(self.vectors), len(known)))
        for k, (t, v) in enumerate(self.vectors):
            self.dense[k, self.slot[t]] = v
            self.square[k, self.slot[t]] = v * v

    def vector(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms and their weights, of length one."""
        t, c = np.unique(terms, return_counts=True)
        v = (1 + np.log(c)) * self.idf[t]
        return t, v / max(1e-12, np.sqrt((v * v).sum()))

    def scan(self, texts: list[str], least: float = MIN_COSINE) -> list[list[tuple]]:
        """Each text's licences, the best first: ``(name, cosine, start, end, share of the
        text's words)`` of its best passage, offsets in the lower-cased text."""
        out: list[list[tuple]] = [[] for _ in texts]
        for lo, hi in blocks(texts):
            part = texts[lo:hi]
            w = Words(part)
            if not len(w.hash):
                continue
            terms = _terms(w)
            slot = self.slot[terms]
            hit = np.flatnonzero(slot >= 0)
            if not len(hit):
                continue
            starts = codepoints([t.lower() for t in part])[1]
            spans = passages(part, w, starts)
            a, b = np.searchsorted(hit, spans[:, 0]), np.searchsorted(hit, spans[:, 1])
            bound = np.zeros(len(spans))
            for k in range(len(self.vectors)):
                total = np.concatenate(([0.0], np.cumsum(self.square[k, slot[hit]])))
                np.maximum(bound, total[b] - total[a], out=bound)
            found: dict[int, list] = {}
            for a, b in spans[bound >= least * least - 1e-9].tolist():
                t, v = self.vector(terms[a:b])
                known = self.slot[t] >= 0
                cos = self.dense[:, self.slot[t[known]]] @ v[known]
                best = float(cos.max())
                if best >= least:
                    k = int(np.flatnonzero(cos >= best - 1e-12)[0])
                    found.setdefault(int(w.doc[a]), []).append((-round(best, 6), a, b, self.names[k]))
            for d, rows in found.items():
                taken: list[tuple] = []
                names = set()
                for cos, a, b, name in sorted(rows):
                    if all(name == n or b <= x or a >= y for n, x, y in taken):
                        taken.append((name, a, b))
                        if name not in names:
                            names.add(name)
                            out[lo + d].append((name, -cos, int(w.begin[a] - starts[d]), int(w.end[b - 1] - starts[d]),
                                                (b - a) / int(w.count[d])))
        return out


_DDL = "doc_id bigint, path string, own string, cosine double, start bigint, end bigint, share double, " \
       "licenses array<struct<license: string, cosine: double, start: bigint, end: bigint>>"


def own_licenses(files: DataFrame, scanner: Scanner) -> DataFrame:
    """``doc_id, path, own, cosine, start, end, share`` (the best) and ``licenses`` of every file."""
    shared = files.sparkSession.sparkContext.broadcast(scanner)      # fixed by TERM_BITS and the templates

    kind = pa.list_(pa.struct([("license", pa.string()), ("cosine", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            every = s.scan(b.column("text").to_pylist())
            cols = list(zip(*(x[0] if x else (None,) * 5 for x in every))) if every else [[]] * 5
            own = [[dict(zip(("license", "cosine", "start", "end"), x)) for x in sorted(rows, key=lambda x: x[2])] for rows in every]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("path")] + [pa.array(c, t) for c, t in zip(
                    cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))] + [pa.array(own, kind)],
                names=["doc_id", "path", "own", "cosine", "start", "end", "share", "licenses"])

    return files.mapInArrow(run, _DDL)


def parent_dir(path: F.Column) -> F.Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherit(scanned: DataFrame) -> DataFrame:
    """Add ``license, origin, from_dir``: own licences stay, other files take that of
    the nearest directory on their path that has a licence file."""
    files = scanned.withColumn("dir", parent_dir(F.col("path")))
    is_file = F.col("own").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("share") >= FILE_SHARE))
    files = files.withColumn("license_file", F.coalesce(is_file, F.lit(False)))
    licensed = (files.where("license_file AND dir IS NOT NULL").groupBy("dir")
                .agg(F.min_by("own", "path").alias("dir_license"))
                .select(F.col("dir").alias("above"), "dir_license"))
    # each directory once, with all directories above it; depth 0 is the top
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)),
                        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))
    nearest = (files.where("dir IS NOT NULL").select("dir").distinct()
               .select("dir", F.inline(above)).dropDuplicates(["dir", "above"])
               .join(licensed, "above")
               .groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), "depth").alias("near"))
               .select("dir", F.col("near.above").alias("near_dir"), F.col("near.dir_license").alias("near_license")))
    own = F.col("own").isNotNull()
    return (files.join(nearest, "dir", "left")
            .select("doc_id", "path", "own", "cosine", "start", "end", "license_file", "licenses",
                    F.coalesce("own", "near_license").alias("license"),
                    F.when(own, "own").when(F.col("near_license").isNotNull(), "inherited").alias("origin"),
                    F.when(~own, F.col("near_dir")).alias("from_dir")))


def license_scan(docs: DataFrame, path: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    files = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), path.cast("string").alias("path"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scanner = Scanner(*document_frequencies(files))
    return inherit(written(own_licenses(files, scanner), "licenses"))     # read three times below
