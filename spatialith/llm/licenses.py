"""Licence scans: TF-IDF cosine of headers and licence files to templates, and inheritance from ancestor directories.

A text's units are its sentences (cut at line breaks and after . ! ? before white space) and paragraphs (cut at blank
lines).  A unit is a bag of terms, runs of ASCII letters and digits in lower case, weighted by frequency times inverse
document frequency.  Document frequencies of all terms are counted over all documents.  A unit is a header of the
template with the greatest cosine if that is at least ``HEADER_COSINE``.  A whole text that reaches ``FILE_COSINE`` with a
header template or a licence's full text, or a file with a licence file's name whose best header qualifies, is a licence
file and stands for its directory.

Few units are compared: each template's heaviest terms are its anchors, enough of them that a unit without any can't
reach the least cosine.  Only units with an anchor are looked at, which loses nothing.  Frequencies of template terms and
of the ``SENT_TERMS`` most frequent terms are sent to all tasks; any other term is rarer than those, which bounds the
cosine from above.  Texts with a unit that could still qualify are kept with its other terms, those terms meet their
frequencies by a shuffle, once a text, and the cosines of these texts are then computed exactly.

A document without a header takes the licence of the nearest ancestor directory that has a licence file.  Distinct
directories, not documents, are expanded into ancestors and joined; a directory of any size is one row there.

Edge cases: null and empty texts have no units and can only inherit.  A null path is no directory's.  Of several
licence files in one directory the greatest cosine wins, then the first name.  Rows that repeat an identifier are
scanned one by one.  An empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as B
from .counts import most_frequent
from .store import Scratch, table

HEADER_COSINE = 0.6
FILE_COSINE = 0.8
#: Terms whose document frequencies are sent to all tasks, but for a few thousand at ties: 16 bytes each.
SENT_TERMS = 1 << 18
#: Documents with possible headers that one task compares.
DOCS_A_TASK = 512
#: Distinct terms that a counting task holds before it hands on what it has.
HELD_TERMS = 1_000_000
#: Fixed texts: licence, and the statements and notices that declare it.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later "
        "version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Licensed under the ISC License."),
    ("Proprietary", "Copyright. All rights reserved."),
]
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NO_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_HOLDERS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Fixed texts: whole licences, compared with whole documents.
FULL_TEXTS = [
    (
        "MIT",
        "MIT License Copyright (c) " + _GRANT + " The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", "BSD 2-Clause License Copyright (c) All rights reserved. " + _REDISTRIBUTION + " " + _HOLDERS),
    ("BSD-3-Clause", "BSD 3-Clause License Copyright (c) All rights reserved. " + _REDISTRIBUTION + " " + _NO_ENDORSEMENT + " " + _HOLDERS),
    (
        "ISC",
        "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
]
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
TERM = re.compile("[a-z0-9]+")
_CUT = re.compile(r"[\n\r]+|(?<=[.!?])[ \t]+")
_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.translate(_LOWER)))


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences and paragraphs, sorted, without repeats."""
    found = set()
    for cut in (_CUT, _BLANK):
        at = 0
        for m in cut.finditer(text):
            found.add((at, m.start()))
            at = m.end()
        found.add((at, len(text)))
    return sorted((a, b) for a, b in found if a < b)


def vocabulary(templates=TEMPLATES, full=FULL_TEXTS) -> list[str]:
    return sorted({t for _, text in [*templates, *full] for t in terms(text)})


def _hashes(words: list[str]) -> np.ndarray:
    flat, offsets = B.codes(words)
    return B.span_hashes(flat, offsets[:-1], offsets[1:])


class Frequencies:
    """Document frequencies that all tasks know, and the greatest that any other term can have."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n_docs: int, most: int):
        order = np.argsort(hashes)
        self.hashes, self.df, self.n_docs, self.most = hashes[order], df[order], n_docs, most

    def idf(self, df):
        return np.log((1 + self.n_docs) / (1 + np.asarray(df, float))) + 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's weight by its frequency, the least that it can have where it isn't known; and where it is."""
        if not len(self.hashes):
            return self.idf(np.full(len(hashes), self.most)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return self.idf(np.where(known, self.df[at], self.most)), known


class Templates:
    """Template vectors under the corpus's document frequencies; ``full`` ones are for whole texts alone."""

    def __init__(self, freq: Frequencies, templates=TEMPLATES, full=FULL_TEXTS, least=HEADER_COSINE, file_least=FILE_COSINE):
        self.freq = freq
        self.names = [n for n, _ in [*templates, *full]]
        self.n_short = len(templates)
        self.vectors: list[dict[str, float]] = []
        self.anchors: set[str] = set()
        for k, (_, text) in enumerate([*templates, *full]):
            count = terms(text)
            idf, _ = freq.find(_hashes(list(count)))
            v = {t: c * w for (t, c), w in zip(count.items(), idf.tolist(), strict=True)}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {t: x / norm for t, x in v.items()}
            self.vectors.append(v)
            left, need = 1.0, least if k < self.n_short else file_least  # squared cosine that the other terms can give
            for t in sorted(v, key=lambda t: (-v[t], t)):
                if left < need * need * 0.999:
                    break
                self.anchors.add(t)
                left -= v[t] ** 2

    def best(self, text: str, whole: bool = False, extra: dict[int, int] | None = None) -> tuple[float, str, np.ndarray]:
        """Greatest cosine, its licence (the first template wins ties), and hashes of terms whose frequency isn't known.

        ``extra``: frequencies of such terms; without them the cosine is the greatest that it can be.
        """
        count = terms(text)
        hashes = _hashes(list(count))
        idf, known = self.freq.find(hashes)
        for i in np.flatnonzero(~known) if extra else ():
            idf[i] = self.freq.idf(extra[int(hashes[i].view(np.int64))])
        bag = {t: c * w for (t, c), w in zip(count.items(), idf.tolist(), strict=True)}
        norm = math.sqrt(sum(x * x for x in bag.values())) or 1.0
        use = self.vectors if whole else self.vectors[: self.n_short]
        scores = [sum(x * bag[t] for t, x in v.items() if t in bag) / norm for v in use]
        top = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return scores[top], self.names[top], hashes[~known].view(np.int64)


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position within the text, and hash of every term."""
    flat, offsets = B.codes(texts)
    flat = B.lower_ascii(flat)
    inside = ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57))
    spaced = np.where(inside, flat, np.uint32(32))
    starts, ends, at = B.words(spaced, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    return owner, starts - offsets[owner], B.span_hashes(spaced, starts, ends)


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(place, np.concatenate([c for _, c in held]), len(words)).astype(np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["w", "df"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in B.chunks(texts):
            owner, _, hashes = _terms(texts[a:b])
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            new = np.concatenate([[True] * bool(len(hashes)), (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]).astype(bool)
            held.append(np.unique(hashes[new], return_counts=True))
            if sum(len(w) for w, _ in held[1:]) > HELD_TERMS / 2:
                held = [merged()]
                if len(held[0][0]) > HELD_TERMS:
                    yield out()
                    held = []
    if held:
        held = [merged()]
        yield out()


def document_frequencies(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """(w, df): in how many documents each term (by hash) occurs."""
    counted = docs.select(text_col).mapInArrow(_count_documents, "w long, df long")
    return scratch.keep(counted.groupBy("w").agg(F.sum("df").alias("df")), "frequencies")


def sent_frequencies(counts: DataFrame, n_docs: int, n_sent: int = SENT_TERMS) -> tuple[Frequencies, Column]:
    """What all tasks know, and the condition for a term to be among it."""
    template = [int(x) for x in _hashes(vocabulary()).view(np.int64)]
    is_sent = most_frequent(counts, "df", n_sent) | F.col("w").isin(template)
    sent = counts.filter(is_sent).toPandas()
    most = counts.filter(~is_sent).agg(F.max("df")).first()[0] or 0
    known = dict.fromkeys(template, 0) | dict(zip(sent.w.tolist(), sent.df.tolist(), strict=True))
    hashes = np.fromiter(known, np.int64, len(known)).view(np.uint64)
    return Frequencies(hashes, np.fromiter(known.values(), np.int64, len(known)), n_docs, most), is_sent


LOOKED = "id {}, path string, text string, rare array<long>"
SCANNED = "id {}, path string, license string, score double, spans string, n_headers long, file_license string, file_score double"


def _anchored(texts: list[str | None], own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Texts with anchors (sorted hashes ``own``), and where those start."""
    for a, b in B.chunks(texts):
        owner, at, hashes = _terms(texts[a:b])
        place = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        hit = np.flatnonzero(own[place] == hashes)
        owner, at = owner[hit], at[hit]
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            yield a + int(i), at[cuts[i] : cuts[i + 1]]


def _look(model: Templates, least: float, file_least: float):
    """Keeps the text of documents in which a unit or the whole could qualify, with the terms to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.sort(_hashes(sorted(model.anchors)))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            kept: list[str | None] = [None] * len(texts)
            rare: list[list[int]] = [[] for _ in texts]
            for i, at in _anchored(texts, own):
                found = [model.best(texts[i], whole=True)]
                found = [f for f in found if f[0] >= file_least]
                for x, y in units(texts[i]):
                    if np.searchsorted(at, x) < np.searchsorted(at, y):  # an anchor starts inside
                        one = model.best(texts[i][x:y])
                        if one[0] >= least:
                            found.append(one)
                if found:
                    kept[i], rare[i] = texts[i], np.unique(np.concatenate([f[2] for f in found])).tolist()
            columns = [pa.array(kept, pa.string()), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "path", "text", "rare"])

    return run


def _scan(model: Templates, least: float, file_least: float):
    """Headers and licence files among documents that were kept; all their terms' frequencies are known or given."""
    named = re.compile(FILE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.sort(_hashes(sorted(model.anchors)))
        for batch in batches:
            texts, paths, given = (batch.column(k).to_pylist() for k in (2, 1, 3))
            rows: list[tuple] = [(None, 0.0, "", 0, None, 0.0)] * len(texts)
            for i, at in _anchored(texts, own):
                rows[i] = _document(texts[i], paths[i], at, {g["w"]: g["df"] for g in given[i] or ()})
            types = [pa.string(), pa.float64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
            if rows:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = [c.split()[0] for c in SCANNED.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    def exact(text: str, extra: dict[int, int], limit: float, whole: bool = False) -> tuple[float, str]:
        score, name, rare = model.best(text, whole)
        if score >= limit and len(rare):  # it could qualify, so its terms were looked up
            score, name, _ = model.best(text, whole, extra)
        return score, name

    def _document(text: str, path: str | None, at: np.ndarray, extra: dict[int, int]) -> tuple:
        found = []
        for x, y in units(text):
            if np.searchsorted(at, x) < np.searchsorted(at, y):
                score, name = exact(text[x:y], extra, least)
                if score >= least:
                    found.append((score, name, x, y))
        # of units that overlap the one with the greater cosine counts; kept ones don't overlap, so neighbours tell
        kept: list[tuple] = []
        for score, name, x, y in sorted(found, key=lambda s: (-s[0], s[2], -s[3])):
            k = bisect_left(kept, (x,))
            if (k == 0 or kept[k - 1][1] <= x) and (k == len(kept) or y <= kept[k][0]):
                insort(kept, (x, y, score, name))
        whole, whole_name = exact(text, extra, file_least, True)
        top = max(kept, key=lambda s: (s[2], -s[0]), default=None)
        file_name = file_score = None
        if whole >= file_least:
            file_name, file_score = whole_name, whole
        elif top and path and named.search(path):
            file_name, file_score = top[3], top[2]
        spans = ",".join(f"{n}:{x}:{y}" for x, y, _, n in kept)
        return (top and top[3], top[2] if top else 0.0, spans, len(kept), file_name, file_score or 0.0)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """One row per document: id, license, method (header, inherited or null), score, license_dir, n_headers, spans.

    ``path``: a document's slash-separated path, if it has one.  Spans are license:start:end in code points.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    path = F.lit(None).cast("string") if path is None else path
    counts = document_frequencies(docs, scratch, text_col)
    freq, is_sent = sent_frequencies(counts, docs.count())
    model = Templates(freq)
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()
    looked = rows.mapInArrow(_look(model, HEADER_COSINE, FILE_COSINE), LOOKED.format(id_type))
    looked = scratch.keep(looked.withColumn("r", F.monotonically_increasing_id()), "looked")
    few = looked.filter("text is not null")
    met = few.select("r", F.explode("rare").alias("w")).join(counts.filter(~is_sent), "w")
    met = met.groupBy("r").agg(F.collect_list(F.struct("w", "df")).alias("given"))  # of one text's qualifying units
    tasks = -(-few.count() // DOCS_A_TASK) or 1  # few bytes, but each text takes its time
    few = few.join(met, "r", "left").repartition(tasks, "r").select("id", "path", "text", "given")
    scanned = few.mapInArrow(_scan(model, HEADER_COSINE, FILE_COSINE), SCANNED.format(id_type))
    none = ["null as license", "0D as score", "'' as spans", "0L as n_headers", "null as file_license", "0D as file_score"]
    none = looked.filter("text is null").selectExpr("id", "path", *none)
    scanned = scanned.unionByName(none.select(*[F.col(f.name).cast(f.dataType) for f in scanned.schema]))
    # all but the last part; a path of one part lies in the root directory, whose name is empty
    parts = F.split("path", "/")
    scanned = scanned.withColumn("dir", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    scanned = scratch.keep(scanned, "scanned")
    files = scanned.filter("file_license is not null and dir is not null").groupBy("dir").agg(
        F.max(F.struct("file_score", F.col("file_license").alias("l"))).alias("best")
    )
    files = scratch.keep(files.select(F.col("dir").alias("license_dir"), "best"), "files")
    dirs = scanned.filter("license is null and dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(F.split("dir", "/")))).alias("depth"))
    above = above.withColumn("license_dir", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(files, "license_dir").groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "best")).alias("from"))
    out = scanned.join(scratch.keep(nearest, "nearest"), "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("license", F.col("from.best.l")).alias("license"),
        F.when(own, "header").when(F.col("from").isNotNull(), "inherited").alias("method"),
        F.when(own, F.col("score")).otherwise(F.col("from.best.file_score")).alias("score"),
        F.when(~own, F.col("from.license_dir")).alias("license_dir"),
        "n_headers",
        "spans",
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: a source is a tree of directories of 1000 and of 50 consecutive identifiers."""
    docs = table(spark, sf_dir, "documents")
    # a null source is a tree of its own; without an identifier there is no path
    path = F.concat(F.coalesce("source", F.lit("(none)")), F.lit("/"), F.expr("doc_id div 1000"), F.lit("/"), F.expr("doc_id div 50"), F.lit("/"), "doc_id")
    return scan(docs, path=path)
