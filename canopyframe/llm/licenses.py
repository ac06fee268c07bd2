"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Units of comparison are a text's lines, its paragraphs and the whole text. A text's own license is the
template with the highest cosine over all units, if that reaches ``THRESHOLD``. A text that opens or
closes with its notice (or whose file name says so) also speaks for its directory; texts without a
license of their own take that of the nearest directory on their path that has one.

Scale. Document frequencies of all words are counted over all texts in one pass, in ``TERMS`` hashed
terms (words that fall together share their frequency), so the table of frequencies has a fixed size
whatever the corpus; it is summed from sparse counts of each task. Scoring is a second pass without a
shuffle, on sparse vectors of a unit's words. Inheritance is settled on distinct directories, which are
exploded into their ancestors and joined with the directories that have a license; documents then meet
their directory's answer in one equi-join. A directory with a third of all documents is one row until
that last join, which AQE splits.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.textio import byte_slices
from canopyframe.plans.lineage import cut

THRESHOLD = 0.6
#: Hashed terms whose document frequencies are counted: two megabytes of numbers.
TERMS = 2**18
RESULT = "struct<license:string,score:double,notice:boolean>"

# Notices as their licenses word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Attribution-ShareAlike."),
]
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Whole licenses as they are worded.
TEMPLATES += [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_CONDITIONS}\n{_AS_IS}"),
    ("BSD-3-Clause", f"{_CONDITIONS}\n{_ENDORSE}\n{_AS_IS}"),
]
LICENSE_FILE = r"(?i)^(license|licence|copying|notice)(\.[a-z]+)?$"

_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def term(word: bytes) -> int:
    return zlib.crc32(word) % TERMS


def term_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of texts, and for each hashed term how many hold a word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found, known = 0, np.zeros(TERMS, np.int64), {}
        for b in batches:
            for part in byte_slices(b.column(0)):
                n += len(part)
                for x in part:
                    own = set()
                    for w in set(terms(x)):
                        if w not in known:
                            if len(known) >= TERMS:
                                known.clear()
                            known[w] = term(w)
                        own.add(known[w])
                    found[list(own)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([[-1], at]).astype(np.int32), "n": np.concatenate([[n], found[at]])})

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    found = np.zeros(TERMS, np.int64)
    found[at[at >= 0]] = n[at >= 0]
    return int(n[at == -1].sum()), found


class Weights(dict):
    """Weights of words, worked out when first met; a worker remembers at most ``TERMS`` words."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def __missing__(self, word: bytes) -> float:
        if len(self) >= TERMS:
            self.clear()
        got = self[word] = float(self.idf[term(word)])
        return got


class Matcher:
    """Sparse unit vectors of the templates under given document frequencies of hashed terms."""

    def __init__(self, n: int, found: np.ndarray, templates: list[tuple[str, str]] | None = None):
        self.templates = TEMPLATES if templates is None else templates
        self.idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
        vocabulary = sorted({w for _, t in self.templates for w in terms(t.encode())})
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.rows = np.zeros((len(self.templates), len(vocabulary)))
        for k, (_, t) in enumerate(self.templates):
            for w, c in Counter(terms(t.encode())).items():
                self.rows[k, self.place[w]] = c * self.weight(w)
        size = np.sqrt((self.rows**2).sum(1, keepdims=True))
        self.rows /= np.where(size > 0, size, 1)

    def weight(self, word: bytes) -> float:
        return float(self.idf[term(word)])

    def _scores(self, words: list[bytes]) -> np.ndarray | None:
        """Cosines of a unit to the templates; None if no template shares a word with it."""
        if self.place.keys().isdisjoint(words):
            return None
        counts, weights, at, v, size = Counter(words), self.weights, [], [], 0.0
        for w, c in counts.items():
            x = c * weights[w]
            size += x * x
            if w in self.place:
                at.append(self.place[w])
                v.append(x)
        return self.rows[:, at] @ np.array(v) / math.sqrt(size)

    def best(self, text: bytes) -> tuple[str | None, float, bool]:
        """License, cosine and whether the notice opens or closes the text; ties go to the earlier template."""
        lines, parts = [], [[]]
        for line in text.lower().split(b"\n"):
            if line.strip():
                lines.append(_WORD.findall(line))
                parts[-1].append(lines[-1])
            elif parts[-1]:
                parts.append([])
        parts = [p for p in parts if p]
        units = [(k in (0, len(lines) - 1), x) for k, x in enumerate(lines)]
        units += [(k in (0, len(parts) - 1), [w for x in p for w in x]) for k, p in enumerate(parts) if len(p) > 1]
        units += [(True, [w for x in lines for w in x])] if len(parts) > 1 else []
        top = (0.0, 0, False)
        for edge, unit in units:
            scores = self._scores(unit)
            if scores is not None:
                k = int(scores.argmax())
                top = max(top, (round(float(scores[k]), 6), -k, edge))
        return (self.templates[-top[1]][0] if top[0] >= THRESHOLD else None), top[0], top[2] and top[0] >= THRESHOLD

    @cached_property
    def weights(self) -> Weights:
        return Weights(self.idf)


def license_column(text: Column, matcher) -> Column:
    """``matcher`` is a Spark broadcast of a Matcher, whose size the templates and ``TERMS`` fix."""

    @F.arrow_udf(RESULT)
    def kernel(texts: pa.Array) -> pa.Array:
        rows = [matcher.value.best(x) for part in byte_slices(texts) for x in part]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_()))], ["license", "score", "notice"])

    return kernel(text)


def ancestors(folder: Column) -> Column:
    """``[(depth, folder)]`` of a folder and all above it; the root is the empty string, of depth 0."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("folder")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, notice_speaks: bool = False, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: ``id_col, own_license, score, license, inherited_from``.

    ``path`` is the document's path (column ``path`` unless given). A document with a license speaks for
    its directory if its file name is a license file's or, with ``notice_speaks``, if it opens or closes
    with its notice. With several, the highest score and then the smallest id counts. ``templates`` are
    ``(license, text)`` pairs, those of ``TEMPLATES`` if not given. A null text has no license, a null path
    is in the root. Rows with a null id and repeated rows stay. Other columns are not looked at. An
    empty table gives an empty result. Texts are read whole. ``inherited_from`` is a directory, or null.
    """
    path = F.coalesce(F.col("path") if path is None else path, F.lit(""))
    n, found = term_frequencies(docs, text_col)
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(n, found, templates))
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), license_column(F.col(text_col), matcher).alias("v"))
    clean = F.array_join(F.filter(F.split(F.regexp_replace("path", "[^/]*$", ""), "/"), lambda x: x != ""), "/")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE)
    rows = cut(rows.select("doc_id", clean.alias("folder"), "v.license", "v.score", ((named | (F.lit(notice_speaks) & F.col("v.notice"))) & F.col("v.license").isNotNull()).alias("speaks")))
    # the highest score, then the smallest id of any type (null last), then the first name
    best = F.min(F.struct(-F.col("score"), F.col("doc_id").isNull().alias("none"), "doc_id", "license"))
    said = rows.filter("speaks").groupBy("folder").agg(best.alias("m")).select("folder", F.col("m.license").alias("said")).withColumnRenamed("folder", "from")
    folders = rows.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.depth", F.col("a.folder").alias("from"))
    nearest = folders.join(said, "from").groupBy("folder").agg(F.max(F.struct("depth", "from", "said")).alias("m")).select("folder", F.col("m.from").alias("from"), F.col("m.said").alias("said"))
    out = rows.join(nearest, "folder", "left")
    own = F.col("license")
    return out.select(F.col("doc_id").alias(id_col), own.alias("own_license"), "score", F.coalesce(own, "said").alias("license"), F.when(own.isNull(), F.col("from")).alias("inherited_from"))
