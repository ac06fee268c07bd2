import math
import textwrap
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from canopyframe.llm import licenses as L
from canopyframe.llm.registry import op10_license_scan


def plain_inheritance(rows):
    """rows: (path, own, speaks, score, id) -> nearest license by walking up."""
    said = {}
    for path, own, speaks, score, i in rows:
        if speaks and own:
            folder = path.rpartition("/")[0]
            said.setdefault(folder, []).append((-score, i, own))
    out = []
    for path, own, *_ in rows:
        folder, source = path.rpartition("/")[0], None
        found = own
        while found is None:
            if folder in said:
                found, source = min(said[folder])[2], folder
            elif folder == "":
                break
            else:
                folder = folder.rpartition("/")[0]
        out.append((own, found, source))
    return out


def test_detection_and_inheritance(spark):
    prose = "river stone blue sky and more words of no license whatever " * 5
    rows = [
        ("a/LICENSE", "Released under the MIT License.\n"),
        ("a/b/c/one.txt", prose),
        ("a/b/COPYING.txt", "This work is licensed under the\nGNU General Public License, version 3.\n\n" + prose),
        ("a/b/two.txt", prose + "\nLicensed under CC BY-NC 4.0.\n" + prose),
        ("a/three.txt", prose + "licensed software license"),
        ("x/four.txt", None),
        ("x/y/notice", "Licensed under the Apache License, Version 2.0."),
        ("x/y/five.txt", ""),
        ("top.txt", "permission"),
    ]
    want = [("MIT", "MIT", None), (None, "GPL-3.0", "a/b"), ("GPL-3.0", "GPL-3.0", None), ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (None, "MIT", "a"), (None, None, None), ("Apache-2.0", "Apache-2.0", None), (None, "Apache-2.0", "x/y"), (None, None, None)]
    df = spark.createDataFrame([(i, p, t, "z") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string").repartition(3)
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in L.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(rows))] == want
    own = L.scan_licenses(df).collect()
    facts = [(rows[r.doc_id][0], r.own_license, rows[r.doc_id][0].rpartition("/")[2].lower().startswith(("license", "copying", "notice")), r.score, r.doc_id) for r in sorted(own, key=lambda r: r.doc_id)]
    assert plain_inheritance(facts) == want
    odd = spark.createDataFrame([(None, None, None), (1, "", "Released under the MIT License."), (1, "", "Released under the MIT License.")], "doc_id long, path string, text string")
    assert L.scan_licenses(odd).count() == 3 and L.scan_licenses(odd.limit(0)).count() == 0


def frequencies(**words):
    found = np.zeros(L.TERMS, np.int64)
    for w, n in words.items():
        found[L.term(w.encode())] = n
    return found


def test_cosine_equals_a_dense_form():
    m = L.Matcher(10, frequencies(license=4, the=9, today=3))
    text = b"released under the mit license today"

    def vector(t):
        return {w: c * m.weight(w) for w, c in Counter(L.terms(t)).items()}

    a = vector(text)
    best = 0
    for _, t in L.TEMPLATES:
        b = vector(t.encode())
        dot = sum(a[w] * b.get(w, 0) for w in a)
        best = max(best, dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    assert abs(m.best(text)[1] - best) < 1e-5 and 0 < best < 1
    assert m.weight(b"today") < m.weight(b"unseen")


def test_frequencies_equal_brute_force(spark):
    texts = ["The licence of the river", "river River stone-wall 4.0", None, "", "stone " * 3000]
    n, found = L.term_frequencies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "text")
    want = Counter(t for x in texts for t in {L.term(w) for w in L.terms((x or "").encode())})
    assert n == 5 and {k: int(v) for k, v in enumerate(found) if v} == dict(want)


def test_whole_licenses_ties_and_long_texts():
    m = L.Matcher(10_000, frequencies(the=6000, of=6000, to=6000, software=900))
    for name, t in L.TEMPLATES:
        if len(t) > 600:
            broken = "\n".join(textwrap.wrap(t, 70))
            assert m.best(f"Copyright (c) 2020 A. Holder\n\n{broken}".encode())[0] == name, name
    assert m.best(b"")[0] is None and m.best(b"\n \n")[:2] == (None, 0.0)
    tied = L.Matcher(5, frequencies(), [("A", "same words here"), ("B", "same words here")])
    assert tied.best(b"same words here")[:2] == ("A", 1.0)
    prose = b"river stone blue sky of the river\n" * 50_000
    assert m.best(prose + b"Released under the MIT License.\n" + prose)[0] == "MIT"


def test_registered_query_equals_walking_up(spark, tmp_path):
    """Own licenses, scores and inheritance of the query against plain Python over the same paths."""
    notice = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "licensed under CC BY-NC 4.0"]
    rows = [(i, ("blue sky of the river\n" * (i % 4)) + (notice[i % 7] if i % 7 < 3 and i % 5 == 0 else "stone"), ["en", None, "fr"][i % 11 % 3], f"src{i % 13 // 4}") for i in range(400)] + [(400, None, "en", "src0"), (401, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    n, found = L.term_frequencies(df, "text")
    m = L.Matcher(n, found)
    facts, want = [], {}
    for i, t, lang, source in rows:
        path = "/".join(x for x in (source, lang if i % 3 > 0 else None, str(i // 100) if i % 3 > 1 else None, f"{i}.txt") if x is not None)
        own, score, speaks = m.best((t or "").encode())
        facts.append((path, own, speaks, score, i))
    for (_, own, _, score, i), (_, license, source) in zip(facts, plain_inheritance(facts)):
        want[i] = (own, round(score, 6), license, source)
    got = {r.doc_id: (r.own_license, round(r.score, 6), r.license, r.inherited_from) for r in op10_license_scan(spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(x[3] is not None for x in got.values()) > 50 and any(0 < x[1] < 1 for x in got.values())


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "Released under the MIT License."), ("a", "Licensed under the Apache License, Version 2.0."), (None, "stone")], "doc_id string, text string")
    got = {r.doc_id: r.license for r in L.scan_licenses(df, path=F.lit("x/y.txt"), notice_speaks=True).collect()}
    assert got["b"] == "MIT" and got["a"] == "Apache-2.0" and got[None] in ("MIT", "Apache-2.0")


def test_units_without_the_word_license_and_neighbouring_licenses():
    m = L.Matcher(10_000, frequencies(the=6000, of=6000, to=6000, a=6000, this=3000, version=300, license=1500, licensed=1000, **{"and": 6000}))
    notices = {
        "CC BY-NC 4.0": "CC-BY-NC-4.0",
        "Apache Version 2.0": "Apache-2.0",
        "Creative Commons Attribution 4.0 International": "CC-BY-4.0",
        "GNU General Public License, version 2.": "GPL-2.0",
        "GNU General Public License, version 3.": "GPL-3.0",
        "GNU Affero General Public License, version 3.": "AGPL-3.0",
        "BSD 2-Clause License": "BSD-2-Clause",
        "Released under the ISC License.": "ISC",
    }
    prose = b"river stone blue sky of the river\n"
    for text, name in notices.items():
        assert m.best(text.encode())[0] == name, text
        assert m.best(prose * 3 + text.encode() + b"\n" + prose)[0] == name, text
    assert m.best(prose * 3)[0] is None
