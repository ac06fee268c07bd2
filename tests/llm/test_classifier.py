import random

import numpy as np

from canopyframe.llm import classifier as C


def corpus(spark, n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.7
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "z"))
        labels.append((i, int(good), 0))
    docs += [(n, None, None), (n + 1, "", "z"), (None, "words", "z"), (0, *docs[0][1:])]
    labels += [(n, 0, None), (n + 2, 1, 1), (None, 1, 1), (5, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = corpus(spark)
    rows = C.score_quality(docs, labels).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert 60 < len(held) < 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if truth.get(r.doc_id) is not None]) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    kept = C.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_empty_and_one_sided_tables(spark):
    docs, labels = corpus(spark, 30)
    assert {r.score for r in C.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert C.score_quality(docs.limit(0), labels).count() == 0
    ones = C.score_quality(docs, labels.filter("quality = 1")).collect()
    assert all(r.score > 0.99 for r in ones)


def test_flat_traversal_equals_a_walk_and_fit_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 16))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    trees = C.fit_trees(x, y)
    p = trees.predict(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97
    for row in range(20):
        margin = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[row, f[node]] > t[node])
            margin += v[node - len(f)]
        assert abs(p[row] - 1 / (1 + np.exp(-margin))) < 1e-12


def test_repeated_ids_do_not_exceed_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "fit_trees", lambda x, y: seen.append(len(y)))
    docs = spark.createDataFrame([(i % 4, "text " * (i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    C.train(docs, labels, sample=50)
    C.train(docs.limit(0), labels, sample=50)
    assert seen == [50, 0]


def test_filter_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert C.keep_quality(docs, labels).count() == 0 and C.keep_quality(docs, labels.limit(0)).schema == docs.schema
