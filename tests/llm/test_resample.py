import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from canopyframe.llm import resample as R
from tests.llm.test_decontaminate import plain_words


def plain_features(text, most):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(docs, items, share, least, most):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x, most)) for texts in ([x for _, x in docs], items))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in {*s, *t}}
    out = []
    for d, text in docs:
        f = plain_features(text, most)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = [r for r, (_, text) in zip(out, docs) if len(plain_words(text)) >= least]
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * share // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def cases():
    rng = random.Random(12)
    words = ["alpha", "Béta", "GAMMA", "x1", "日本", "o'clock", "the", "of"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(2, 8)]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "..."), (None, "the of " * 30), (403, "long " * 30_000)]
    docs += [docs[7]] * 60  # one row many times
    return docs, ["the of the of alpha", None, "日本 x1", "", "x1"]


@pytest.mark.parametrize("share, most, least", [(10, 1, 20), (55, 2, 20), (100, 3, 0), (1, 1, 50)])
def test_scores_and_ranks_equal_brute_force(spark, share, most, least):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, "k", 2.0) for d, t in docs], "doc_id long, text string, score string, rank double").repartition(5)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = R.importance_scores(df, target, share=share, most=most, least_words=least)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(docs, items, share, least, most)
    drawn = R.importance_resample(df, target, share=share, most=most, least_words=least)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in rows if r[4] is not None}


def test_empty_tables_and_ids_of_other_types(spark):
    docs, items = cases()
    df = spark.createDataFrame([(None if d is None else f"d{d}", t) for d, t in docs], "doc_id string, text string")
    target = spark.createDataFrame([(t,) for t in items], "text string")
    ranks = [r["rank"] for r in R.importance_scores(df, target, share=50).collect() if r["rank"]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) > 50
    assert R.importance_scores(df.limit(0), target).count() == 0
    assert R.importance_scores(df, target.limit(0)).count() == len(docs)
    assert not [r for r in R.importance_scores(df.limit(2), target).collect() if r["rank"]]


def test_cutoff_is_the_key_at_its_place(spark):
    rng = random.Random(1)
    for keys in ([5], [3, 3, 3], [rng.randint(-50, 50) for _ in range(700)], sorted(rng.random() for _ in range(300)), ["b", "a", "a", "Z", "é"]):
        df = spark.createDataFrame([(k,) for k in keys], "k " + {int: "long", float: "double", str: "string"}[type(keys[0])]).repartition(7)
        for take in {1, 2, len(keys) // 3, len(keys) - 1, len(keys)} - {0}:
            if take <= len(keys):
                at = sorted(keys)[take - 1]
                assert R.cutoff(df, take) == (at, sum(k < at for k in keys))


def test_a_round_leaves_at_most_three_quarters():
    rng = random.Random(2)
    for _ in range(200):
        parts = [sorted(rng.randint(0, rng.choice([5, 1000])) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        pivot = R.weighted_median([(len(p), p[(len(p) - 1) // 2]) for p in parts])
        keys = [k for p in parts for k in p]
        assert 4 * max(sum(k < pivot for k in keys), sum(k > pivot for k in keys)) <= 3 * len(keys) + 2 * len(parts)
