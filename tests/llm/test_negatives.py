import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.llm import negatives as N


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """Rows ``(id, vector, label)``: all scores of all anchors, ids divisible by 50."""
    ok = [(i, [int(np.floor(256 * float(x))) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, q, c in ok:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), i, d) for i, p, d in ok]
        best = sorted((s, i) for s, i, d in scored if d == c and i != a)[:positives]
        for s, p in best:
            band = sorted((t, i) for t, i, d in scored if d != c and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(band)]
    return sorted(out)


def vectors(n=700, dims=9, seed=4, sparse=False):
    """Lengths of several magnitudes, many equal vectors and scores, labels of unlike frequency, odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dims) * rng.choice([0.2, 1, 1, 4])
        if sparse:
            v[rng.random(dims) < 0.7] = 0
        if i % 11 == 0:
            v = np.round(v)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.choice([0, 0, 0, 0, 1, 2, 3, 40]))))
    rows += [(700, None, 1), (701, [0.1, None] + [0.0] * (dims - 2), 1), (702, [float("nan")] * dims, 1), (703, [float("inf")] * dims, 0), (704, [1.0] * dims, None), (None, [1.0] * dims, 1)]
    rows += [(750, [0.0] * dims, 0), (800, [], 2), (801, [1.0], 2), (802, [1.0] * (dims + 3), 0), (850, [0.5] * (dims + 2), 0)]
    return rows + [rows[50], rows[51], rows[51], rows[100]]


def frame(spark, rows):
    # columns of the operator's own names, with other types
    made = [(i, v, c, "x", 1, "y") for i, v, c in rows]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>, label int, tile string, anchor int, q string").repartition(3)


def mined(df, **more):
    return sorted(map(tuple, N.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **more).collect()))


@pytest.mark.parametrize("tile, block, bucket, prunes", [(8192, 65_536, 1024, 0.5), (40, 4, 16, 2.0), (150, 65_536, 64, 0.9)])
def test_equals_brute_force_in_tiles_and_blocks(spark, monkeypatch, tile, block, bucket, prunes):
    monkeypatch.setattr(N, "BUCKET", bucket)
    monkeypatch.setattr(N, "PRUNES", prunes)
    rows = vectors(sparse=bucket == 16)
    assert mined(frame(spark, rows), tile=tile, block=block) == brute(rows)


def test_empty_tables_one_label_and_no_anchor(spark):
    df = frame(spark, vectors())
    assert mined(df.limit(0)) == []
    assert mined(df.filter("vec_id = 1")) == []
    assert mined(df.withColumn("label", F.lit(1))) == []


def test_scores_beyond_double_precision(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1.0, -1.0, 0.5]) * 2**20 + rng.randint(0, 9), float(rng.randint(1, 300)), 2.0**20], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == brute(rows) and len(brute(rows)) > 0


def test_pruned_rows_are_never_among_the_best():
    """Whatever the bound, the candidates hold every row that reaches it, and ranges prune most rows where it is high."""
    rng = np.random.default_rng(8)
    whole = np.floor(256 * rng.normal(size=(900, 12)) * rng.choice([0, 1, 1, 1], size=(900, 12))).astype(np.int64)
    asked = np.floor(256 * rng.normal(size=(40, 12)) * rng.choice([0, 0, 1], size=(40, 12))).astype(np.int64)
    length = N._lengths(asked)
    unit = N._unit(asked, length)
    focus = np.argsort(-np.abs(unit), axis=1)[:, : N.FOCUS]
    bucket = N.Bucket(np.arange(900), np.zeros(900, np.int64), whole, N._lengths(whole))
    score = asked @ whole.T
    for q in (0.2, 0.9, 0.99, 1.0):
        need = np.quantile(score, q, axis=1).astype(np.int64)
        got = {(int(i), int(j), int(s)) for a, r, x in bucket.candidates(asked, length, unit, focus, need) for i, j, s in zip(a, r, x)}
        assert got == {(i, j, int(score[i, j])) for i, j in zip(*np.nonzero(score >= need[:, None]))}
    high = (0.95 * length * bucket.longest).astype(np.int64)
    begin, end = bucket.ranges(unit, focus, high / (length * bucket.longest + 1e-9))
    assert (end - begin).min(1).mean() < 300
