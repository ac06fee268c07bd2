"""Manifest carry-over against plain Python, and the rank error of merged sketches."""

import random

import pytest
from pyspark.sql import functions as F

from canopyframe.operators.registry import merge_manifest
from canopyframe.plans.ranking import RANK_ERROR, quantile_sketches, sketched_quantiles


def test_manifest_keeps_what_the_last_line_knew(spark):
    now = [("a", "s1", 1), ("b", "s2", 2), ("c", "s3", 3), (None, "s4", 4)]
    before = [("a", "old", None, 1), ("a", None, "u2", 2), ("b", "old", "u", 1), ("d", "x", "y", 1), (None, "n", "n", 1)]
    out = merge_manifest(
        spark.createDataFrame(now, "filename string, sheet string, size int"),
        spark.createDataFrame(before, "filename string, kaart string, url string, line int"),
        {"kaart": F.col("sheet"), "url": F.lit("")},
    )
    assert out.columns == ["filename", "kaart", "url", "sheet", "size", "status"]
    want = {("a", "s1", "u2", "s1", 1, "kept"), ("b", "old", "u", "s2", 2, "kept"), ("c", "s3", "", "s3", 3, "new"), ("d", "x", "y", None, None, "gone")}
    assert {tuple(r) for r in out.collect()} == want and out.count() == 4


@pytest.mark.parametrize("draw", [lambda rng: rng.random(), lambda rng: rng.expovariate(1) ** 3, lambda rng: float(rng.randint(0, 9))])
def test_merged_sketches_keep_their_rank_error(spark, draw):
    rng = random.Random(7)
    rows = [(i % 3, i % 40, draw(rng)) for i in range(30_000)] + [(0, 0, None), (9, 0, None)]
    df = spark.createDataFrame(rows, "g int, day int, v double").repartition(8)
    parts = quantile_sketches(df, ["g", "day"], "v")
    assert parts.agg(F.sum("n")).first()[0] == 30_000 and parts.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    shares = {f"q{i}": i / 20 for i in range(21)}
    got = {r.g: r for r in sketched_quantiles(parts, ["g"], shares).collect()}
    assert set(got) == {0, 1, 2}
    for g in got:
        own = sorted(v for a, _, v in rows if a == g and v is not None)
        for name, q in shares.items():
            low, high = sum(v < got[g][name] for v in own) / len(own), sum(v <= got[g][name] for v in own) / len(own)
            assert low - RANK_ERROR <= q <= high + RANK_ERROR, (g, name)
