import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import metrics as M
from canopyframe.operators import points as P
from canopyframe.operators import rasters as R


def scores(n=300):
    rng = random.Random(4)
    return [(i, "m", round(rng.random(), 2), rng.randint(0, 1)) for i in range(n)]


def test_ranking_metrics(spark):
    rows = scores()
    df = spark.createDataFrame(rows, "key long, model string, prob double, y int").repartition(4)
    p, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0])
    assert M.roc_auc(df, ["model"]).first().auc == round(float(wins) / (y.sum() * (1 - y).sum()), 6)
    order = sorted(range(len(rows)), key=lambda i: (-p[i], i))
    rel = [int(y[i]) for i in order]
    ap = sum(sum(rel[: k + 1]) / (k + 1) for k in range(len(rel)) if rel[k]) / sum(rel)
    assert abs(M.average_precision(df, ["model"]).first().ap - ap) < 2e-6
    top = M.top_k_metrics(df, ["model"], 20).first()
    assert abs(top.precision_at_k - sum(rel[:20]) / 20) < 1e-6
    dcg = sum(r / np.log2(k + 2) for k, r in enumerate(rel[:20])) / sum(1 / np.log2(k + 2) for k in range(20))
    assert abs(top.ndcg_at_k - dcg) < 2e-6


def test_threshold_sweep_and_best(spark):
    rows = scores()
    df = spark.createDataFrame(rows, "key long, model string, prob double, y int")
    got = {round(r.threshold, 2): (r.tp, r.fp, r.fn, r.tn) for r in M.threshold_sweep(df).collect()}
    assert len(got) == 101
    for t in (0.0, 0.29, 0.5, 0.57, 1.0):
        want = tuple(sum((r[2] >= t) == h and (r[3] == 1) == c for r in rows) for h, c in ((True, True), (True, False), (False, True), (False, False)))
        assert got[t] == want
    assert M.best_f1(df).count() == 1


def test_rates_of_empty_classes_are_zero(spark):
    df = spark.createDataFrame([(0.2, 0)], "prob double, y int")
    r = M.rates(M.confusion(df, [], 0.5)).first()
    assert (r.precision, r.sensitivity, r.f1, r.mcc, r.accuracy) == (0.0, 0.0, 0.0, 0.0, 1.0)


def pixels(spark, tiles):
    rows = [(t, 0, i, j, None if np.isnan(v) else float(v)) for t, a in tiles.items() for i, row in enumerate(a) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "tile_id long, label int, row int, col int, value double")


def test_feature_bank_against_numpy(spark):
    rng = np.random.default_rng(2)
    tiles = {1: rng.random((8, 8)), 2: np.full((8, 8), 0.5)}
    got = {r.tile_id: r for r in R.feature_bank(pixels(spark, tiles)).collect()}
    assert len(got[1].asDict()) == 25
    a = tiles[1]
    assert abs(got[1].gr_mean - np.abs(np.diff(a, axis=0)).mean()) < 2e-6
    assert abs(got[1].d135_std - np.abs(a[1:, :-1] - a[:-1, 1:]).std()) < 2e-6
    pad = np.pad(a, 1, mode="edge")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * a
    assert abs(got[1].lap_var - lap.var()) < 2e-6
    win = lambda x, f: f(np.stack([np.pad(x, 1, mode="edge")[i : i + 8, j : j + 8] for i in range(3) for j in range(3)]), axis=0)
    opened = win(win(a, np.min), np.max)
    assert abs(got[1].tophat_mean - (a - opened).mean()) < 2e-6
    assert abs(got[1].ridge_mean - win(np.abs(lap), np.max).mean()) < 2e-6
    assert got[2].std == 0 and got[2].gr_mean == 0


def test_masked_smoothing_fills_and_normalises(spark):
    a = np.ones((8, 8))
    a[3, 3] = np.nan
    got = {(r.row, r.col): r.value for r in R.masked_gaussian(pixels(spark, {1: a})).collect()}
    assert all(abs(v - 1) < 1e-6 for v in got.values())


def test_otsu_splits_two_levels(spark):
    a = np.where(np.arange(64).reshape(8, 8) % 4 == 0, 0.9, 0.1)
    assert R.otsu(pixels(spark, {1: a})).first().threshold == round(0.1 * 255)


def test_offsets(spark):
    got = lambda n, **k: spark.range(1).select(R.offsets(F.lit(n), 128, **k).alias("o")).first().o
    assert got(100) == [0] and got(128) == [0] and got(192) == [0, 64]
    assert got(210) == [0, 64] and got(230) == [0, 64, 102]
    assert got(210, cover=True) == [0, 64, 82]


def test_mask_components_and_cap(spark):
    a = np.zeros((8, 8))
    a[0, 0] = a[1, 1] = a[5, 5:8] = 1
    parts = R.mask_components(pixels(spark, {4: a}), F.col("value") > 0.5).collect()
    assert sorted((r.area, r.length, r.width) for r in parts) == [(2, 2, 2), (3, 3, 1)]
    four = R.mask_components(pixels(spark, {4: a}), F.col("value") > 0.5, connectivity=4).collect()
    assert sorted(r.area for r in four) == [1, 1, 3]


def test_regions_of_slanting_logs_keep_their_axes_and_tiles_of_any_size(spark):
    a = np.zeros((60, 60))
    a[5, 5:35] = 1.0  # a row of thirty pixels
    for i in range(25):
        a[30 + i, 10 + i : 12 + i] = 1.0  # a slanting log, two pixels wide
    a[50:59, 45:54] = 1.0  # a square
    b = np.zeros((60, 60))
    b[1, 0] = b[58, 59] = 1.0
    got = {(r.tile_id, r.first_row, r.first_col): r for r in R.mask_components(pixels(spark, {0: a, 1: b}), F.col("value") > 0.5).collect()}
    assert len(got) == 5 and {k[0] for k in got} == {0, 1}
    row, log, square = got[0, 5, 5], got[0, 30, 10], got[0, 50, 45]
    assert (row.long_axis, row.short_axis) == (pytest.approx(30), pytest.approx(1))
    assert log.length == 26 and log.width == 25  # the bounding box calls it a square
    assert log.long_axis == pytest.approx(25 * 2**0.5, rel=0.03) and log.short_axis < 2
    assert square.long_axis == pytest.approx(9) and square.short_axis == pytest.approx(9)

    def rules(**more):
        return {(r.tile_id, r.first_row): r.rule for r in R.line_regions(R.mask_components(pixels(spark, {0: a, 1: b}), F.col("value") > 0.5), **more).collect()}

    assert rules() == {(0, 5): "main", (0, 30): "main", (0, 50): "none", (1, 1): "fallback", (1, 58): "fallback"}
    assert rules(length=(32, 90)) == {(0, 5): "occluded", (0, 30): "main", (0, 50): "none", (1, 1): "fallback", (1, 58): "fallback"}
    assert rules(length=(32, 90), confident=1.5)[0, 5] == "none"
    assert set(rules(width=(20, 30)).values()) == {"fallback"}
    assert R.line_regions(R.mask_components(pixels(spark, {0: a}), F.col("value") > 5)).count() == 0


def test_surfaces_fall_back_and_features(spark):
    rows = [(1, "t", 2000, 0.1, 12.9, 5.0, 1.0, 1, 1, 1), (2, "t", 2000, 0.2, 12.8, 7.0, 2.0, 1, 1, 1), (3, "u", 2000, 0.1, 12.9, 1.0, 3.0, 1, 2, 2), (4, "u", 2000, 0.1, 12.9, 1.5, 3.0, 2, 2, 6)]
    df = spark.createDataFrame(rows, "point_id long, tile_id string, year int, x double, y double, z double, intensity double, return_number int, number_of_returns int, classification int")
    c = P.to_cells(df, 0.5)
    g = {r.tile_id: r.ground for r in P.surface(c, ["tile_id"], "median").collect()}
    assert g == {"t": 6.0, "u": 1.0}
    b = {r.tile_id: r for r in P.feature_bands(P.heights(c, P.surface(c, ["tile_id"], "lowest"), ["tile_id"]), ["tile_id"], 3.0).collect()}
    assert b["u"].band0 == 0.0 and b["u"].band1 == 0.5 and b["u"].n == 2 and b["t"].band2 == 2.0


def plain_shapes(at, own, radius):
    """The twelve features of one point from its neighbours' coordinates and distances."""
    lam, vec = np.linalg.eigh(np.cov(own.T))
    lam = np.clip(lam, 1e-12, None)
    linear, up = (lam[2] - lam[1]) / lam[2], 1 - abs(vec[2, 0])
    near = (np.linalg.norm(own - at, axis=1) <= radius).sum() / (np.pi * radius**2)
    return {
        "linearity": linear,
        "planarity": (lam[1] - lam[0]) / lam[2],
        "scattering": lam[0] / lam[2],
        "anisotropy": (lam[2] - lam[0]) / lam[2],
        "omnivariance": np.prod(lam) ** (1 / 3),
        "eigenentropy": -(lam * np.log(lam)).sum(),
        "surface_variation": lam[0] / lam.sum(),
        "verticality": up,
        "local_z_std": own[:, 2].std(),
        "height_above_local_min": at[2] - own[:, 2].min(),
        "density_radius": near,
        "skeleton_proxy": linear * up,
    }


def shapes_of(spark, xyz, radius=0.5):
    from canopyframe.operators import spatial

    df = spark.createDataFrame([(i, "t", *map(float, p)) for i, p in enumerate(xyz)], "point_id long, tile_id string, x double, y double, z double")
    near = spatial.nearest(df, df, ["tile_id"], ["x", "y", "z"], "point_id", "point_id", 8, place=True)
    return {r.point_id: r for r in P.eigen_features(near, ["tile_id"], radius).collect()}


def test_all_twelve_shape_features_against_numpy(spark):
    rng = np.random.default_rng(5)
    for scale in ([3, 1, 0.3], [0.2, 0.3, 4], [1, 1, 1]):
        xyz = rng.random((40, 3)) * scale
        got = shapes_of(spark, xyz)
        assert len(got) == 40
        for i in range(40):
            d = np.linalg.norm(xyz - xyz[i], axis=1)
            own = xyz[[j for _, j in sorted((v, j) for j, v in enumerate(d) if j != i)[:8]]]
            for name, want in plain_shapes(xyz[i], own, 0.5).items():
                assert got[i][name] == pytest.approx(want, abs=1e-5), (i, name)


def test_normals_of_lines_planes_and_single_places(spark):
    step = np.arange(12.0)[:, None]
    assert all(r.verticality == pytest.approx(0, abs=1e-6) for r in shapes_of(spark, step * [1, 0, 0]).values())  # a level line
    assert all(r.verticality == pytest.approx(1, abs=1e-6) and r.skeleton_proxy == pytest.approx(1, abs=1e-6) for r in shapes_of(spark, step * [0, 0, 1]).values())  # a pole
    slanting = shapes_of(spark, step * [1, 0, 1])
    assert all(r.verticality == pytest.approx(1 - 0.5**0.5, abs=1e-6) for r in slanting.values())
    wall = np.array([[0.0, a, b] for a in range(4) for b in range(4)]) + [0, 0.01, 0.02]
    assert all(r.verticality == pytest.approx(1, abs=1e-6) and r.planarity > 0 for r in shapes_of(spark, wall).values())
    once = shapes_of(spark, np.zeros((10, 3)))
    assert all(r.verticality == 0 and r.linearity == 0 and r.local_z_std == 0 for r in once.values())
    assert all(r.linearity is None and r.height_above_local_min is not None for r in shapes_of(spark, np.array([[0.0, 0, 1], [1, 0, 0]])).values())
    odd = np.array([[0.0, 0, 0], [1, 0, 0], [np.nan, 0, 0], [np.inf, 0, 0]])
    assert set(shapes_of(spark, odd)) == {0, 1}


def test_soft_vote_does_not_depend_on_the_order_of_rows(spark):
    """0.7 + 0.6 + 0.2 is 1.5 or a double below it, by the order of summing."""
    rows = [("alpha", 0.2), ("beta", 0.6), ("gamma", 0.7)]
    want = ((0.7 + 0.6) + 0.2) / 3
    assert want < 0.5 == ((0.2 + 0.6) + 0.7) / 3
    for order in itertools.permutations(rows):
        df = spark.createDataFrame([("k", 1, m, p) for m, p in [*order, ("delta", None)]], "key string, y int, model string, prob double").coalesce(1)
        assert [r.prob for r in M.soft_vote(df).collect()] == [want]
    assert M.soft_vote(df.filter("prob IS NULL")).first().prob is None
