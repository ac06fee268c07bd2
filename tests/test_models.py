"""Fitted and iterated operators against plain Python, invariants or data that can be told apart."""

import random

import pytest
from pyspark.sql import functions as F

from canopyframe.operators import models as M
from canopyframe.operators import splits as S


def places(spark, n=9):
    rng = random.Random(7)
    rows = [(f"{x}_{y}", x, y, rng.randint(5, 20), rng.randint(0, 5)) for x in range(n) for y in range(n) if (x // 3 + y // 3) % 2 == 0 or rng.random() < 0.3]
    return spark.createDataFrame(rows, "place_key string, grid_x int, grid_y int, rows long, cdw long"), rows


def test_lloyd_equals_plain_rounds(spark):
    df, rows = places(spark)
    for k in (1, 3):
        got = {r.place_key: r.region for r in S.lloyd(df, k, "5").collect()}
        starts = df.withColumn("h", S.hashed("5", "grid_x", "grid_y")).orderBy("h").limit(k).collect()
        centres = [(r.grid_x, r.grid_y) for r in starts]
        nearest = lambda p: min(range(k), key=lambda i: ((p[1] - centres[i][0]) ** 2 + (p[2] - centres[i][1]) ** 2, i))  # noqa: B023, E731
        for _ in range(20):
            new = list(centres)
            for i in range(k):
                own = [p for p in rows if nearest(p) == i]
                if own:
                    new[i] = (round(sum(p[1] for p in own) / len(own)), round(sum(p[2] for p in own) / len(own)))  # round() goes half to even too
            if new == centres:
                break
            centres = new
        assert got == {p[0]: nearest(p) for p in rows}


def chebyshev(a, others):
    return min((max(abs(a.grid_x - b.grid_x), abs(a.grid_y - b.grid_y)) for b in others), default=99)


def test_distance_split_has_val_and_buffers(spark):
    df, rows = places(spark, 24)
    out = S.distance_split(df, radius=1, fraction=0.1, val_fraction=0.1).collect()
    assert len(out) == len(rows) and {r.role for r in out} == {"train", "buffer", "test", "val"}
    of = lambda role: [r for r in out if r.role == role]
    for r in out:
        to_test, to_val = chebyshev(r, of("test")), chebyshev(r, of("val"))
        assert r.role == ("test" if to_test == 0 else "buffer" if to_test == 1 else "val" if to_val == 0 else "buffer" if to_val == 1 else "train")
    total = sum(r.rows for r in out)
    for region in {r.region for r in out}:
        own = [r for r in out if r.region == region]
        size, tested = sum(r.rows for r in own), sum(r.rows for r in own if r.role == "test")
        assert abs(tested - round(round(total * 0.1) * size / total)) <= 20  # within a place's rows
    pool = [r for r in out if chebyshev(r, of("test")) > 1]
    left = sum(r.rows for r in pool)
    for region in {r.region for r in pool}:
        own = [r for r in pool if r.region == region]
        want = round(round(total * 0.1) * sum(r.rows for r in own) / left)
        assert abs(sum(r.rows for r in own if r.role == "val") - want) <= 20
    assert {r.role for r in S.distance_split(df, val_fraction=0).collect()} <= {"train", "buffer", "test"}
    assert S.distance_split(df.limit(0)).count() == 0


def curated_rows(spark, n=14, seed=3):
    rng = random.Random(seed)
    rows = []
    for x in range(n):
        for y in range(n):
            for k in range(rng.randint(3, 9)):
                rows.append((f"{x}_{y}", x, y, 2020, f"r{x}_{y}", 64 * k, 0, "cdw" if rng.random() < 0.3 else "no_cdw", rng.choice(["manual", "auto", "auto", "auto_skip"]), "threshold_gate", rng.choice([None, 0.01, 0.2, 0.5, 0.8, 0.99])))
    return spark.createDataFrame(rows, "place_key string, grid_x int, grid_y int, year int, raster string, row_off int, col_off int, label string, source string, reason string, model_prob double")


def test_cluster_split_guards_test_and_val_and_mines_train(spark):
    df = curated_rows(spark)
    out = S.cluster_split(df, size=1, guard=1, fraction=0.15, val_fraction=0.1, tolerance=0.05).collect()
    assert len(out) == df.count() and {r.role for r in out} == {"test", "val", "guard", "train", "none"} and len({r.attempt for r in out}) == 1
    test, val = ({(r.grid_x, r.grid_y) for r in out if r.role == z} for z in ("test", "val"))
    near = lambda p, zone, d: any(max(abs(p[0] - a), abs(p[1] - b)) <= d for a, b in zone)
    assert not any(near(p, test, 1) for p in val)
    share = lambda rows: sum(r.label == "cdw" for r in rows) / len(rows)
    for zone in ("test", "val"):
        assert abs(share([r for r in out if r.role == zone]) - share(out)) <= 0.05
    for r in out:
        p, manual = (r.grid_x, r.grid_y), r.source == "manual"
        guarded = p not in test and p not in val and (near(p, test, 1) or near(p, val, 1))
        assert (r.role == "guard") == guarded
        if r.role in ("train", "none"):
            assert (r.role == "train") == (manual or r.model_prob in (0.2, 0.8))
        assert r.is_manual == (manual and r.role == "train") and r.is_pseudo == (not manual and r.model_prob in (0.01, 0.99))
    keys = S.cluster_keys(S.cluster_split(df, size=1, fraction=0.15)).collect()
    assert {k.list for k in keys} == {"test", "val", "train", "manual", "pseudo"}
    tested, trained = ({(k.raster, k.row_off, k.col_off) for k in keys if k.list == name} for name in ("test", "train"))
    assert tested and trained and not tested & trained


def test_cluster_split_takes_the_first_attempt_within_tolerance_or_the_nearest(spark):
    df = curated_rows(spark, 8)
    attempt = lambda **more: S.cluster_split(df, size=1, tries=4, **more).first().attempt
    assert attempt(tolerance=2.0) == 0
    nearest = S.cluster_split(df, size=1, tries=4, tolerance=0.0).collect()
    share = lambda rows: sum(r.label == "cdw" for r in rows) / len(rows)
    off = max(abs(share([r for r in nearest if r.role == z]) - share(nearest)) for z in ("test", "val"))
    assert attempt(tolerance=off + 1e-9) <= nearest[0].attempt  # it is within its own deviation
    assert S.cluster_split(df.limit(0)).count() == 0


def test_stride_by_remainders(spark):
    for values, want in (([64, 128, 192], 64), ([48, 36, 90], 6), ([0, 0], 64), ([7], 7), ([10**6, 10**6 + 1], 1), ([None, 20, 30], 10)):
        df = spark.createDataFrame([(v, 0) for v in values], "row_off int, col_off int")
        assert S.infer_stride(df).first().stride == want


def scores(spark, n):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        y = i % 2
        for model, noise in (("good", 0.2), ("noise", 2.0)):
            rows.append((i, model, min(1.0, max(0.0, 0.2 + 0.6 * y + rng.gauss(0, noise))), y, "test" if i % 4 > 1 and i % 3 == 0 else "train"))
    return spark.createDataFrame(rows, "key long, model string, prob double, y int, split string")


def test_stacking_prefers_the_better_model_and_falls_back(spark):
    df = scores(spark, 600)
    out = M.stacking(df, least=200).collect()
    assert len(out) == df.filter("split = 'test' AND model = 'good'").count() and all(0 <= r.prob <= 1 for r in out)
    right = sum((r.prob >= 0.5) == (r.y == 1) for r in out) / len(out)
    vote = M.stacking(df, least=10**6)
    assert right > 0.85 and right > sum((r.prob >= 0.5) == (r.y == 1) for r in vote.collect()) / len(out)
    mean = {r.key: r.m for r in df.groupBy("key").agg(F.avg("prob").alias("m")).collect()}
    assert all(abs(r.prob - mean[r.key]) < 1e-9 for r in vote.collect())


def test_forest_and_tile_baselines_tell_classes_apart(spark):
    rng = random.Random(3)
    points = [(i, float(i % 3) + rng.random() / 2, rng.random(), 1, 2, None if i % 9 == 0 else 0.0, 0.1, i % 3) for i in range(300)]
    df = spark.createDataFrame(points, "point_id long, z double, intensity double, return_number int, number_of_returns int, scan_angle double, nir double, classification int")
    rows = [r.asDict() for r in M.point_forest(df).collect()]
    f1 = [v for r in rows for k, v in r.items() if "f1" in k]
    assert f1 and min(f1) > 0.9
    pixels = [(t, r, c, (1.0 if t % 2 else 0.1) * rng.random(), t % 2) for t in range(80) for r in range(4) for c in range(4)]
    px = spark.createDataFrame(pixels, "tile_id long, row int, col int, value double, label int")
    out = M.tile_baselines(px).collect()
    assert out and sum((r.prob >= 0.5) == (r.y == 1) for r in out) / len(out) == pytest.approx(1.0, abs=0.1)


def grouped_noise(spark, groups=60, copies=8):
    """Groups of equal rows with random labels: a model that has seen a group's row knows its label, any other cannot."""
    rng = random.Random(5)
    rows = []
    for g in range(groups):
        x, y = [rng.gauss(0, 1) for _ in range(4)], g % 2
        rows += [(len(rows) + i, y, f"g{g}", "test" if g % 10 > 7 else "train", *x) for i in range(copies)]
    return spark.createDataFrame(rows, "key long, y int, place string, split string, a double, b double, c double, d double")


def test_out_of_fold_probabilities_do_not_leak(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from canopyframe.operators.folds import stratified_folds, stratified_group_folds

    df = grouped_noise(spark)
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).withColumn("label", F.col("y").cast("double")).withColumn("c", F.col("y").cast("string"))
    learner = {"tree": lambda: DecisionTreeClassifier(maxDepth=12, seed=1)}

    def right(folded):
        out = M.out_of_fold(folded.select("key", "label", "place", "fold", "features"), learner, 4).collect()
        assert sorted(r.key for r in out) == sorted(r.key for r in df.collect())
        return sum((r.tree >= 0.5) == (r.label == 1) for r in out) / len(out)

    whole = right(stratified_group_folds(rows, "place", "c", ["0", "1"], 4, "s"))
    split = right(stratified_folds(rows, F.col("key"), "c", 4, "s"))
    assert split > 0.95 and whole < 0.75  # rows of a group in other folds give its label away


def test_second_stage_on_leaking_probabilities_is_another(spark):
    """Of a learner that memorises and one that generalises, only out-of-fold rows tell the second stage which to trust."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    rng = random.Random(9)
    rows = []
    for i in range(900):
        y = i % 2
        rows.append((i, y, f"g{i // 3}", "test" if i % 9 > 5 else "train", y + rng.gauss(0, 0.9), rng.random(), rng.random(), rng.random()))
    df = spark.createDataFrame(rows, "key long, y int, place string, split string, a double, b double, c double, d double")
    learners = {"tree": lambda: DecisionTreeClassifier(maxDepth=20, maxBins=64, minInstancesPerNode=1, seed=1), "lr": lambda: LogisticRegression(regParam=0.01)}
    right = lambda out: sum(r.pred == r.y for r in out) / len(out)
    clean = M.cross_fitted_stacking(df, list("abcd"), "place", learners=learners).collect()
    own = M.out_of_fold

    def leaking(rows, learners, folds):
        for name, learner in learners.items():
            rows = M._probability(M._fit(learner, rows), rows, name)
        return rows

    M.out_of_fold = leaking
    try:
        leaked = M.cross_fitted_stacking(df, list("abcd"), "place", learners=learners).collect()
    finally:
        M.out_of_fold = own
    assert len(clean) == len(leaked) == df.filter("split = 'test'").count()
    assert {r.key: round(r.prob, 6) for r in clean} != {r.key: round(r.prob, 6) for r in leaked}
    assert right(clean) > right(leaked)


def test_few_rows_or_one_class_fall_back_to_the_mean(spark):
    df = grouped_noise(spark, 20, 3)
    out = M.cross_fitted_stacking(df, list("abcd"), "place").collect()
    assert len(out) == df.filter("split = 'test'").count() and all(r.pred == (r.prob >= 0.5) for r in out)
    one = M.cross_fitted_stacking(df.withColumn("y", F.lit(1)), list("abcd"), "place", least=1).collect()
    assert all(r.prob == 1.0 for r in one)


def test_best_f1_cut_equals_trying_every_probability(spark):
    rng = random.Random(6)
    for n in (1, 40):
        rows = [(round(rng.random(), 1), float(rng.random() < 0.4)) for _ in range(n)] + [(0.3, 1.0)]

        def f1(at):
            tp = sum(y for p, y in rows if p >= at)
            return 2 * tp / (sum(p >= at for p, _ in rows) + sum(y for _, y in rows))

        best = max(f1(p) for p, _ in rows)
        assert M.best_f1_cut(spark.createDataFrame(rows, "prob double, label double")) == min(p for p, _ in rows if f1(p) == best)
    assert M.best_f1_cut(spark.createDataFrame([(0.2, 0.0)], "prob double, label double")) == 0.5


def test_importances_put_noise_last_and_macro_f1_counts_every_class(spark):
    rng = random.Random(3)
    rows = [(i, (i % 3) + rng.gauss(0, 0.3), (i % 3 == 0) + rng.gauss(0, 0.6), rng.random(), None if i % 7 == 0 else 1.0, ["x", "y", "z"][i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, strong double, weak double, noise double, flat double, kind string")
    got = {r.feature: r for r in M.forest_importances(df, features=["strong", "weak", "noise", "flat"], label="kind", key="id").collect()}
    assert sum(r.importance for r in got.values()) == pytest.approx(1, abs=1e-4)
    for name in ("importance", "permutation"):
        assert got["strong"][name] > got["weak"][name] > got["noise"][name] >= got["flat"][name] - 1e-9
    assert got["strong"].permutation > 0.3 and abs(got["noise"].permutation) < 0.05 and got["flat"].permutation == 0
    counts = spark.createDataFrame([(0.0, 0.0, 8), (0.0, 2.0, 2), (1.0, 0.0, 5)], "label double, prediction double, n long")
    assert M.macro_f1(counts, []).first()[0] == pytest.approx((16 / 23 + 0 + 0) / 3)


def noisy_points(spark, n):
    rng = random.Random(4)
    rows = [(i, rng.gauss(i % 3, 1), None if i % 11 == 0 else rng.gauss(0, 1) + (i % 3 == 1), float(rng.randint(0, 3)), float("nan") if i % 13 == 0 else float(i % 50 == 0), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, rare double, kind int")


def test_forest_reads_rows_by_counts_of_their_bins(spark, monkeypatch):
    """The fit's units stay bounded while rows grow, hold each row's weight, and are the rows themselves where those are few."""
    df = noisy_points(spark, 900)
    features = ["a", "b", "c", "rare"]
    fitted = []
    fit = M.RandomForestClassifier.fit
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, rows: fitted.append(rows.agg(F.count("*"), F.sum("weight"), F.max("weight")).first()) or fit(self, rows))
    whole = [r.macro_f1 for r in M.point_forest(df, 3, 5, features, "kind", "id").collect()]
    assert [tuple(f) for f in fitted] == [(600, 600.0, 1.0)] * 3 and min(whole) > 0.45
    fitted.clear()
    monkeypatch.setattr(M, "DRAWN", 100)
    copies = df.unionByName(df.withColumn("id", F.col("id") + 1000)).unionByName(df.withColumn("id", F.col("id") + 2000))
    M.point_forest(copies, 3, 5, features, "kind", "id").collect()
    assert all(f[0] < 1000 and f[1] == pytest.approx(1800) and f[2] > 1 for f in fitted)


def test_split_points_keep_rare_values_and_share_out_many():
    assert M.split_points([0.0] * 999 + [1.0]) == [0.5] and M.split_points([2.0] * 5) == [] and M.split_points([]) == []
    cuts = M.split_points([float(i) for i in range(3200)])
    assert cuts == [100.0 * i - 0.5 for i in range(1, 32)]
    assert M.split_points([-float("inf"), 0.0, 2.0, float("inf")]) == [1.0]


def test_exchange_counts_are_the_forests_predictions_on_rows_of_two_orders(spark, monkeypatch):
    """Fourteen features (two longs of bins), in stretches, in one and numbered, against pairs made in plain Python and predicted by the forest itself."""
    from hashlib import md5

    rng = random.Random(8)
    names = [f"f{i}" for i in range(14)]
    rows = [(i, *[rng.gauss(i % 3, 2) if j % 4 else float(rng.randint(0, 3) + i % 3) for j in range(14)], i % 3) for i in range(700)]
    df = spark.createDataFrame(rows, f"id long, {', '.join(f'{c} double' for c in names)}, kind int")
    _, forest, _, held = next(M.forest_folds(df, names, "kind", "id", 3, 7))
    kept = [(r.id, r.label, [(r[f"bins{j // 12}"] >> 5 * (j % 12)) & 31 for j in range(14)]) for r in held.collect()]
    order = lambda seed: sorted(kept, key=lambda r: md5(f"{seed}|{r[0]}".encode()).hexdigest())
    tried = [(j, own[1], [given[2][x] if x == j else own[2][x] for x in range(14)]) for own, given in zip(order("to"), order("from")) for j in range(-1, 14)]
    table = spark.createDataFrame(tried, "turn int, label double, bins array<int>").repartition(4)
    plain = forest.transform(table.withColumn("features", M.array_to_vector(F.col("bins").cast("array<double>"))))
    want = {(r.turn, r.label, r.prediction): r.n for r in plain.groupBy("turn", "label", "prediction").agg(F.count("*").alias("n")).collect()}
    model = M.BinnedForest(forest, spark)
    for setting in ({"STRETCH": 40}, {"STRETCH": 1 << 16}, {"CROWDED": 0}):
        for name, value in setting.items():
            monkeypatch.setattr(M, name, value)
        made = M.exchange_counts(held, model, "id").collect()
        got = {}
        for r in made:
            at = (r["__turn"], r.label, r.prediction)
            got[at] = got.get(at, 0) + r.n
        assert got == want
        assert len(made) > 3 * len(want) or "STRETCH" not in setting or setting["STRETCH"] > 40  # each stretch gives its own counts


def test_exchange_routes_share_each_place_once():
    rng = random.Random(2)
    counts = M.np.array([[rng.choice([0, 0, 1, 5, 40]) for _ in range(64)] for _ in range(2)])
    counts[1, 63] += counts[0].sum() - counts[1].sum() if counts[0].sum() > counts[1].sum() else 0
    counts[0, 63] += counts[1].sum() - counts[0].sum()
    routes, skip = M.exchange_routes(counts, 30)
    place, given = 0, []
    for g in sorted(skip):
        own = sum(int(counts[0, b]) for b, at in routes if at == g and b < 64)
        theirs = [(b - 64, i) for b, at in routes if at == g and b >= 64 for i in range(counts[1, b - 64])]
        assert own and len(theirs) >= skip[g] + own
        given += theirs[skip[g] : skip[g] + own]
    assert given == [(b, i) for b in range(64) for i in range(counts[1, b])] and len(skip) > 5
