"""Spark ML models over scores, points and tiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.operators import rasters
from canopyframe.operators.folds import stratified_folds, stratified_group_folds
from canopyframe.operators.splits import hashed
from canopyframe.plans.lineage import cut, saved, scratch
from canopyframe.plans.ranking import CROWDED, hashed_row_number, running_sums


def hashed_fold(key, folds: int, seed: str = "fold"):
    """Fold of a key by md5, the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def stacking(scores: DataFrame, least: int = 200) -> DataFrame:
    """Logistic regression over the models' probabilities, fitted on train and val, scored on test.

    With fewer than ``least`` training rows the soft vote stands in.
    """
    models = [r.model for r in scores.select("model").distinct().orderBy("model").collect()]
    wide = scores.groupBy("key", "y", "split").pivot("model", models).agg(F.max("prob")).dropna()
    train, test = wide.filter("split <> 'test'"), wide.filter("split = 'test'")
    if train.count() < least or train.select("y").distinct().count() < 2:
        mean = sum((F.col(m) for m in models), F.lit(0.0)) / max(1, len(models))
        return test.select("key", "y", mean.alias("prob"))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=models, outputCol="features"), LogisticRegression(labelCol="y", regParam=0.01)]).fit(train)
    return fitted.transform(test).select("key", "y", vector_to_array("probability")[1].alias("prob"))


LEARNERS: dict[str, Callable[[], Estimator]] = {
    "lr": lambda: LogisticRegression(regParam=0.1),
    "rf": lambda: RandomForestClassifier(numTrees=20, seed=42),
    "gbt": lambda: GBTClassifier(maxIter=5, seed=42),
}


def _probability(fitted: Model, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the probability of label 1 under ``name``."""
    out = fitted.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.select(*rows.columns, name)


def _fit(learner: Callable[[], Estimator], rows: DataFrame) -> Model:
    return learner().setFeaturesCol("features").setLabelCol("label").fit(rows)


def out_of_fold(rows: DataFrame, learners: dict[str, Callable[[], Estimator]], folds: int) -> DataFrame:
    """``rows`` (features, label, fold from 0 to ``folds`` - 1) with a probability for each learner that comes from a fit on the other folds.

    A fold whose other folds lack a class gets the share of label 1 in them.
    """
    out = None
    for k in range(folds):
        rest, own = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        seen = rest.agg(F.avg("label").alias("share"), F.countDistinct("label").alias("classes")).first()
        for name, learner in learners.items():
            own = _probability(_fit(learner, rest), own, name) if seen["classes"] == 2 else own.withColumn(name, F.lit(seen["share"] or 0.0))
        out = own if out is None else out.unionByName(own)
    return cut(out)


def best_f1_cut(rows: DataFrame, prob: str = "prob", y: str = "label") -> float:
    """The probability that, as a least one, gives the highest F1 (the lowest of equal ones); 0.5 without positives."""
    counts = rows.groupBy(F.col(prob).alias("p")).agg(F.sum(y).alias("hits"), F.count("*").alias("n"))
    run = running_sums(counts, [F.desc("p")], [], {"tp": F.col("hits"), "said": F.col("n")})
    positives = rows.agg(F.sum(y)).first()[0]
    if not positives:
        return 0.5
    f1 = 2 * F.col("tp") / (F.col("said") + F.lit(float(positives)))
    return run.agg(F.max_by("p", F.struct(f1, -F.col("p")))).first()[0]


def cross_fitted_stacking(data: DataFrame, features: list[str], group: str, *, learners: dict[str, Callable[[], Estimator]] | None = None, folds: int = 4, least: int = 200, seed: str = "oof") -> DataFrame:
    """``key, y, prob, pred`` of the rows whose ``split`` is test: stacking on out-of-fold probabilities.

    ``data`` has key, y (0 or 1), split, ``group`` and the feature columns. Rows of a group share a fold, and
    folds have even shares of y, so no base probability that the second stage is fitted on comes from a
    model that has seen the row or its group. The second stage is a logistic regression with balanced
    weights, its cut the one with the best F1 on the out-of-fold rows; test rows are scored by base models
    fitted on all training rows. With fewer than ``least`` training rows, or one class, the mean of the base
    models stands in, with a cut of 0.5. Null features count as 0.
    """
    learners = learners or LEARNERS
    made = VectorAssembler(inputCols=features, outputCol="features").transform(data.fillna(0.0, features))
    made = made.select("key", F.col("y").cast("double").alias("label"), "split", group, "features")
    train = cut(stratified_group_folds(made.filter("split <> 'test'").withColumn("__c", F.col("label").cast("int").cast("string")), group, "__c", ["0", "1"], folds, seed).drop("__c"))
    test = made.filter("split = 'test'")
    known = train.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"), F.avg("label").alias("share")).first()
    for name, learner in learners.items():
        test = _probability(_fit(learner, train), test, name) if known["classes"] == 2 else test.withColumn(name, F.lit(known["share"] or 0.0))
    names = list(learners)
    if known["n"] < least or known["classes"] < 2:
        prob, at = sum((F.col(n) for n in names), F.lit(0.0)) / len(names), 0.5
        scored = test.withColumn("prob", prob)
    else:
        base = out_of_fold(train, learners, folds)
        weight = F.when(F.col("label") == 1, 0.5 / known["share"]).otherwise(0.5 / (1 - known["share"]))
        second = VectorAssembler(inputCols=names, outputCol="meta")
        fitted = LogisticRegression(featuresCol="meta", labelCol="label", weightCol="w", maxIter=500).fit(second.transform(base.withColumn("w", weight)))
        score = lambda rows: fitted.transform(second.transform(rows)).withColumn("prob", vector_to_array("probability")[1])
        scored, at = score(test), best_f1_cut(score(base))
    return scored.select("key", F.col("label").cast("int").alias("y"), "prob", (F.col("prob") >= at).cast("int").alias("pred"))


POINT_FEATURES = ["z", "intensity", "return_number", "number_of_returns", "scan_angle", "nir"]


def macro_f1(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``macro_f1`` from rows of ``label, prediction, n``: the mean over all classes that occur as either."""
    actual = counts.select(*by, F.col("label").alias("c"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), "n")
    said = counts.select(*by, F.col("prediction").alias("c"), F.lit(0).alias("tp"), "n")
    per = actual.unionByName(said).groupBy(*by, "c").agg((2 * F.sum("tp") / F.sum("n")).alias("f1"))
    return per.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


#: Bins of a feature, as many as a forest of Spark ML takes; size of a feature's sketch (ranks are off by about 0.001, as in ``Imputer``).
BINS, SKETCH = 32, 4000
#: Training rows up to which a forest's bootstrap draws each row for itself. Of more, it draws equal rows (of one bin of every feature) a few at a time.
DRAWN = 1 << 20
#: Bits of a bin's number, and how many such numbers a long holds.
BITS, PACKED = 5, 12
#: Depth of a forest's trees: their leaves, 64 at most, are the bits of a long.
DEPTH = 6
#: Rows of a stretch of the exchange's order, which a task pairs at once.
STRETCH = 1 << 16


def split_points(grid: list[float], most: int = BINS) -> list[float]:
    """Cuts of a feature whose evenly spaced quantiles are ``grid``, so that it falls into ``most`` bins at most.

    The rule of Spark's forests for the rows they sample: between all neighbouring values, if those are few
    enough, else where equal shares end.
    """
    values, n = np.unique(np.asarray(grid, dtype=float), return_counts=True)
    at = np.arange(len(values) - 1)
    if len(values) > most:
        upto, wanted = np.cumsum(n), len(grid) * np.arange(1, most) / most
        right = np.clip(np.searchsorted(upto, wanted), 1, len(values) - 1)
        at = np.unique(np.where(wanted - upto[right - 1] < upto[right] - wanted, right - 1, right).clip(0, len(values) - 2))
    cuts = values[at] / 2 + values[at + 1] / 2
    return [float(c) for c in np.unique(cuts[np.isfinite(cuts)])]


class FoldBins:
    """Medians and bins of features, learned from sketches of training rows; numbers a row's bins, nulls as medians."""

    def __init__(self, sketches: DataFrame, features: list[str]):
        ranks = F.split(F.lit(",".join(str(i / 4000) for i in range(4001))), ",").cast("array<double>")  # as one literal
        known = lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, ranks))
        merged = sketches.agg(*[F.kll_merge_agg_double(c).alias(c) for c in features]).select(*[known(F.col(c)).alias(c) for c in features])
        grids = {c: g or [0.0] for c, g in merged.first().asDict().items()}  # 4,001 numbers a feature
        self.medians = {c: g[len(g) // 2] for c, g in grids.items()}
        cuts = [split_points(grids[c]) or [self.medians[c]] for c in features]
        self.bucketizer = Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=features, outputCols=[f"__bin{i}" for i in range(len(features))])

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their bins in the columns of ``packs``."""
        made = self.bucketizer.getOutputCols()
        place = lambda i: F.shiftleft(F.col(made[i]).cast("long"), BITS * (i % PACKED))
        words = {w: sum((place(i) for i in range(at * PACKED + 1, min(len(made), (at + 1) * PACKED))), place(at * PACKED)) for at, w in enumerate(packs(len(made)))}
        return self.bucketizer.transform(rows.fillna(self.medians)).withColumns(words).drop(*made)


def packs(features: int) -> list[str]:
    """Names of the longs that hold a row's bins."""
    return [f"bins{i}" for i in range(math.ceil(features / PACKED))]


def binned_vector(features: int) -> Column:
    words = packs(features)
    return array_to_vector(F.array(*[F.shiftright(words[i // PACKED], BITS * (i % PACKED)).bitwiseAND(F.lit(BINS - 1)).cast("double") for i in range(features)]))


def drawable(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` (with a count ``n``) as units with a ``weight``: each row alone, if all are ``most`` at most, else so few equal rows at a time that ``2 * most`` units do."""
    rows = cells.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") / max(1, math.ceil(rows / most)))
    return cells.withColumn("weight", F.col("n") / parts).withColumn("__part", F.explode(F.sequence(F.lit(1).cast("long"), parts))).drop("__part")


def forest_folds(points: DataFrame, features: list[str], label: str, key: str, folds: int, trees: int) -> Iterator[tuple[int, RandomForestClassificationModel, DataFrame, DataFrame]]:
    """For each fold its number, the forest fitted on the others, its rows counted by ``label, features``, and its rows with their bins; classes are dealt evenly to folds.

    A forest sees no more of a row than its bins, so rows are binned before the fit, by cuts from the training rows, and equal
    ones counted: the fit and its caches grow with the kinds of rows, not with the rows, which are read once for the
    sketches of all folds and once a fold for the counts.
    """
    labels = sorted(r[0] for r in points.select(label).distinct().collect())
    index = F.coalesce(*[F.when(F.col(label) == c, F.lit(float(i))) for i, c in enumerate(labels)], F.lit(None).cast("double"))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    dealt = stratified_folds(points.select(key, label, *[number(c) for c in features]), F.col(key), label, folds, "fold")
    data = dealt.select(key, *features, index.alias("label"), "fold")
    words = packs(len(features))
    sketches = cut(data.groupBy("fold").agg(*[F.kll_sketch_agg_double(c, SKETCH).alias(c) for c in features]))
    for k in range(folds):
        binned = FoldBins(sketches.filter(F.col("fold") != k), features).of(data)
        cells = saved(binned.groupBy((F.col("fold") == k).alias("own"), "label", *words).agg(F.count("*").alias("n")), "cells")
        cells = cells.withColumn("features", binned_vector(len(features)))
        units = drawable(cells.filter("NOT own"), DRAWN)
        tasks = max(points.sparkSession.sparkContext.defaultParallelism, units.count() // 250_000)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=DEPTH, maxBins=BINS, seed=42, weightCol="weight").fit(units.repartition(tasks))
        forest.setRawPredictionCol("").setProbabilityCol("")  # only predictions are asked for
        yield k, forest, cells.filter("own").select("label", "features", "n"), binned.filter(F.col("fold") == k).select(key, "label", *words)


def point_forest(points: DataFrame, folds: int = 3, trees: int = 10, features: list[str] | None = None, label: str = "classification", key: str = "point_id") -> DataFrame:
    """Random forest for point classes: macro F1 per fold, medians in place of nulls."""
    out = None
    for k, forest, own, _ in forest_folds(points, features or POINT_FEATURES, label, key, folds, trees):
        counts = forest.transform(own).groupBy("label", "prediction").agg(F.sum("n").alias("n"))
        row = macro_f1(counts.withColumn("fold", F.lit(k)), ["fold"])
        out = row if out is None else out.union(row)
    return out.select("fold", F.round("macro_f1", 6).alias("macro_f1"))


class BinnedForest:
    """A fitted forest as arrays, for rows of bins in which one feature's bin is exchanged; its predictions are the forest's own.

    A feature's bin leaves some leaves of a tree open, a bit each, and the bit that all of a row's bins leave is its
    leaf. The bits that the other features leave are found once for a row, not anew for each exchange.
    """

    SPREAD = np.uint64(0x03F79D71B4CB0A89)  # the upper six bits of its product with a power of two differ for all 64

    def __init__(self, forest: RandomForestClassificationModel, spark: SparkSession):
        path = scratch(spark, "forest")
        forest.save(path)
        saved_nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # of at most 127 a tree
        nodes = {(r.treeID, r.id): r for r in saved_nodes}
        trees, self.features, self.classes = forest.getNumTrees, forest.numFeatures, forest.numClasses
        self.open = np.zeros((trees, self.features, BINS), np.uint64)
        self.votes = np.zeros((trees, self.classes, 64))
        for t in range(trees):
            leaves: list[list[float]] = []

            def walk(at: int, t: int = t, leaves: list[list[float]] = leaves) -> list[tuple[int, int, int, int]]:
                """Splits at and below a node as feature, the last bin that goes left, the left and the right side's leaves."""
                node = nodes[t, at]
                if node.leftChild < 0:
                    leaves.append(node.impurityStats)
                    return []
                first = len(leaves)
                splits = walk(node.leftChild)
                middle = len(leaves)
                splits += walk(node.rightChild)
                side = lambda a, b: (1 << b) - (1 << a)
                return [*splits, (node.split.featureIndex, math.floor(node.split.leftCategoriesOrThreshold[0]), side(first, middle), side(middle, len(leaves)))]

            splits = walk(0)
            self.open[t] = (1 << len(leaves)) - 1
            for feature, last, left, right in splits:
                self.open[t, feature, : last + 1] &= np.uint64(~right & 0xFFFFFFFFFFFFFFFF)
                self.open[t, feature, last + 1 :] &= np.uint64(~left & 0xFFFFFFFFFFFFFFFF)
            slots = [int((np.array([1 << i], np.uint64) * self.SPREAD >> np.uint64(58))[0]) for i in range(len(leaves))]
            self.votes[t][:, slots] = np.array([np.array(v) / (sum(v) or 1.0) for v in leaves]).T

    def exchanged(self, own: np.ndarray, given: np.ndarray) -> np.ndarray:
        """The class of each row (a column of ``own``) with each feature's bin as in ``given``, a feature a line, and with its own, in the last."""
        votes = np.zeros((self.classes, self.features + 1, own.shape[1]))
        for open_, share in zip(self.open, self.votes):
            mine = np.stack([o[b] for o, b in zip(open_, own)])
            left = np.stack([*[o[b] for o, b in zip(open_, given)], mine[0]])
            others = np.full(own.shape[1], 0xFFFFFFFFFFFFFFFF, np.uint64)
            for j in range(self.features):
                others &= mine[j]
                left[j + 1] &= others
            others = mine[-1].copy()
            for j in range(self.features - 2, -1, -1):
                left[j] &= others
                others &= mine[j]
            slot = (left * self.SPREAD >> np.uint64(58)).view(np.int64)
            for c in range(self.classes):
                votes[c] += share[c][slot]
        said, most = np.zeros(votes.shape[1:], np.int64), votes[0]
        for c in range(1, self.classes):
            said[votes[c] > most] = c
            most = np.maximum(most, votes[c])
        return said

    def counts(self, label: np.ndarray, own: list[np.ndarray], given: list[np.ndarray]) -> pa.Table:
        """``TRIED`` rows: how many rows of a label (NaN: none) get a class when a feature's bin is exchanged, or none (turn -1). Bins come as packed longs."""
        wide = self.classes + 1
        n = np.zeros((self.features + 1, wide * wide), np.int64)
        bins = lambda words, at: np.stack([(words[j // PACKED][at] >> BITS * (j % PACKED)) & (BINS - 1) for j in range(self.features)])
        label = np.nan_to_num(label, nan=self.classes).astype(np.int64)
        for start in range(0, len(label), 1 << 13):  # what the processor's cache holds
            at = slice(start, start + (1 << 13))
            for j, said in enumerate(self.exchanged(bins(own, at), bins(given, at))):
                n[j] += np.bincount(label[at] * wide + said, minlength=wide * wide)
        turn, cell = np.nonzero(n)
        known = [float(c) if c < self.classes else None for c in cell // wide]
        return pa.table({"__turn": pa.array(np.where(turn < self.features, turn, -1), pa.int32()), "label": pa.array(known, pa.float64()), "prediction": pa.array((cell % wide).astype(float)), "n": pa.array(n[turn, cell])})


#: What ``BinnedForest.counts`` gives.
TRIED = "__turn int, label double, prediction double, n long"


def exchange_routes(counts: np.ndarray, stretch: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Buckets with their stretches, and of each stretch how many rows to skip, from the rows of each bucket of two hashed orders (a line each).

    A stretch is some successive buckets of the first order. It gets all buckets of the second (numbered on from the
    first's) whose places it shares, of which the rows to skip come before its own.
    """
    end = counts.cumsum(axis=1)
    start = end - counts
    of = start[0] // stretch
    routes, skip = [], {}
    for g in np.unique(of[counts[0] > 0]):
        mine = np.flatnonzero((of == g) & (counts[0] > 0))
        theirs = np.flatnonzero((start[1] < end[0][mine[-1]]) & (end[1] > start[0][mine[0]]) & (counts[1] > 0))
        routes += [(int(b), int(g)) for b in [*mine, *(theirs + counts.shape[1])]]
        skip[int(g)] = int(start[0][mine[0]] - start[1][theirs[0]])
    return routes, skip


def exchange_counts(rows: DataFrame, model: BinnedForest, key: str) -> DataFrame:
    """``TRIED`` rows for ``rows`` (``key``, label, bins) as they are and with a feature's bins exchanged among them.

    The row at a place of one hashed order gets the value of the row at that place of another. Places follow from
    counts of 4,096 buckets of each order, so one shuffle of packed bins brings stretches of both orders together, where
    they are sorted and paired; a row of the second goes to two stretches, if its bucket does. Where a bucket is
    crowded, since many rows have the same key, rows are numbered and joined by their places instead.
    """
    words = packs(model.features)
    digits = lambda n: [F.conv(F.substring(hashed(seed, key), 1, n), 16, 10).cast("long") for seed in ("to", "from")]
    to, given = digits(3)
    found = rows.select(F.explode(F.array(to, given + 4096)).alias("__b")).groupBy("__b").agg(F.count("*").alias("n")).collect()  # 8,192 at most
    counts = np.zeros(2 * 4096, np.int64)
    counts[[r["__b"] for r in found]] = [r["n"] for r in found]
    counts = counts.reshape(2, 4096)
    if counts.max() > max(CROWDED, 8 * counts[0].mean()):
        theirs = [f"given_{w}" for w in words]
        to = hashed_row_number(rows, hashed("to", key), [F.col(key)], name="__at").select("label", *words, "__at")
        given = hashed_row_number(rows.select(key, *words), hashed("from", key), [F.col(key)], name="__at").select("__at", *[F.col(w).alias(t) for w, t in zip(words, theirs)])

        def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label, *bins = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", *words, *theirs)]
                yield from model.counts(label, bins[: len(words)], bins[len(words) :]).to_batches()

        return to.join(given, "__at").select("label", *words, *theirs).mapInArrow(tried, TRIED)
    routes, skip = exchange_routes(counts, STRETCH)

    def paired(table: pa.Table) -> pa.Table:
        label, h, *bins = [table.column(c).to_numpy() for c in ("label", "__h", *words)]  # a null label as NaN
        order = np.lexsort((label, *bins, h))  # equal keys by what they hold: which is which does not matter then
        own, given = np.split(order, [np.count_nonzero(h < 1 << 60)])
        given = given[skip[table.column("__g")[0].as_py()] :][: len(own)]
        return model.counts(label[own], [w[own] for w in bins], [w[given] for w in bins])

    to, given = digits(15)
    sent = rows.select("label", *words, F.explode(F.array(to, given + (1 << 60))).alias("__h")).withColumn("__b", F.shiftright("__h", 48))
    dealt = F.broadcast(rows.sparkSession.createDataFrame(routes, "__b long, __g int"))
    return sent.join(dealt, "__b").select("__g", "__h", "label", *words).groupBy("__g").applyInArrow(paired, TRIED)


def forest_importances(points: DataFrame, folds: int = 3, trees: int = 10, features: list[str] | None = None, label: str = "classification", key: str = "point_id") -> DataFrame:
    """``feature, importance, permutation``, means over folds: the fitted forests' impurity importances, and the
    loss of macro F1 when the column's values are exchanged among the fold's rows (``exchange_counts``).
    """
    features = features or POINT_FEATURES
    out = None
    for _, forest, _, rows in forest_folds(points, features, label, key, folds, trees):
        weight = forest.featureImportances.toArray().tolist()
        counts = exchange_counts(rows, BinnedForest(forest, points.sparkSession), key).groupBy("__turn", "label", "prediction").agg(F.sum("n").alias("n"))
        f1 = {r["__turn"]: r["macro_f1"] for r in macro_f1(counts, ["__turn"]).collect()}  # a row a column
        listed = [(c, weight[j], f1.get(-1, 0.0) - f1.get(j, 0.0)) for j, c in enumerate(features)]
        part = points.sparkSession.createDataFrame(listed, "feature string, importance double, permutation double")
        out = part if out is None else out.union(part)
    return out.groupBy("feature").agg(F.round(F.avg("importance"), 6).alias("importance"), F.round(F.avg("permutation"), 6).alias("permutation"))


def tile_data(pixels: DataFrame) -> tuple[DataFrame, list[str]]:
    """Tiles with their feature bank and ``label`` (0 or 1), and the features' names."""
    bank = rasters.feature_bank(pixels)
    y = pixels.groupBy("tile_id").agg((F.max("label") % 2).cast("double").alias("label"))
    return bank.join(y, "tile_id"), [c for c in bank.columns if c != "tile_id"]


def tile_baselines(pixels: DataFrame) -> DataFrame:
    """Soft vote of logistic regression, forest and boosted trees over the tiles' feature bank."""
    data, cols = tile_data(pixels)
    data = data.withColumn("fold", hashed_fold(F.col("tile_id"), 5))
    train, test = data.filter("fold > 0"), data.filter("fold = 0")
    made = VectorAssembler(inputCols=cols, outputCol="features")
    train, test = made.transform(train).select("tile_id", "label", "features").cache(), made.transform(test).select("tile_id", "label", "features")
    probs = test.select("tile_id", "label", "features")
    for name, est in (("lr", LogisticRegression(regParam=0.1)), ("rf", RandomForestClassifier(numTrees=20, seed=42)), ("gbt", GBTClassifier(maxIter=5, seed=42))):
        est.setProbabilityCol(f"p_{name}").setPredictionCol(f"y_{name}").setRawPredictionCol(f"r_{name}")
        probs = est.fit(train).transform(probs)
    train.unpersist()
    mean = sum((vector_to_array(f"p_{n}")[1] for n in ("lr", "rf", "gbt")), F.lit(0.0)) / 3
    return probs.select("tile_id", F.col("label").cast("int").alias("y"), mean.alias("prob"))
