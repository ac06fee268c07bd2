"""Metrics, ensembles, statistics and run tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopyframe.operators import metrics as M
from canopyframe.operators import rasters as R
from canopyframe.plans.ranking import global_row_number
from canopyframe.queries.base import query
from canopyframe.queries.split_sql import stratified_folds

SV = "sv AS (SELECT key, y, avg(prob) AS prob FROM scores GROUP BY key, y)"
CONF = "CAST(count(*) FILTER (prob >= {t} AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (prob >= {t} AND y <> 1) AS BIGINT) AS fp, CAST(count(*) FILTER (prob < {t} AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (prob < {t} AND y <> 1) AS BIGINT) AS tn"


def z(a, b):
    return f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


RATES = f"""round({z("tp", "tp + fn")}, 6) AS sensitivity, round({z("tn", "tn + fp")}, 6) AS specificity, round({z("tp", "tp + fp")}, 6) AS precision, round({z("tn", "tn + fn")}, 6) AS npv, round({z("tp + tn", "tp + fp + fn + tn")}, 6) AS accuracy,
round({z("2 * tp", "2 * tp + fp + fn")}, 6) AS f1, round({z("tp * tn - fp * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)")}, 6) AS mcc"""
SWEEP = "c AS (SELECT k / 100.0::DOUBLE AS threshold, CAST(count(*) FILTER (p1 >= k * 10 AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (p1 >= k * 10 AND y <> 1) AS BIGINT) AS fp, CAST(count(*) FILTER (p1 < k * 10 AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (p1 < k * 10 AND y <> 1) AS BIGINT) AS tn FROM (SELECT CAST(round(prob * 1000) AS BIGINT) AS p1, y FROM scores WHERE model = 'alpha'), (SELECT unnest(range(0, 101)) AS k) GROUP BY k)"


def alpha(t):
    return t.scores().filter("model = 'alpha'")


@query("met01_confusion", f"WITH c AS (SELECT model, {CONF.format(t=0.5)} FROM scores GROUP BY model) SELECT *, {RATES} FROM c")
def _(t):
    return M.rates(M.confusion(t.scores(), ["model"], 0.5))


@query("met02_threshold_sweep", f"WITH {SWEEP} SELECT *, {RATES} FROM c")
def _(t):
    return M.rates(M.threshold_sweep(alpha(t)))


@query("met03_calibration", "SELECT CAST(least(CAST(round(prob * 1000) AS BIGINT) // 100, 9) AS INTEGER) AS bin, count(*) AS n, round(avg(y), 6) AS observed, round(avg(prob), 6) AS predicted FROM scores WHERE model = 'alpha' GROUP BY bin")
def _(t):
    return M.calibration(alpha(t))


@query("met04_roc_auc", "WITH r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0 AS rk FROM scores) SELECT model, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY model")
def _(t):
    return M.roc_auc(t.scores(), ["model"])


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY prob DESC, key) AS rn FROM scores)"


@query("met04_average_precision", f"WITH {RANKED}, h AS (SELECT *, sum(y) OVER (PARTITION BY model ORDER BY rn) AS hits FROM r) SELECT model, round(sum(hits / rn) FILTER (y = 1) / sum(y), 6) AS ap FROM h GROUP BY model")
def _(t):
    return M.average_precision(t.scores().select("model", "key", "prob", "y"), ["model"])


@query("win12_rank_with_ties", "SELECT key, model, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0::DOUBLE AS rk FROM scores")
def _(t):
    w = Window.partitionBy("model")
    return t.scores().select("key", "model", (F.rank().over(w.orderBy("prob")) + (F.count("*").over(Window.partitionBy("model", "prob")) - 1) / 2).alias("rk"))


@query("win13_cumulative_hits", f"WITH {RANKED} SELECT model, key, rn, CAST(sum(y) OVER (PARTITION BY model ORDER BY rn) AS BIGINT) AS hits FROM r")
def _(t):
    rows = M.ranked(t.scores().select("model", "key", "prob", "y"), ["model"])
    hits = F.sum("y").over(Window.partitionBy("model").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("model", "key", "rn", hits.alias("hits"))


@query(
    "met05_top_k_metrics",
    f"""WITH {RANKED}, a AS (SELECT model, count(*) AS n, sum(y) AS pos FROM scores GROUP BY model), k AS (SELECT model, count(*) AS kk, sum(y) AS hits, sum(CASE WHEN y = 1 THEN 1 / log2(rn + 1) ELSE 0 END) AS dcg FROM r WHERE rn <= 50 GROUP BY model)
    SELECT model, round(hits / kk, 6) AS precision_at_k, round(hits / pos, 6) AS recall_at_k, round((hits / kk) / (pos / n), 6) AS lift_at_k, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 51)) AS i) WHERE i <= least(pos, kk)), 6) AS ndcg_at_k FROM k JOIN a USING (model)""",
)
def _(t):
    return M.top_k_metrics(t.scores().select("model", "key", "prob", "y"), ["model"], 50)


@query("met06_best_threshold", f"WITH {SWEEP}, f AS (SELECT *, {RATES} FROM c) SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def _(t):
    return M.best_f1(alpha(t))


@query("met07_breakdown", f"WITH c AS (SELECT source, year, {CONF.format(t=0.5)} FROM scores WHERE model = 'alpha' GROUP BY GROUPING SETS ((), (source), (year))) SELECT *, {RATES} FROM c")
def _(t):
    return M.breakdown(alpha(t), 0.5, [[], ["source"], ["year"]], ["source", "year"])


@query("met07_place_spread", f"WITH c AS (SELECT place, {CONF.format(t=0.5)} FROM scores WHERE model = 'alpha' GROUP BY place), f AS (SELECT *, {RATES} FROM c), g AS (SELECT CASE WHEN tp + fp + fn + tn >= 10 THEN f1 END AS f FROM f) SELECT count(*) AS places, count(f) AS large, round(avg(f), 6) AS f1_mean, round(stddev_pop(f), 6) AS f1_std, min(f) AS f1_min, max(f) AS f1_max FROM g")
def _(t):
    return M.place_spread(alpha(t), 0.5)


@query("met08_precision_thresholds", "WITH m AS (SELECT * FROM scores WHERE model = 'alpha' AND source = 'manual'), p AS (SELECT a.prob, count(*) FILTER (b.y = 1) / count(*) AS prec FROM (SELECT DISTINCT prob FROM m) a JOIN m b ON b.prob >= a.prob GROUP BY a.prob) SELECT t AS target, max(prob) FILTER (prec + 1e-12 >= t) AS threshold FROM p, (SELECT unnest([1.0::DOUBLE, 0.995::DOUBLE, 0.99::DOUBLE, 0.95::DOUBLE]) AS t) GROUP BY t")
def _(t):
    return M.precision_thresholds(alpha(t).filter("source = 'manual'"), [1.0, 0.995, 0.99, 0.95])


@query(
    "met09_coverage_table",
    """SELECT t AS threshold, CAST(count(*) FILTER (source = 'manual' AND prob >= t) AS BIGINT) AS manual_above, CAST(count(*) FILTER (source = 'manual' AND prob >= t AND y = 1) AS BIGINT) AS manual_tp,
    round(count(*) FILTER (source = 'manual' AND prob >= t AND y = 1) / nullif(count(*) FILTER (source = 'manual' AND prob >= t), 0), 6) AS manual_precision, round(count(*) FILTER (source = 'manual' AND prob >= t AND y = 1) / count(*) FILTER (source = 'manual' AND y = 1), 6) AS manual_recall,
    CAST(count(*) FILTER (source <> 'manual' AND prob >= t) AS BIGINT) AS auto_above, round(100.0 * count(*) FILTER (source <> 'manual' AND prob >= t) / count(*) FILTER (source <> 'manual'), 6) AS auto_pct FROM scores, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE]) AS t) WHERE model = 'alpha' GROUP BY t""",
)
def _(t):
    return M.coverage_table(alpha(t), [0.25, 0.5, 0.75, 0.95])


@query("met10_dice_iou", f"WITH c AS (SELECT model, {CONF.format(t=0.5)} FROM scores GROUP BY model) SELECT *, round((2.0 * tp + 1e-6) / (2.0 * tp + fp + fn + 1e-6), 6) AS dice, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou FROM c")
def _(t):
    return M.dice_iou(M.confusion(t.scores(), ["model"], 0.5))


@query("met12_anomaly_distribution", "SELECT CASE WHEN prob >= 0.5 THEN 'fp' ELSE 'tn' END AS kind, CAST(CAST(round(prob * 1000) AS BIGINT) // 100 AS INTEGER) AS bin, count(*) AS n FROM scores WHERE y = 0 GROUP BY ALL")
def _(t):
    kind = F.when(F.col("prob") >= 0.5, "fp").otherwise("tn")
    return t.scores().filter("y = 0").groupBy(kind.alias("kind"), F.floor(F.col("prob") * 10 + 1e-9).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("met13_histogram", "SELECT y, CAST(least(CAST(round(prob * 1000) AS BIGINT) // 50, 19) + 1 AS BIGINT) AS bin, count(*) AS n FROM scores GROUP BY ALL")
def _(t):
    return t.scores().groupBy("y", F.least(F.width_bucket(F.round("prob", 3) + 1e-9, F.lit(0.0), F.lit(1.0), F.lit(20)), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))


BOUND = """m AS (SELECT tile_id, row, col, CASE WHEN value > 0.9 THEN 1 ELSE 0 END AS a, CASE WHEN value > 1.0 THEN 1 ELSE 0 END AS b FROM pixels),
r AS (SELECT *, sum(a) OVER w AS sa, sum(b) OVER w AS sb FROM m WINDOW w AS (PARTITION BY tile_id, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
s AS (SELECT tile_id, row, col, a, b, sum(sa) OVER w AS na, sum(sb) OVER w AS nb FROM r WINDOW w AS (PARTITION BY tile_id, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query(
    "met11_hausdorff95",
    f"""WITH {BOUND}, pa AS (SELECT * FROM s WHERE a = 1 AND na < 9), pb AS (SELECT * FROM s WHERE b = 1 AND nb < 9), d AS (SELECT pa.tile_id, pa.row AS r1, pa.col AS c1, pb.row AS r2, pb.col AS c2, sqrt((pa.row - pb.row) * (pa.row - pb.row) + (pa.col - pb.col) * (pa.col - pb.col)) AS d FROM pa JOIN pb ON pa.tile_id = pb.tile_id),
    n AS (SELECT tile_id, min(d) AS d FROM d GROUP BY tile_id, r1, c1 UNION ALL SELECT tile_id, min(d) FROM d GROUP BY tile_id, r2, c2) SELECT tile_id, round(quantile_cont(d, 0.95), 6) AS hd95, round(1 / (1 + round(quantile_cont(d, 0.95), 6)), 6) AS score FROM n GROUP BY tile_id""",
)
def _(t):
    df = t.pixels().withColumn("a", F.coalesce(F.col("value") > 0.9, F.lit(False)).cast("int")).withColumn("b", F.coalesce(F.col("value") > 1.0, F.lit(False)).cast("int"))
    for c in "ab":
        df = df.withColumn("__s", F.sum(c).over(R.along_row().rowsBetween(-1, 1))).withColumn(f"n{c}", F.sum("__s").over(R.along_col().rowsBetween(-1, 1)))
    return M.hausdorff95(df.filter("a = 1 AND na < 9"), df.filter("b = 1 AND nb < 9"), "tile_id")


@query("join04_pairwise_compare", "SELECT a.key, a.prob AS p, b.prob AS q FROM scores a JOIN scores b ON a.key = b.key WHERE a.model = 'alpha' AND b.model = 'beta'")
def _(t):
    return M.compare_models(t.scores(), "alpha", "beta")


@query("join05_oof_merge", "SELECT key, y, max(prob) FILTER (model = 'alpha') AS alpha, max(prob) FILTER (model = 'beta') AS beta, max(prob) FILTER (model = 'gamma') AS gamma FROM scores GROUP BY key, y")
def _(t):
    return t.scores().groupBy("key", "y").pivot("model", ["alpha", "beta", "gamma"]).agg(F.max("prob"))


@query("ens01_soft_vote", f"WITH {SV} SELECT key, y, round(prob, 6) AS prob, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM sv")
def _(t):
    return M.soft_vote(t.scores()).select("key", "y", F.round("prob", 6).alias("prob"), (F.col("prob") >= 0.5).cast("int").alias("pred"))


@query("ens02_weighted_vote", "SELECT key, y, round(sum(prob * CASE model WHEN 'alpha' THEN 0.6 WHEN 'beta' THEN 0.3 ELSE 0.01 END / 0.91), 6) AS prob FROM scores GROUP BY key, y")
def _(t):
    return M.weighted_vote(t.scores(), {"alpha": 0.6, "beta": 0.3, "gamma": -0.2}).select("key", "y", F.round("prob", 6).alias("prob"))


@query("ens03_stacking")
def _(t):
    from canopyframe.operators import models

    return models.stacking(t.scores())


def stack_rows(t):
    from canopyframe.operators import models

    data, cols = models.tile_data(t.pixels())
    # ten tiles in succession are a place; every fifth place is for the test
    place = F.expr("cast(tile_id div 10 as string)")
    return data.select(F.col("tile_id").alias("key"), F.col("label").cast("int").alias("y"), place.alias("place"), F.when(F.expr("tile_id div 10 % 5 = 0"), "test").otherwise("train").alias("split"), *cols), cols


@query("ens03_cross_fitted")
def _(t):
    """Stacking of three learners over the tiles' feature bank, its second stage fitted on out-of-fold probabilities."""
    from canopyframe.operators import models

    data, cols = stack_rows(t)
    return models.cross_fitted_stacking(data, cols, "place")


STACK = "tl AS (SELECT tile_id, max(label) % 2 AS y, CAST(tile_id // 10 AS VARCHAR) AS place, CASE WHEN max(label) % 2 = 0 THEN 'cdw' ELSE 'no_cdw' END AS label FROM pixels WHERE tile_id // 10 % 5 <> 0 GROUP BY tile_id)"


@query("ens03_out_of_fold", f"WITH RECURSIVE {STACK}, {stratified_folds('tl', 'place', 4, 'oof')} SELECT tile_id AS key, CAST(y AS INTEGER) AS y, fold, 2 AS probabilities FROM tl JOIN sf ON grp = place")
def _(t):
    """Each training tile's fold, and how many of its probabilities, made by fits on the other folds, lie between 0 and 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from canopyframe.operators import models
    from canopyframe.operators.folds import stratified_group_folds
    from canopyframe.plans.lineage import cut

    data, cols = stack_rows(t)
    rows = stratified_group_folds(data.filter("split = 'train'").withColumn("c", F.col("y").cast("string")), "place", "c", ["0", "1"], 4, "oof")
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(rows.fillna(0.0, cols)).select("key", "y", F.col("y").cast("double").alias("label"), "fold", "features")
    found = models.out_of_fold(cut(rows), {"weak": lambda: LogisticRegression(regParam=1.0), "strong": lambda: LogisticRegression(regParam=0.01)}, 4)
    sound = lambda n: F.coalesce(F.col(n).between(0, 1), F.lit(False)).cast("int")
    return found.select("key", "y", "fold", (sound("weak") + sound("strong")).alias("probabilities"))


@query("ml01_importances")
def _(t):
    from canopyframe.operators import models

    return models.forest_importances(t.points())


@query("ml01_random_forest")
def _(t):
    from canopyframe.operators import models

    return models.point_forest(t.points())


@query("ml02_tile_baselines")
def _(t):
    from canopyframe.operators import models

    return models.tile_baselines(t.pixels())


MODES = "m AS (SELECT variant, avg(f1) AS d, avg(CASE WHEN fold < 2 THEN auc END) AS c FROM runs GROUP BY variant, architecture HAVING architecture <> 'arch5'), s AS (SELECT variant, avg(coalesce(0.7 * d + 0.3 * c, d, c)) AS score FROM m GROUP BY variant)"


def modes(t):
    m = t.runs().groupBy("variant", "architecture").agg(F.avg("f1").alias("d"), F.avg(F.when(F.col("fold") < 2, F.col("auc"))).alias("c")).filter("architecture <> 'arch5'")
    return m.groupBy("variant").agg(F.avg(M.composite_score(F.col("d"), F.col("c"))).alias("score"))


@query("ens04_composite_mode_score", f"WITH {MODES} SELECT variant, round(score, 6) AS score FROM s")
def _(t):
    return modes(t).select("variant", F.round("score", 6).alias("score"))


BESTMODE = f"WITH {MODES}, r AS (SELECT variant, score, row_number() OVER (ORDER BY score DESC, variant) AS rn, lead(variant) OVER (ORDER BY score DESC, variant) AS runner_up, lead(score) OVER (ORDER BY score DESC, variant) AS rs FROM s)"


@query("win07_best_mode", f"{BESTMODE} SELECT variant AS best_mode, runner_up, round(score - rs, 6) AS margin, score - rs >= 0.001 AS decisive FROM r WHERE rn = 1")
def _(t):
    w = Window.orderBy(F.desc("score"), "variant")  # over one row per mode
    r = modes(t).withColumn("rn", F.row_number().over(w)).withColumn("runner_up", F.lead("variant").over(w)).withColumn("rs", F.lead("score").over(w))
    margin = F.col("score") - F.col("rs")
    return r.filter("rn = 1").select(F.col("variant").alias("best_mode"), "runner_up", F.round(margin, 6).alias("margin"), (margin >= 0.001).alias("decisive"))


@query("stat02_winner", f"{BESTMODE} SELECT CASE WHEN score - rs >= 0.02 THEN 'WINNER' ELSE 'UNCERTAIN' END AS decision, variant AS top FROM r WHERE rn = 1")
def _(t):
    w = Window.orderBy(F.desc("score"), "variant")
    r = modes(t).withColumn("rn", F.row_number().over(w)).withColumn("rs", F.lead("score").over(w)).filter("rn = 1")
    return r.select(F.when(F.col("score") - F.col("rs") >= 0.02, "WINNER").otherwise("UNCERTAIN").alias("decision"), F.col("variant").alias("top"))


@query("stat01_welch", "WITH g AS (SELECT avg(f1) FILTER (variant = 'raw') AS ma, var_samp(f1) FILTER (variant = 'raw') / count(*) FILTER (variant = 'raw') AS va, count(*) FILTER (variant = 'raw') AS na, avg(f1) FILTER (variant = 'gauss') AS mb, var_samp(f1) FILTER (variant = 'gauss') / count(*) FILTER (variant = 'gauss') AS vb, count(*) FILTER (variant = 'gauss') AS nb FROM runs) SELECT round((ma - mb) / sqrt(va + vb), 6) AS t, round(power(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)), 4) AS dof FROM g")
def _(t):
    return M.welch(t.runs(), "variant", "f1", "raw", "gauss")


@query(
    "stat03_bootstrap",
    """WITH s AS (SELECT prob, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM scores WHERE model = 'alpha'), d AS (SELECT rep, CAST('0x' || substr(md5('seed|' || CAST(rep AS VARCHAR) || '|' || CAST(rn AS VARCHAR)), 1, 12) AS BIGINT) % n + 1 AS pick FROM s, (SELECT unnest(range(1, 41)) AS rep)),
    m AS (SELECT rep, avg(prob) AS mean FROM d JOIN s ON d.pick = s.rn GROUP BY rep) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""",
)
def _(t):
    rows = global_row_number(alpha(t).select("key", "prob"), [F.asc("key")])
    means = M.bootstrap_means(rows, "prob", 40, "seed", rows.count())
    return means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


@query("stat04_balanced_weight", "SELECT key, y, round((SELECT count(*) FROM scores WHERE model = 'alpha') / (2.0 * count(*) OVER (PARTITION BY y)), 6) AS weight FROM scores WHERE model = 'alpha'")
def _(t):
    return M.balanced_weight(alpha(t), "y").select("key", "y", "weight")


LCB = "WITH v AS (SELECT architecture, variant, avg(f1) AS mean, stddev_samp(f1) AS std FROM runs GROUP BY architecture, variant), b AS (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY mean DESC, std, variant) AS rn FROM v)"


@query("win06_lower_bound_ranking", f"{LCB} SELECT architecture, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS lcb, CAST(row_number() OVER (ORDER BY mean - std DESC, mean DESC, architecture) AS INTEGER) AS place FROM b WHERE rn = 1")
def _(t):
    v = t.runs().groupBy("architecture", "variant").agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("std"))
    best = v.withColumn("rn", F.row_number().over(Window.partitionBy("architecture").orderBy(F.desc("mean"), "std", "variant"))).filter("rn = 1")
    lcb = F.col("mean") - F.col("std")
    place = F.row_number().over(Window.orderBy(lcb.desc(), F.desc("mean"), "architecture"))  # over one row per model
    return best.select("architecture", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(lcb, 6).alias("lcb"), place.alias("place"))


@query("x01_best_vs_final_epoch", "WITH e AS (SELECT run, arg_max(f1, f1 * 1e7 - step / 1e7) AS best, max(f1) AS top, arg_max(f1, epoch * 1e8 + step) AS final FROM runs GROUP BY run) SELECT run, top AS best, final, round(top - final, 6) AS drop_abs, round(100 * (top - final) / top, 4) AS drop_pct FROM e")
def _(t):
    g = t.runs().groupBy("run").agg(F.max("f1").alias("best"), F.max_by("f1", F.struct("epoch", "step")).alias("final"))
    d = F.col("best") - F.col("final")
    return g.select("run", "best", "final", F.round(d, 6).alias("drop_abs"), F.round(100 * d / F.col("best"), 4).alias("drop_pct"))


RUNSTAT = "round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, round(100 * stddev_samp(f1) / avg(f1), 4) AS cv_pct, round(median(f1), 6) AS median, round(quantile_cont(f1, 0.25), 6) AS q1, round(quantile_cont(f1, 0.75), 6) AS q3, round(max(f1) - min(f1), 6) AS span"


@query("x02_multi_run_statistics", f"SELECT variant, architecture, {RUNSTAT} FROM runs GROUP BY variant, architecture")
def _(t):
    f = F.col("f1")
    return t.runs().groupBy("variant", "architecture").agg(F.round(F.avg(f), 6).alias("mean"), F.round(F.stddev_samp(f), 6).alias("std"), F.round(100 * F.stddev_samp(f) / F.avg(f), 4).alias("cv_pct"), F.round(F.median(f), 6).alias("median"), F.round(F.percentile(f, F.lit(0.25)), 6).alias("q1"), F.round(F.percentile(f, F.lit(0.75)), 6).alias("q3"), F.round(F.max(f) - F.min(f), 6).alias("span"))


@query("x03_config_comparison", "SELECT variant, fold, count(*) AS runs, round(avg(f1), 6) AS mean FROM runs WHERE f1 > 0.1 GROUP BY variant, fold ORDER BY mean DESC")
def _(t):
    return t.runs().filter("f1 > 0.1").groupBy("variant", "fold").agg(F.count("*").alias("runs"), F.round(F.avg("f1"), 6).alias("mean")).orderBy(F.desc("mean"))


@query("x04_ablation_report", "SELECT variant, architecture, " + ", ".join(f"round(avg(f1) FILTER (fold = {i}), 6) AS fold{i}" for i in range(3)) + ", round((SELECT stddev_pop(m) FROM (SELECT avg(f1) AS m FROM runs q WHERE q.variant = r.variant AND q.architecture = r.architecture GROUP BY fold)), 6) AS stability FROM runs r GROUP BY variant, architecture ORDER BY avg(f1) DESC LIMIT 10")
def _(t):
    r = t.runs().withColumn("f", F.concat(F.lit("fold"), F.col("fold").cast("string")))
    wide = r.groupBy("variant", "architecture").pivot("f", ["fold0", "fold1", "fold2"]).agg(F.round(F.avg("f1"), 6))
    folds = r.groupBy("variant", "architecture", "fold").agg(F.avg("f1").alias("m"), F.sum("f1").alias("s"), F.count("*").alias("c"))
    agg = folds.groupBy("variant", "architecture").agg(F.round(F.stddev_pop("m"), 6).alias("stability"), (F.sum("s") / F.sum("c")).alias("mean"))
    return wide.join(agg, ["variant", "architecture"]).orderBy(F.desc("mean")).limit(10).drop("mean")


@query("x08_paired_runs", "WITH s AS (SELECT run, variant, avg(f1) AS f FROM runs GROUP BY run, variant) SELECT count(*) AS pairs, round(avg(a.f - b.f), 6) AS advantage FROM s a JOIN s b ON a.run = b.run AND a.variant = 'gauss' AND b.variant = 'baseline'")
def _(t):
    s = t.runs().groupBy("run", "variant").agg(F.avg("f1").alias("f"))
    a = s.filter("variant = 'gauss'").select("run", F.col("f").alias("a"))
    return a.join(s.filter("variant = 'baseline'").select("run", F.col("f").alias("b")), "run").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("advantage"))


@query("x13_best_candidate", "SELECT variant, step, f1 FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY architecture = 'arch1' DESC, f1 DESC, step) AS rn FROM runs) WHERE rn = 1")
def _(t):
    w = Window.partitionBy("variant").orderBy((F.col("architecture") == "arch1").desc(), F.desc("f1"), "step")
    return t.runs().withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("variant", "step", "f1")


@query("x14_diverse_top", "WITH m AS (SELECT architecture, variant, avg(f1) AS f FROM runs GROUP BY architecture, variant), r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f DESC, architecture) AS rn FROM m) SELECT architecture, variant, round(f, 6) AS f1 FROM r ORDER BY rn > 1, f DESC, architecture, variant LIMIT 5")
def _(t):
    m = t.runs().groupBy("architecture", "variant").agg(F.avg("f1").alias("f"))
    r = m.withColumn("rn", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("f"), "architecture")))
    return r.orderBy(F.col("rn") > 1, F.desc("f"), "architecture", "variant").limit(5).select("architecture", "variant", F.round("f", 6).alias("f1"))


@query(
    "x20_cross_validated_comparison",
    """WITH f AS (SELECT model, key % 5 AS fold, avg(y * prob + (1 - y) * (1 - prob)) AS agree, count(*) AS n FROM scores GROUP BY model, fold) SELECT model, round(avg(agree), 6) AS mean, round(stddev_pop(agree), 6) AS std, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY model""",
)
def _(t):
    f = t.scores().groupBy("model", (F.col("key") % 5).alias("fold")).agg(F.avg(F.col("y") * F.col("prob") + (1 - F.col("y")) * (1 - F.col("prob"))).alias("agree"), F.count("*").alias("n"))
    return f.groupBy("model").agg(F.round(F.avg("agree"), 6).alias("mean"), F.round(F.stddev_pop("agree"), 6).alias("std"), F.sum("n").alias("n"))


@query("x21_option_list", "SELECT variant, list_sort(list_distinct(list_concat(['baseline'], CASE WHEN count(*) > 4000 THEN ['large', 'deep'] ELSE ['small'] END, CASE WHEN avg(f1) > 0.5 THEN ['deep'] ELSE ['wide'] END))) AS options FROM runs GROUP BY variant")
def _(t):
    g = t.runs().groupBy("variant").agg(F.count("*").alias("n"), F.avg("f1").alias("f"))
    big = F.when(F.col("n") > 4000, F.lit(["large", "deep"])).otherwise(F.lit(["small"]))
    good = F.when(F.col("f") > 0.5, F.lit(["deep"])).otherwise(F.lit(["wide"]))
    return g.select("variant", F.array_sort(F.array_distinct(F.concat(F.lit(["baseline"]), big, good))).alias("options"))
