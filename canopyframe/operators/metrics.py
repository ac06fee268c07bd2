"""Evaluation: thresholds, calibration, ranking metrics, breakdowns, ensembles and statistics.

Scores are first summed per distinct probability or bucket; windows run over those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.plans.lineage import cut, saved
from canopyframe.plans.ranking import global_row_number, quantiles, running_sums

#: 97.5 % quantiles of Student's t for 1 to 10 degrees of freedom (fixed values).
T975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def soft_vote(scores: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Mean probability over models per key.

    A key's probabilities are summed from the last model to the first, as the SQL's engine does, and not in the order in
    which rows arrive, since the last bit of the sum decides on which side of a threshold a mean on it falls.
    """
    known = F.collect_list(F.when(F.col("prob").isNotNull(), F.struct("model", "prob")))
    total = F.aggregate(F.sort_array("__p", asc=False), F.lit(0.0), lambda a, x: a + x["prob"])
    votes = scores.groupBy("key", *(keep or ["y"])).agg(known.alias("__p"))
    return votes.withColumn("prob", F.when(F.size("__p") > 0, total / F.size("__p"))).drop("__p")


def weighted_vote(scores: DataFrame, weights: dict[str, float], least: float = 0.01) -> DataFrame:
    total = sum(max(w, least) for w in weights.values())
    w = F.coalesce(*[F.when(F.col("model") == m, max(x, least) / total) for m, x in weights.items()], F.lit(0.0))
    return scores.groupBy("key", "y").agg(F.sum(w * F.col("prob")).alias("prob"))


def compare_models(scores: DataFrame, a: str, b: str) -> DataFrame:
    left = scores.filter(F.col("model") == a).select("key", F.col("prob").alias("p"))
    return left.join(scores.filter(F.col("model") == b).select("key", F.col("prob").alias("q")), "key")


def change_stats(pairs: DataFrame, limits: dict[str, float]) -> DataFrame:
    d = F.col("q") - F.col("p")
    rows = pairs.select(d.alias("d"), F.abs(d).alias("a"))
    over = [F.count_if(F.col("a") > v).alias(k) for k, v in limits.items()]
    means = rows.agg(F.count("*").alias("n"), r6(F.avg("a"), "mean_abs"), r6(F.avg("d"), "mean_signed"), *over)
    shares = quantiles(rows, [], "a", {"median_abs": 0.5, "q1": 0.25, "q3": 0.75}).select(*[r6(F.col(c), c) for c in ("median_abs", "q1", "q3")])
    return means.join(shares, F.lit(True), "left")  # one row each


def grouped_stats(df: DataFrame, sets: list[list[str]], cols: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and median of a value over grouping sets.

    Rows are counted once, by all columns and value; moments and the median of every set come from these counts.
    """
    each = cut(df.groupBy(*cols, F.col(value).alias("__v")).agg(F.count("*").alias("__c")))
    v, c = F.col("__v"), F.col("__c")
    # deviations are summed about the mean of all rows, so that their squares keep their digits
    middle = each.filter(v.isNotNull()).agg(F.sum(c * v) / F.sum(c)).first()[0] or 0.0
    member = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), *[(F.col(k) if k in s else F.lit(None)).alias(k) for k in cols]) for i, s in enumerate(sets)])).alias("g")
    key = ["set", *cols]
    marked = cut(each.select(member, "__v", "__c").groupBy(*[F.col(f"g.{k}").alias(k) for k in key], "__v").agg(F.sum("__c").alias("__c")))
    d, known = v - middle, F.sum(F.when(v.isNotNull(), c))
    var = (F.sum(c * d * d) - F.sum(c * d) * F.sum(c * d) / known) / (known - 1)
    g = marked.groupBy(*key).agg(F.sum(c).alias("n"), r6(middle + F.sum(c * d) / known, "mean"), r6(F.when(known > 1, F.sqrt(F.greatest(var, F.lit(0.0)))), "std"), F.min(v).alias("min"), F.max(v).alias("max"))
    m = quantiles(marked, key, "__v", {"median": 0.5}, "__c").select(*[F.col(k).alias(f"__{k}") for k in key], r6(F.col("median"), "median"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return g.join(m, same, "left").select(*cols, "n", "mean", "std", "min", "max", "median")


def mode_intervals(df: DataFrame, mode: str, value: str) -> DataFrame:
    """Mean, sample deviation and t-based 95 % interval per mode; 1.96 beyond ten degrees of freedom."""
    g = df.groupBy(mode).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    t = F.coalesce(F.get(F.lit(T975), (F.col("n") - 2).cast("int")), F.lit(1.96))
    half = F.when(F.col("n") > 1, t * F.col("s") / F.sqrt("n")).otherwise(0.0)
    return g.select(mode, "n", r6(F.col("m"), "mean"), r6(F.col("s"), "std"), F.round(F.col("m") - half, 5).alias("low"), F.round(F.col("m") + half, 5).alias("high"))


def session_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts per section with precision, recall and agreement, rolled up."""
    c = {s: F.count_if(F.col("section") == s) for s in ("tp", "fp", "fn", "tn")}
    g = rows.rollup(*by).agg(*[x.alias(s) for s, x in c.items()])
    tp, fp, fn, tn = (F.col(s) for s in c)
    return g.withColumn("precision", F.round(tp / (tp + fp), 6)).withColumn("recall", F.round(tp / (tp + fn), 6)).withColumn("agreement", F.round((tp + tn) / (tp + fp + fn + tn), 6))


COUNTS = ("tp", "fp", "fn", "tn")


def confusion(df: DataFrame, by: list[str], threshold: float, prob: str = "prob", y: str = "y") -> DataFrame:
    hit, pos = F.col(prob) >= threshold, F.col(y) == 1
    g = df.groupBy(*by) if by else df
    return g.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Rates of confusion counts; a rate whose denominator is zero is zero."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in COUNTS)
    p, s = ratio(tp, tp + fp), ratio(tp, tp + fn)
    mcc = ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    new = {"sensitivity": s, "specificity": ratio(tn, tn + fp), "precision": p, "npv": ratio(tn, tn + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": mcc}
    return counts.select("*", *[r6(c, k) for k, c in new.items()])


def threshold_sweep(df: DataFrame, steps: int = 100, prob: str = "prob", y: str = "y") -> DataFrame:
    """Confusion counts at thresholds 0, 1/steps, ..., 1.

    One aggregation into steps + 1 buckets and a running sum over those, not a scan per threshold.
    """
    level = F.floor(F.col(prob) * steps + 1e-9).cast("int")
    buckets = df.groupBy(level.alias("level")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("level"))
    down = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(buckets, "level", "left").fillna(0, ["p", "n"])
    rows = rows.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("P", F.sum("p").over(Window.partitionBy())).withColumn("N", F.sum("n").over(Window.partitionBy()))
    return rows.select((F.col("level") / steps).alias("threshold"), "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))


def best_f1(df: DataFrame, steps: int = 100) -> DataFrame:
    """Lowest threshold of the grid with the highest F1."""
    s = rates(threshold_sweep(df, steps))
    return s.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("threshold"), "m.f1")


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Observed and predicted share per bin; the last bin is closed."""
    b = F.least(F.floor(F.col("prob") * bins + 1e-9), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("y"), "observed"), r6(F.avg("prob"), "predicted"))


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """AUC with average ranks for ties, from counts per distinct probability."""
    g = df.groupBy(*by, "prob").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    g = running_sums(g, [F.asc("prob")], by, {"upto": F.col("n")})
    g = g.withColumn("wins", F.col("p") * (F.col("upto") - F.col("n") / 2))
    P, N = F.sum("p"), F.sum("n")
    return g.groupBy(*by).agg(r6(F.when((P > 0) & (N > 0), F.sum("wins") / (P * N)), "auc"))


def ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows numbered by falling probability, then key."""
    return global_row_number(df, [F.desc("prob"), F.asc("key")], by)


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean over positives of hits so far over rank; both numbers come from distributed row numbers."""
    rows = ranked(df, by)
    hits = global_row_number(rows.filter("y = 1"), [F.asc("rn")], by, "hits")
    return hits.groupBy(*by).agg(r6(F.sum(F.col("hits") / F.col("rn")) / F.count("*"), "ap"))


def top_k_metrics(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """precision@k, recall@k, lift@k and nDCG@k per group."""
    totals = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    top = ranked(df, by).filter(F.col("rn") <= k)
    gain = F.when(F.col("y") == 1, 1 / F.log2(F.col("rn") + 1)).otherwise(0.0)
    g = top.groupBy(*by).agg(F.count("*").alias("kk"), F.count_if(F.col("y") == 1).alias("hits"), F.sum(gain).alias("dcg")).join(totals, by)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("pos", "kk")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    p = F.col("hits") / F.col("kk")
    return g.select(*by, r6(p, "precision_at_k"), r6(F.col("hits") / F.col("pos"), "recall_at_k"), r6(p / (F.col("pos") / F.col("n")), "lift_at_k"), r6(F.col("dcg") / ideal, "ndcg_at_k"))


def breakdown(df: DataFrame, threshold: float, sets: list[list[str]], cols: list[str]) -> DataFrame:
    """Confusion rates over grouping sets."""
    hit, pos = F.col("prob") >= threshold, F.col("y") == 1
    rows = df.select(*cols, hit.alias("hit"), pos.alias("pos"))
    g = rows.groupingSets(sets, *cols).agg(F.count_if(F.col("hit") & F.col("pos")).alias("tp"), F.count_if(F.col("hit") & ~F.col("pos")).alias("fp"), F.count_if(~F.col("hit") & F.col("pos")).alias("fn"), F.count_if(~F.col("hit") & ~F.col("pos")).alias("tn"))
    return rates(g)


def place_spread(df: DataFrame, threshold: float, place: str = "place", least: int = 10) -> DataFrame:
    g = rates(confusion(df, [place], threshold)).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    f = F.when(F.col("n") >= least, F.col("f1"))
    return g.agg(F.count("*").alias("places"), F.count(f).alias("large"), r6(F.avg(f), "f1_mean"), r6(F.stddev_pop(f), "f1_std"), F.min(f).alias("f1_min"), F.max(f).alias("f1_max"))


def precision_thresholds(df: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the highest probability from which on precision meets it, or null.

    Counts per distinct probability are summed downwards.
    """
    g = df.groupBy("prob").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p"))
    prec = running_sums(g, [F.desc("prob")], [], {"hits": F.col("p"), "rows": F.col("n")}).withColumn("precision", F.col("hits") / F.col("rows"))
    best = prec.agg(*[F.max(F.when(F.col("precision") + 1e-12 >= t, F.col("prob"))).alias(f"t{i}") for i, t in enumerate(targets)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"t{i}").alias("threshold")) for i, t in enumerate(targets)]))
    return best.select(rows.alias("r")).select("r.*")


def coverage_table(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Manual precision and recall, and share of automatic rows, at or above each threshold: one pass."""
    manual, pos = F.col("source") == "manual", F.col("y") == 1
    aggs = [F.count_if(manual).alias("m"), F.count_if(~manual).alias("a"), F.count_if(manual & pos).alias("mp")]
    for i, t in enumerate(thresholds):
        over = F.col("prob") >= t
        aggs += [F.count_if(manual & over).alias(f"m{i}"), F.count_if(manual & over & pos).alias(f"p{i}"), F.count_if(~manual & over).alias(f"a{i}")]
    c = F.col
    one = lambda i, t: F.struct(F.lit(float(t)).alias("threshold"), c(f"m{i}").alias("manual_above"), c(f"p{i}").alias("manual_tp"), F.round(F.when(c(f"m{i}") > 0, c(f"p{i}") / c(f"m{i}")), 6).alias("manual_precision"), F.round(c(f"p{i}") / c("mp"), 6).alias("manual_recall"), c(f"a{i}").alias("auto_above"), F.round(100.0 * c(f"a{i}") / c("a"), 6).alias("auto_pct"))
    return df.agg(*aggs).select(F.explode(F.array(*[one(i, t) for i, t in enumerate(thresholds)])).alias("r")).select("r.*")


def dice_iou(counts: DataFrame, eps: float = 1e-6) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", r6((2 * tp + eps) / (2 * tp + fp + fn + eps), "dice"), r6((tp + eps) / (tp + fp + fn + eps), "iou"))


def hausdorff95(boundary_a: DataFrame, boundary_b: DataFrame, group: str) -> DataFrame:
    """95th percentile of nearest distances between two boundaries of each group, both ways pooled.

    Distances come from the nearest-neighbour search, so a large tile's boundaries are not paired off.
    """
    from canopyframe.operators import spatial

    # the search reads each side several times
    boundary_a, boundary_b = (saved(df.select(group, "row", "col"), "boundary") for df in (boundary_a, boundary_b))
    side = lambda df, key: df.select(group, "row", "col", F.concat_ws("_", "row", "col").alias(key))
    ways = [(boundary_a, boundary_b), (boundary_b, boundary_a)]
    near = [spatial.nearest(side(a, "p"), side(b, "q"), [group], ["row", "col"], "p", "q", 1).select(group, "d") for a, b in ways]
    g = quantiles(near[0].union(near[1]), [group], "d", {"hd95": 0.95}).select(group, r6(F.col("hd95"), "hd95"))
    return g.withColumn("score", F.round(1 / (1 + F.col("hd95")), 6))


def composite_score(deep: Column, classical: Column, weight: float = 0.7) -> Column:
    return F.coalesce(weight * deep + (1 - weight) * classical, deep, classical)


def welch(df: DataFrame, mode: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t and its degrees of freedom between two modes."""
    s = {m: [f(F.when(F.col(mode) == m, F.col(value))) for f in (F.avg, F.var_samp, F.count)] for m in (a, b)}
    g = df.agg(*[c.alias(f"{k}{i}") for k, m in (("a", a), ("b", b)) for i, c in enumerate(s[m])])
    va, vb = F.col("a1") / F.col("a2"), F.col("b1") / F.col("b2")
    dof = F.pow(va + vb, F.lit(2.0)) / (va * va / (F.col("a2") - 1) + vb * vb / (F.col("b2") - 1))
    return g.select(r6((F.col("a0") - F.col("b0")) / F.sqrt(va + vb), "t"), F.round(dof, 4).alias("dof"))


def bootstrap_means(df: DataFrame, value: str, replicates: int, seed: str, n: int) -> DataFrame:
    """Means of hashed resamples: replicate r takes rows numbered md5(seed|r|i) mod n for i = 1..n."""
    numbered = df.select(F.col("rn").alias("pick"), F.col(value).alias("v"))
    draws = df.select(F.col("rn").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 12), 16, 10).cast("long")
    picks = draws.select("rep", (h % n + 1).alias("pick"))
    return picks.groupBy("rep", "pick").agg(F.count("*").alias("c")).join(numbered, "pick").groupBy("rep").agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"))


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class), joined from a table of one row per class."""
    per = df.groupBy(label).agg(F.count("*").alias("__c"))
    per = per.withColumn("weight", F.round(F.sum("__c").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("__c")), 6)).drop("__c")
    return df.join(F.broadcast(per), label)
