"""Label events: gates, deduplication, curation and label audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.functions import keys as K

KEY = ["raster", "row_off", "col_off"]
GATE_SOURCE = "auto_threshold_gate_v4"


def labelled(events: DataFrame) -> DataFrame:
    """Rows labelled cdw or no_cdw that have offsets."""
    return events.withColumn("label", F.trim("label")).filter("label IN ('cdw', 'no_cdw') AND row_off IS NOT NULL AND col_off IS NOT NULL")


def gate_reason(t_high: float = 0.95, t_low: float = 0.05) -> Column:
    passes = ((F.col("label") == "cdw") & (F.col("model_prob") >= t_high)) | ((F.col("label") == "no_cdw") & (F.col("model_prob") <= t_low))
    return F.when(K.is_manual(), "manual_or_reviewed").when(F.col("model_prob").isNull(), "no_prob").when(passes, "threshold_gate").otherwise("below_threshold")


def gate(events: DataFrame, t_high: float = 0.95, t_low: float = 0.05) -> DataFrame:
    """Labelled rows with the reason for which the confidence gate takes or drops them."""
    return labelled(events).withColumn("reason", gate_reason(t_high, t_low))


def first_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key under an order that leaves no ties."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def curate(events: DataFrame, t_high: float = 0.95, t_low: float = 0.05) -> DataFrame:
    """Admitted rows, one per chip: highest priority, then latest time, then latest arrival."""
    kept = gate(events, t_high, t_low).filter("reason IN ('manual_or_reviewed', 'threshold_gate')")
    kept = kept.withColumn("source", F.when(F.col("reason") == "threshold_gate", GATE_SOURCE).otherwise(F.col("source")))
    return first_per_key(kept, KEY, K.mapped("reason", K.PRIORITY, 10).desc(), F.coalesce("timestamp", F.lit("")).desc(), F.desc("arrival"))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each chip."""
    return first_per_key(events, KEY, F.desc("arrival"))


def latest_struct(events: DataFrame, key: list[str], order: str = "arrival") -> DataFrame:
    """As ``latest`` by max_by, which needs no sort and aggregates before it shuffles."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*key, "v.*")


def by_source_rank(events: DataFrame) -> DataFrame:
    """Highest source rank per chip; of equals the later arrival."""
    return first_per_key(events, KEY, K.source_rank().desc(), F.desc("arrival"))


def by_priority_then_newer(events: DataFrame) -> DataFrame:
    """Highest source rank, then newest time; at equal times the first arrival stays."""
    return first_per_key(events, KEY, K.source_rank().desc(), F.desc("timestamp"), F.asc("arrival"))


def manual_pool(events: DataFrame) -> DataFrame:
    return events.filter(K.is_manual())


def pseudo_pool(events: DataFrame, high: float = 0.95, low: float = 0.05) -> DataFrame:
    return events.filter(~K.is_manual() & ((F.col("model_prob") >= high) | (F.col("model_prob") <= low)))


def hard_band(events: DataFrame) -> DataFrame:
    p = F.col("model_prob")
    return events.filter(K.is_manual() | p.between(0.05, 0.30) | p.between(0.70, 0.95))


def split_eligible() -> Column:
    p = F.col("model_prob")
    return F.coalesce(F.col("source").isin("manual", "auto_skip") | (p > 0.95) | (p < 0.05), F.lit(False))


def flag_predictions(scored: DataFrame, review: float = 0.3, accept: float = 0.7) -> DataFrame:
    """``ok`` from accept, ``review`` from review, below it an automatic no_cdw."""
    p = F.col("model_prob")
    flag = F.when(p >= accept, "ok").when(p >= review, "review").otherwise("auto_skip")
    label = F.when(p >= review, "cdw").otherwise("no_cdw")
    return scored.withColumn("flag", flag).withColumn("pred_label", label)


def self_training(scored: DataFrame, labels: DataFrame, positive: float = 0.9, negative: float = 0.1, most: int = 500) -> DataFrame:
    """Confident unlabelled chips, the most confident first; keys break ties."""
    free = scored.join(labels.select(*KEY), KEY, "left_anti")
    p = F.col("model_prob")
    rows = free.withColumn("pseudo", F.when(p >= positive, "cdw").when(p <= negative, "no_cdw")).filter("pseudo IS NOT NULL")
    return rows.withColumn("confidence", K.confidence("model_prob")).orderBy(F.desc("confidence"), *KEY).limit(most)


def review_action(labels: DataFrame, reviewed: DataFrame, downweight: float = 0.3) -> DataFrame:
    """``weight`` of each row: lower where its key is in the review set."""
    flag = reviewed.select(*KEY).distinct().withColumn("__r", F.lit(True))
    return labels.join(flag, KEY, "left").withColumn("weight", F.when(F.col("__r"), downweight).otherwise(1.0)).drop("__r")


# audits


def disagreements(labels: DataFrame, threshold: float = 0.6) -> DataFrame:
    y = K.binary_label("label")
    return labels.withColumn("gap", F.abs(F.col("model_prob") - y)).filter(F.col("gap") > threshold)


def borderline(labels: DataFrame, least: float = 0.9) -> DataFrame:
    return labels.withColumn("entropy", K.entropy("model_prob")).filter(F.col("entropy") >= least)


def stratified_sample(df: DataFrame, strata: list[str], share: float, key: list[str], seed: str) -> DataFrame:
    """``max(1, round(n * share))`` rows of each stratum, in hashed order."""
    w = Window.partitionBy(*strata)
    ranked = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key])))
    ranked = ranked.withColumn("__rn", F.row_number().over(w.orderBy("__h", *key))).withColumn("__n", F.count("*").over(w))
    return ranked.filter(F.col("__rn") <= F.greatest(F.lit(1), F.bround(F.col("__n") * share))).drop("__h", "__rn", "__n")


def review_queue(checks: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """Union of audit checks (name, priority, rows with KEY), each chip under its first check."""
    parts = [df.select(*KEY, F.lit(name).alias("check"), F.lit(p).alias("priority")) for name, p, df in checks]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy(*KEY).agg(F.min(F.struct("priority", "check")).alias("m")).select(*KEY, "m.priority", "m.check")
