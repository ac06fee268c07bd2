"""Counts and shares of labels, coverage and density tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_of(condition: Column) -> Column:
    return F.count_if(condition)


def class_balance(rows: DataFrame, by: list[str], positive: str = "cdw", negative: str = "no_cdw") -> DataFrame:
    """Counts of both labels, total, positive per cent and negatives per positive (of one at least)."""
    pos, neg = count_of(F.col("label") == positive), count_of(F.col("label") == negative)
    out = rows.groupBy(*by).agg(pos.alias("cdw"), neg.alias("no_cdw"), F.count("*").alias("total"))
    return out.withColumn("cdw_pct", F.round(100.0 * F.col("cdw") / F.col("total"), 4)).withColumn("imbalance", F.round(F.col("no_cdw") / F.greatest("cdw", F.lit(1)), 4))


def gini(values: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of a column of counts: one row.

    Ranks are computed over distinct values with their multiplicities, so what is sorted is a small
    aggregate, not the rows.
    """
    from pyspark.sql import Window

    by = values.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    # ranks of c equal values v end at upto: their sum is c * (2 * upto - c + 1) / 2
    part = by.withColumn("ranks", F.col("c") * (2 * upto - F.col("c") + 1) / 2)
    n, s = F.sum("c"), F.sum(F.col("c") * F.col("v"))
    return part.agg(F.when(s > 0, F.round(2 * F.sum(F.col("v") * F.col("ranks")) / (n * s) - (n + 1) / n, 6)).otherwise(0.0).alias("gini"))
