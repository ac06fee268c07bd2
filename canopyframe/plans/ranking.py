"""Row numbers, running sums and exact quantiles over whole tables without a single-task window; mergeable sketches of quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.plans.lineage import cut


def global_row_number(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Row numbers from 1 within ``by`` (or the whole table) under ``order``, which leaves no ties.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows of
    its group in earlier partitions. Only a table of partitions by groups is windowed. The sorted rows
    are checkpointed, since the numbering depends on where range sampling cut them.
    """
    by = by or []
    cols = df.columns
    keys = [F.col(c) for c in by] + order
    laid = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    laid = laid.withColumn("__p", F.shiftright("__id", 33))
    counts = laid.groupBy("__p", *by).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.withColumn("__before", before).drop("__n")
    start = start.select(F.col("__p").alias("__p2"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__first", "__before")
    same = F.col("__p") == F.col("__p2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    number = F.col("__id") - F.col("__first") + F.col("__before") + 1
    return laid.join(start, same).select(*cols, number.alias(name))


#: Rows of a bucket of hashed order from which its share is looked at, and counts of buckets that are broadcast.
CROWDED, BROADCAST = 1_000_000, 1_000_000


def hashed_row_number(df: DataFrame, digest: Column, ties: list[Column], by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Row numbers from 1 within ``by`` (or the whole table) in the order of ``digest`` (hexadecimal), then of ``ties``.

    What ``global_row_number`` gives, without its range sampling and its checkpoint of all rows: digests fall evenly
    into the 4,096 buckets of their first three digits, so a row's number is its place in its bucket plus the
    rows of its group in earlier buckets. Only counts of buckets are windowed over a whole group. Where a
    bucket is crowded, since many rows have the same digest, the table is ranged after all. ``ties`` may be
    left out where equal rows need no order of their own.
    """
    by = by or []
    cols = df.columns
    start = F.substring(digest, 1, 3)
    counts = cut(df.groupBy(*by, start.alias("__b")).agg(F.count("*").alias("__n")))
    seen = counts.agg(F.count("*").alias("buckets"), F.max("__n").alias("most"), (F.sum("__n") / 4096).alias("mean")).first()
    if seen["buckets"] and seen["most"] > max(CROWDED, 8 * seen["mean"]):
        return global_row_number(df.withColumn("__h", digest), [F.col("__h"), *ties], by, name).drop("__h")
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__b").alias("__b2"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    before = F.broadcast(before) if seen["buckets"] <= BROADCAST else before
    same = F.col("__b") == F.col("__b2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    within = F.row_number().over(Window.partitionBy("__b", *by).orderBy("__h", *ties))
    placed = df.withColumn("__b", start).withColumn("__h", F.unhex(digest)).withColumn("__in", within)
    return placed.join(before, same).select(*cols, (F.col("__in") + F.col("__before")).alias(name))


def running_sums(df: DataFrame, order: list[Column], by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums within ``by`` (or the whole table) under ``order``, which leaves no ties.

    As with ``global_row_number`` a row's sum is that of its partition so far plus the sums of earlier partitions.
    """
    cols = df.columns
    keys = [F.col(c) for c in by] + order
    named = df.select("*", *[c.alias(f"__v{i}") for i, c in enumerate(sums.values())])
    laid = cut(named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    laid = laid.withColumn("__p", F.shiftright("__id", 33))
    so_far = Window.partitionBy("__p", *by).orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    parts = laid.groupBy("__p", *by).agg(*[F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(sums))])
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))]
    start = parts.select(F.col("__p").alias("__p2"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *before)
    same = F.col("__p") == F.col("__p2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    rows = laid.select("*", *[F.sum(f"__v{i}").over(so_far).alias(f"__r{i}") for i in range(len(sums))]).join(start, same)
    return rows.select(*cols, *[(F.col(f"__r{i}") + F.col(f"__b{i}")).alias(name) for i, name in enumerate(sums)])


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], count: str | None = None) -> DataFrame:
    """``by`` and exact, linearly interpolated quantiles of the non-null values, one column for each share.

    With ``count`` each row stands for so many rows.

    Values are counted, and the counts are summed over range partitions, so no task holds all distinct
    values as the state of an aggregate does. An empty table gives no row (with ``by`` or without).
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__q")).agg((F.sum(count) if count else F.count("*")).alias("__c"))
    run = running_sums(counts, [F.col("__q")], by, {"__to": F.col("__c")})
    total = run.groupBy(*by).agg(F.max("__to").alias("__n")).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "__n")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    rows = run.join(total, same) if by else run.join(F.broadcast(total))  # a row for the whole table
    at = {name: q * (F.col("__n") - 1) for name, q in shares.items()}
    first = lambda place: F.min(F.when(F.col("__to") > place, F.col("__q")))
    ends = [e for name, x in at.items() for e in (first(F.floor(x)).alias(f"__lo_{name}"), first(F.ceil(x)).alias(f"__hi_{name}"))]
    g = rows.groupBy(*by).agg(*ends, F.max("__n").alias("__n")).filter("__n IS NOT NULL")
    between = lambda name, x: F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (x - F.floor(x))
    return g.select(*by, *[between(name, x).alias(name) for name, x in at.items()])


#: Size of a sketch; the rank of a quantile is off by at most ``RANK_ERROR`` in all but about one of a hundred.
SKETCH_K, RANK_ERROR = 400, 0.0075


def quantile_sketches(df: DataFrame, by: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``by``, ``sketch`` and ``n``: a KLL sketch of each group's non-null values, some kilobytes at any number of them.

    One pass with partial sketches and no sort. Sketches of days or tiles can be stored and merged later
    (``sketched_quantiles``), where exact quantiles need all values again. Groups without values have no row.
    """
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count("*").alias("n"))


def sketched_quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``by`` and a value for each share, from sketches that are merged by the columns of ``by``, as ``quantiles`` gives them exactly."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*by, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in shares.items()])
