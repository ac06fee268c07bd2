"""Folds that keep groups whole and the shares of labels even, and folds within each class."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.operators.splits import hashed
from canopyframe.plans.lineage import cut, saved
from canopyframe.plans.ranking import global_row_number, hashed_row_number


def _dealer(folds: int, totals: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Deals groups of like class counts, vector by vector in the order given; holds the folds' counts only."""
    many = [max(1, n) ** 2 for n in totals]
    weight = [prod(many) // n for n in many]

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [[0] * len(totals) for _ in range(folds)]

        def growth(fold: int, v: list[int]) -> tuple[int, int, int]:
            # a fold's sum of squared shares grows by this and a part that is the same for all folds
            return sum(w * x * h for w, x, h in zip(weight, v, held[fold])), sum(held[fold]), fold

        for pdf in frames:
            upto = []
            for v, c in zip(pdf["v"], pdf["c"].tolist()):
                v = [int(x) for x in v]
                even, rest = divmod(c, folds)
                take = [even] * folds
                held = [[h + even * x for h, x in zip(row, v)] for row in held]
                for _ in range(rest):
                    best = min(range(folds), key=lambda f: growth(f, v))  # noqa: B023
                    take[best] += 1
                    held[best] = [h + x for h, x in zip(held[best], v)]
                upto.append(list(accumulate(take)))
            yield pd.DataFrame({"v": pdf["v"], "upto": upto})

    return kernel


def stratified_group_folds(df: DataFrame, group: str, label: str, classes: list[str], folds: int, seed: str) -> DataFrame:
    """``df`` with a ``fold`` from 0: groups are never split, and folds have like shares of each class.

    Groups are dealt by falling spread of their class counts (the variance, then the counts themselves, the
    greater first), each to the fold whose sum of squared class shares grows least (ties: fewer rows, then the
    lower fold). Groups of the same counts are alike to that rule: they are dealt evenly as far as they
    go round, the rest one by one, and which of them goes where follows from hashed order. Rows of other
    labels, or none, follow their group; rows without a group are a group. An empty table gives an empty one.

    Scale. Groups are counted, then equal class counts; only these pass through one task, in a stream that
    holds the folds' counts. They are far fewer than groups: different counts of two classes sum to
    all rows, so n rows have n^(2/3) at most.
    """
    counts = F.array(*[F.count_if(F.col(label) == c) for c in classes])
    groups = cut(df.groupBy(F.col(group).alias("__g")).agg(counts.alias("v")))
    alike = cut(groups.groupBy("v").agg(F.count("*").alias("c")))
    totals = alike.agg(*[F.coalesce(F.sum(F.col("v")[i] * F.col("c")), F.lit(0)) for i in range(len(classes))]).first()
    add = lambda use: F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + use(x))
    spread = len(classes) * add(lambda x: x * x) - F.pow(add(lambda x: x), F.lit(2)).cast("long")
    stream = alike.withColumn("s", spread).repartition(1).sortWithinPartitions(F.desc("s"), F.desc("v")).select("v", "c")
    upto = cut(stream.mapInPandas(_dealer(folds, list(totals)), "v array<long>, upto array<long>"))
    ranked = global_row_number(groups.withColumn("h", hashed(seed, F.coalesce("__g", F.lit("")))), [F.col("h"), F.col("__g")], ["v"])
    fold = F.size(F.filter("upto", lambda u: u < F.col("rn"))).cast("int")
    of = ranked.join(upto, "v").select("__g", fold.alias("fold"))
    return df.join(of, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def stratified_folds(df: DataFrame, key: Column, label: str, folds: int, seed: str) -> DataFrame:
    """``df`` with a ``fold``: rows of each class are dealt in turn, in hashed order of their key.

    The dealt rows are saved, since nothing else settles which of the rows of equal keys comes first.
    """
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    ranked = hashed_row_number(rows, hashed(seed, key), [F.col("__at")], [label], "__rn")
    return saved(ranked.withColumn("fold", ((F.col("__rn") - 1) % folds).cast("int")).drop("__at", "__rn"), "folds")
