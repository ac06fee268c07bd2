"""Detections: geometry gates, non-maximum suppression, mask votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.operators.graph import connected_components


def geometry_gate(d: DataFrame, area: tuple = (1, 40), length: tuple = (2, 15), width: float = 2, aspect: float = 2, solidity: float = 0.3) -> DataFrame:
    """Detections whose bounding box has the shape of a log."""
    w, h = F.col("width"), F.col("height")
    long, short = F.greatest(w, h), F.least(w, h)
    return d.filter((w * h).between(*area) & long.between(*length) & (short <= width) & (long / short >= aspect) & (F.col("solidity") >= solidity))


def iou(a: str, b: str) -> Column:
    ix = F.least(f"{a}.maxx", f"{b}.maxx") - F.greatest(f"{a}.minx", f"{b}.minx")
    iy = F.least(f"{a}.maxy", f"{b}.maxy") - F.greatest(f"{a}.miny", f"{b}.miny")
    inter = F.greatest(ix, F.lit(0.0)) * F.greatest(iy, F.lit(0.0))
    area = lambda x: (F.col(f"{x}.maxx") - F.col(f"{x}.minx")) * (F.col(f"{x}.maxy") - F.col(f"{x}.miny"))
    return inter / (area(a) + area(b) - inter)


def overlapping_pairs(d: DataFrame, cell: float, group: str, key: str = "id", least: float = 0.4) -> DataFrame:
    """Pairs (a, b) of one group whose boxes' IoU exceeds ``least``.

    Boxes are sent to the grid cells they touch and meet by equality of cell; a pair counts in the
    cell of its intersection's lower corner only, so no pair comes twice.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    placed = d.select(group, F.struct(key, "minx", "miny", "maxx", "maxy").alias("box"), cells("minx", "maxx").alias("cx"), "miny", "maxy").withColumn("cy", cells("miny", "maxy"))
    a = placed.select(group, "cx", "cy", F.col("box").alias("p"))
    b = placed.select(group, "cx", "cy", F.col("box").alias("q"))
    home = (F.floor(F.greatest("p.minx", "q.minx") / cell) == F.col("cx")) & (F.floor(F.greatest("p.miny", "q.miny") / cell) == F.col("cy"))
    return a.join(b, [group, "cx", "cy"]).filter((F.col(f"p.{key}") < F.col(f"q.{key}")) & home & (iou("p", "q") > least)).select(F.col(f"p.{key}").alias("a"), F.col(f"q.{key}").alias("b"))


def non_maximum_suppression(d: DataFrame, cell: float, group: str, least: float = 0.4) -> DataFrame:
    """Boxes left by greedy suppression: highest confidence first, smallest id at ties.

    The greedy result is the only set in which a box stays exactly if no better box that stays overlaps
    it. It is found in rounds over the overlap pairs alone: a box without an undecided better neighbour
    stays, and its worse neighbours go. Rounds are as many as the longest falling chain, and each ends
    in a checkpoint.
    """
    from canopyframe.plans.lineage import cut

    conf = d.select(F.col("id"), F.col("confidence"))
    pairs = overlapping_pairs(d, cell, group, least=least)
    named = pairs.join(conf.select(F.col("id").alias("a"), F.col("confidence").alias("ca")), "a").join(conf.select(F.col("id").alias("b"), F.col("confidence").alias("cb")), "b")
    first = (F.col("ca") > F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b")))
    left = cut(named.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")))
    gone = None
    while left.limit(1).count():
        tops = left.select(F.col("better").alias("id")).distinct().join(left.select(F.col("worse").alias("id")).distinct(), "id", "left_anti")
        lost = cut(left.join(tops.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
        gone = lost if gone is None else gone.union(lost)
        out = left.join(lost.withColumnRenamed("id", "better"), "better", "left_anti")
        left = cut(out.join(lost.withColumnRenamed("id", "worse"), "worse", "left_anti"))
    return d if gone is None else d.join(gone, "id", "left_anti")


def merge_masks(pixels: DataFrame, least: float = 0.3) -> DataFrame:
    """Overlapping masks (mask, pixel, confidence) merged by confidence-weighted vote.

    Masks whose pixel IoU exceeds ``least`` fall into one cluster; a pixel stays if the masks that hold
    it have over half of its cluster's confidence.
    """
    size = pixels.groupBy("mask").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    both = pixels.select("pixel", F.col("mask").alias("a")).join(pixels.select("pixel", F.col("mask").alias("b")), "pixel").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    linked = both.join(size.select(F.col("mask").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("mask").alias("b"), F.col("n").alias("nb")), "b").filter(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")) > least)
    groups = size.join(connected_components(linked.select("a", "b")).withColumnRenamed("node", "mask"), "mask", "left").select("mask", "confidence", F.coalesce("component", "mask").alias("cluster"))
    total = groups.groupBy("cluster").agg(F.sum("confidence").alias("total"))
    votes = pixels.select("mask", "pixel").join(groups, "mask").groupBy("cluster", "pixel").agg(F.sum("confidence").alias("votes"))
    return votes.join(total, "cluster").filter(F.round(F.col("votes") / F.col("total"), 9) > 0.5).select("cluster", "pixel")
