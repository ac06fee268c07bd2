"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins on the edge list, so nothing is gathered per
component; a hub's edges are split by AQE's skew join. The number of rounds grows with the
logarithm of the longest path. Every round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.plans.lineage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    if large:
        rows = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        mins = rows.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        out = rows.filter("b > a").join(mins, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()
    mins = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    rows = edges.join(mins, F.col("a") == F.col("k"))
    out = rows.select(F.col("b").alias("x"), "m").union(mins.select(F.col("k").alias("x"), "m"))
    return out.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", *, known_stars: bool = False) -> DataFrame:
    """``(node, component)`` for every end of an edge; component is its smallest reachable node.

    Rows with a null end are left out; self-loops give a node of its own; repeated edges count once.
    An empty edge table gives an empty result. Ends may be of any orderable type but must share it.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = cut(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    alone = pairs.filter("a = b").select(F.col("a").alias("node"))
    now = pairs.filter("a <> b")

    def state(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = state(now)
    while before[0] and not known_stars:
        now = cut(_star(_star(now, True), False))
        after = state(now)
        if after == before:
            break
        before = after
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    linked = members.union(roots)
    rest = alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.union(rest)
