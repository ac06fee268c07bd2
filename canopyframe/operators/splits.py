"""Spatial train/validation/test splits, their buffers, and leak checks.

Choices that depend on order (greedy filling of a target) run on block counts, never on rows: a group
of blocks is a place or a raster, and the table of roles is joined back to chips.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.functions import keys as K
from canopyframe.operators import spatial
from canopyframe.operators.graph import connected_components
from canopyframe.plans.lineage import cut
from canopyframe.plans.ranking import global_row_number


def hashed(seed: str, *cols: str | Column) -> Column:
    """Order of rows by md5, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def place_registry(candidates: DataFrame) -> DataFrame:
    """One row per place: rows, years, counts by label and by reason."""
    return candidates.groupBy("place_key", "grid_x", "grid_y").agg(
        F.count("*").alias("rows"),
        F.array_sort(F.collect_set("year")).alias("years"),
        F.count_if(F.col("label") == "cdw").alias("cdw"),
        F.count_if(F.col("label") == "no_cdw").alias("no_cdw"),
        F.count_if(F.col("reason") == "manual_or_reviewed").alias("manual"),
        F.count_if(F.col("reason") == "threshold_gate").alias("gate"),
    )


def block_of(size: int) -> list[Column]:
    """Block of a place; one without grid numbers gets an isolated pseudo-block from its CRC32."""
    h = F.crc32("place_key")
    return [F.coalesce(F.floor(F.col("grid_x") / size), 10_000_000 + h % 10000).alias("bx"), F.coalesce(F.floor(F.col("grid_y") / size), 10_000_000 + F.floor(h / 10000) % 10000).alias("by")]


def fill_sizes(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many blocks of each size are picked greedily: each time one of the size that brings the sum
    nearest the target, the larger at ties, until the target is reached or nothing is left."""
    left, sizes, picked, total = dict(counts), sorted(counts), dict.fromkeys(counts, 0), 0
    while sizes and total < target:
        at = bisect_right(sizes, target - total)
        around = sizes[max(at - 1, 0) : at + 1]
        best = min(around, key=lambda s: (abs(target - total - s), -s))
        # while one more still falls short of the target, it stays the largest that fits
        many = min(left[best], max(1, (target - total) // best)) if best and best <= target - total and at == len(sizes) else 1
        picked[best] += many
        left[best] -= many
        total += many * best
        if not left[best]:
            sizes.remove(best)
    return {s: n for s, n in picked.items() if n}


def best_swap(classes: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """The exchange of one picked for one other block that brings the picked share of cdw nearest that of
    all, if it is off by more than ``tolerance``; ties by n and cdw of the one that goes, then of the other.

    ``classes`` has a row for each n, cdw and picked, with the count ``c`` and its first block.
    """
    rows = classes.sort_values(["n", "cdw"])
    n, cdw, c = (rows[k].to_numpy(float) for k in ("n", "cdw", "c"))
    inside = rows["picked"].to_numpy(bool)
    share = (cdw * c).sum() / max(1.0, (n * c).sum())
    size, hits = (n * c)[inside].sum(), (cdw * c)[inside].sum()
    now = abs(hits / max(1.0, size) - share)
    goes, comes = np.flatnonzero(inside), np.flatnonzero(~inside)
    if now <= tolerance or not len(goes) or not len(comes):
        return rows.iloc[:0]
    off = np.abs((hits - cdw[goes][:, None] + cdw[comes]) / np.maximum(1.0, size - n[goes][:, None] + n[comes]) - share)
    a, b = np.unravel_index(int(off.argmin()), off.shape)
    return rows.iloc[[goes[a], comes[b]]] if off[a, b] < now else rows.iloc[:0]


def greedy_blocks(blocks: DataFrame, group: list[str], fraction: float, seed: str, *, tolerance: float = 1.0, target: str | None = None) -> DataFrame:
    """Test blocks of each group: ``group, bx, by``; blocks come with n and cdw.

    The rows to reach are ``fraction`` of the group's, or what its blocks say in the column ``target``.

    Only counts of blocks by size (and for the exchange by size and cdw) go through a Python function; of
    equal sizes the first in hashed order are taken, by row numbers over the whole table. If the test
    share of cdw is off by more than ``tolerance``, the single exchange of blocks that helps most is made.
    """
    own = group or ["__all"]
    ordered = blocks.withColumn("h", hashed(seed, *group, "bx", "by"))
    if not group:
        ordered = ordered.withColumn("__all", F.lit(1))
    of = {c: ordered.schema[c].dataType.simpleString() for c in [*own, "n"]}
    aim = F.max(F.col(target) if target else F.lit(None).cast("long")).alias("__aim")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(pdf["n"].astype(int), pdf["c"].astype(int)))
        share = max(1, round(sum(s * k for s, k in counts.items()) * fraction))
        picked = fill_sizes(counts, int(pdf["__aim"].max()) if target else share)
        out = pd.DataFrame({"n": list(picked), "take": list(picked.values())})
        return out.assign(**{c: pdf[c].iloc[0] for c in own})[[*own, "n", "take"]]

    takes = ordered.groupBy(*own, "n").agg(F.count("*").alias("c"), aim).groupBy(*own).applyInPandas(fill, ", ".join(f"{c} {k}" for c, k in of.items()) + ", take long")
    rows = global_row_number(ordered, [F.col("h"), F.col("bx"), F.col("by")], [*own, "n"])
    rows = rows.join(takes, [*own, "n"], "left").withColumn("picked", F.coalesce(F.col("rn") <= F.col("take"), F.lit(False))).drop("rn", "take")
    if tolerance < 1:  # no two shares differ by more than one
        rows = cut(rows)
        classes = rows.groupBy(*own, "n", "cdw", "picked").agg(F.count("*").alias("c"), F.min(F.struct("h", "bx", "by")).alias("f"))
        classes = classes.select(*own, "n", "cdw", "picked", "c", F.col("f.bx").alias("bx"), F.col("f.by").alias("by"))
        change = classes.groupBy(*own).applyInPandas(lambda pdf: best_swap(pdf, tolerance), classes.schema)
        change = change.select(*own, "bx", "by", F.lit(True).alias("__change"))
        rows = rows.join(change, [*own, "bx", "by"], "left").withColumn("picked", F.col("picked") != F.coalesce("__change", F.lit(False)))
    return rows.filter("picked").select(*group, "bx", "by")


def block_split(places: DataFrame, *, block: int = 2, ring: int = 1, fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """Places with role test, buffer (in a block within ``ring`` of a test block) or train."""
    p = places.select("*", *block_of(block))
    blocks = p.groupBy("bx", "by").agg(F.sum("rows").alias("n"), F.sum("cdw").alias("cdw"))
    test = greedy_blocks(blocks, [], fraction, seed)
    roles = _ring_roles(p.select("bx", "by").distinct(), test, [], ring)
    return p.join(roles, ["bx", "by"]).drop("bx", "by")


def _ring_roles(cells: DataFrame, test: DataFrame, group: list[str], ring: int) -> DataFrame:
    """Role of each cell: test, buffer or train."""
    key = [*group, "bx", "by"]
    marked = cells.join(test.select(*key).withColumn("__t", F.lit(True)), key, "left")
    near = spatial.within_grid(cells, test, group, "bx", "by", ring).withColumn("__b", F.lit(True))
    rows = marked.join(near, key, "left")
    return rows.select(*key, F.when(F.col("__t"), "test").when(F.col("__b"), "buffer").otherwise("train").alias("role"))


def distance_split(places: DataFrame, *, radius: int = 1, fraction: float = 0.2, val_fraction: float = 0.1, regions: int = 3, seed: str = "42", assign: Callable[[DataFrame, int, str], DataFrame] | None = None) -> DataFrame:
    """Places split by distance, with ``region`` and ``role``: test, val, buffer or train.

    Places fall into regions (integer k-means, unless ``assign`` says otherwise). Of each region a share of
    the rows goes to test, and places within Chebyshev ``radius`` of test are buffer. What is left goes to val
    by each region's share of the rest, with a buffer of its own, and else to train. With a
    ``val_fraction`` of 0 there is no val.
    """
    rows = cut((assign or lloyd)(places, regions, seed))
    cells = rows.select("region", F.col("grid_x").alias("bx"), F.col("grid_y").alias("by"), F.col("rows").alias("n"), "cdw").groupBy("region", "bx", "by").agg(F.sum("n").alias("n"), F.sum("cdw").alias("cdw"))

    total = rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def share(pool: DataFrame, aim: float, name: str) -> DataFrame:
        """Cells of ``pool`` that fill ``aim`` of all rows, dealt to regions by their rows in the pool."""
        per = pool.groupBy("region").agg(F.sum("n").alias("__n"))
        within = per.agg(F.sum("__n").alias("__all"))  # one row
        goal = F.bround(F.lit(max(1, round(total * aim))) * F.col("__n") / F.col("__all")).cast("long")
        per = per.join(F.broadcast(within), F.col("__all").isNotNull()).select("region", goal.alias("__goal"))
        return cut(greedy_blocks(pool.join(per, "region"), ["region"], aim, name, target="__goal").select("bx", "by"))

    def near(pool: DataFrame, picked: DataFrame) -> DataFrame:
        return spatial.within_grid(pool, picked, [], "bx", "by", radius)

    spots = cells.select("bx", "by").distinct()
    test = share(cells, fraction, seed)
    around = near(spots, test)  # with test itself
    rest = cells.join(around, ["bx", "by"], "left_anti")
    val = share(rest, val_fraction, f"{seed}v") if val_fraction > 0 else test.limit(0)
    beside = near(rest.select("bx", "by").distinct(), val)
    mark = lambda df, name: df.select("bx", "by", F.lit(True).alias(name))
    roles = spots
    for df, name in ((test, "t"), (around, "a"), (val, "v"), (beside, "b")):
        roles = roles.join(mark(df, name), ["bx", "by"], "left")
    role = F.when(F.col("t"), "test").when(F.col("a"), "buffer").when(F.col("v"), "val").when(F.col("b"), "buffer").otherwise("train")
    roles = roles.select(F.col("bx").alias("grid_x"), F.col("by").alias("grid_y"), role.alias("role"))
    return rows.join(roles, ["grid_x", "grid_y"])


def cluster_split(rows: DataFrame, *, size: int = 3, guard: int = 1, fraction: float = 0.2, val_fraction: float = 0.1, tolerance: float = 0.05, tries: int = 10, seed: str = "2026") -> DataFrame:
    """Curated rows with ``attempt``, ``role`` (test, val, guard, train or none), ``is_manual`` and ``is_pseudo``.

    Clusters are blocks of ``size`` places. Each attempt picks test clusters, lays a ring of ``guard`` blocks
    around them, and picks val clusters from the rest, whose share grows with what test has taken. The
    first attempt whose test and val rows have a share of cdw within ``tolerance`` of all rows' counts, or
    else the one whose larger deviation is least. Places in a ring of test or val are guard. Train are the other
    places' manual rows and those of a hard band of probabilities; ``is_manual`` marks manual rows outside of
    test, val and guard, ``is_pseudo`` the rows of the pseudo-label pool wherever they are. All attempts run in
    one job, on places and blocks with the attempt as a group.
    """
    places = cut(place_registry(rows))
    tried = places.select("place_key", F.col("rows").alias("n"), "cdw", *block_of(size), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
    key = ["attempt", "bx", "by"]
    blocks = cut(tried.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("cdw").alias("cdw")))
    test = cut(greedy_blocks(blocks, ["attempt"], fraction, seed))
    ring = spatial.within_grid(blocks, test, ["attempt"], "bx", "by", guard).select(*key)
    rest = blocks.join(ring, key, "left_anti")
    sizes = blocks.groupBy("attempt").agg(F.sum("n").alias("all")).join(blocks.join(test, key, "left_semi").groupBy("attempt").agg(F.sum("n").alias("tested")), "attempt")
    left = rest.groupBy("attempt").agg(F.sum("n").alias("rest")).join(sizes, "attempt")
    scaled = F.least(F.lit(0.9), val_fraction / F.greatest(F.lit(1e-9), 1 - F.col("tested") / F.col("all")))
    left = left.select("attempt", F.greatest(F.lit(1), F.bround(F.col("rest") * scaled).cast("long")).alias("__goal"))
    val = cut(greedy_blocks(rest.join(left, "attempt"), ["attempt"], val_fraction, f"{seed}v", target="__goal"))

    beside = spatial.within_grid(blocks, val, ["attempt"], "bx", "by", guard).select(*key)
    marked = blocks
    for df, name in ((test, "t"), (val, "v"), (ring.union(beside).distinct(), "g")):
        marked = marked.join(df.select(*key, F.lit(True).alias(name)), key, "left")
    zone = F.when(F.col("t"), "test").when(F.col("v"), "val").when(F.col("g"), "guard").otherwise("train")
    zones = cut(marked.select(*key, "n", "cdw", zone.alias("zone")))

    share = lambda z: F.sum(F.when(F.col("zone") == z, F.col("cdw"))) / F.sum(F.when(F.col("zone") == z, F.col("n")))
    every = F.sum("cdw") / F.sum("n")
    off = zones.groupBy("attempt").agg(F.greatest(*[F.coalesce(F.abs(share(z) - every), F.lit(2.0)) for z in ("test", "val")]).alias("off"))
    order = F.when(F.col("off") <= tolerance, F.lit(0.0)).otherwise(F.col("off"))
    chosen = off.agg(F.min(F.struct(order.alias("o"), "attempt")).alias("m")).select(F.col("m.attempt").alias("attempt"))
    of = tried.join(zones, key).join(F.broadcast(chosen), "attempt").select("place_key", "attempt", "zone")  # one row

    p, manual = F.col("model_prob"), F.coalesce(K.is_manual(), F.lit(False))
    hard = F.coalesce(p.between(0.05, 0.30) | p.between(0.70, 0.95), F.lit(False))
    free = F.col("zone") == "train"
    role = F.when(~free, F.col("zone")).when(manual | hard, "train").otherwise("none")
    pseudo = ~manual & F.coalesce((p >= 0.95) | (p <= 0.05), F.lit(False))
    return rows.join(of, "place_key").withColumn("role", role).withColumn("is_manual", free & manual).withColumn("is_pseudo", pseudo).drop("zone")


def cluster_keys(split: DataFrame) -> DataFrame:
    """``list, raster, row_off, col_off``: the distinct keys of the test, val, train, manual and pseudo lists."""
    name = lambda c, n: F.when(c, n)
    lists = F.array_compact(F.array(name(F.col("role").isin("test", "val", "train"), F.col("role")), name(F.col("is_manual"), "manual"), name(F.col("is_pseudo"), "pseudo")))
    return split.select(F.explode(lists).alias("list"), "raster", "row_off", "col_off").distinct()


def kmeans_regions(places: DataFrame, k: int, seed: str) -> DataFrame:
    """``region`` of each place by Spark ML's k-means over grid numbers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=["grid_x", "grid_y"], outputCol="__f").transform(places)
    model = KMeans(k=k, seed=sum(map(ord, seed)), featuresCol="__f", predictionCol="region").fit(made)
    return model.transform(made).drop("__f")


def lloyd(points: DataFrame, k: int, seed: str, x: str = "grid_x", y: str = "grid_y", rounds: int = 20) -> DataFrame:
    """Integer-centroid k-means: starts at the k distinct points first in hashed order, rounds half even.

    Each round is one aggregation to k rows; the centroids, k pairs of numbers, pass through the driver.
    """
    distinct = points.groupBy(x, y).agg(F.count("*").alias("w"))
    centres = [(r[x], r[y]) for r in distinct.orderBy(hashed(seed, x, y)).limit(k).collect()]

    def nearest() -> Column:
        d = [F.pow(F.col(x) - a, F.lit(2.0)) + F.pow(F.col(y) - b, F.lit(2.0)) for a, b in centres] or [F.lit(0.0)]  # none of an empty table
        best = F.least(*d) if len(d) > 1 else d[0]
        return F.coalesce(*[F.when(c == best, F.lit(i)) for i, c in enumerate(d)])

    for _ in range(rounds):
        means = distinct.groupBy(nearest().alias("c")).agg(F.bround(F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias("a"), F.bround(F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("b")).collect()
        new = list(centres)
        for r in means:
            new[r.c] = (int(r.a), int(r.b))
        if new == centres:
            break
        centres = new
    return points.withColumn("region", nearest())


def infer_stride(chips: DataFrame) -> DataFrame:
    """Greatest common divisor of all positive offsets, 64 if there is none: one row.

    Each round divides every value by the least one: the remainders and the least have the same divisor.
    Values below the least halve it at worst every other round, so rounds grow with its logarithm, and a
    round passes distinct values only, which its partial aggregates have already thinned.
    """
    values = chips.select(F.explode(F.array(F.col("row_off").cast("long"), F.col("col_off").cast("long"))).alias("v")).filter("v > 0").distinct()
    low = values.agg(F.min("v").alias("lo")).first()["lo"]
    while low is not None:
        values = cut(values.select((F.col("v") % low).alias("v")).filter("v > 0").distinct())
        least = values.agg(F.min("v")).first()[0]
        if least is None:
            break
        values, low = values.union(chips.sparkSession.createDataFrame([(low,)], "v long")), least
    return chips.sparkSession.createDataFrame([(int(low or 64),)], "stride int")


def gap_pixels(buffer_strides: Column, stride: Column, chunk: Column) -> Column:
    return (buffer_strides + 1) * stride - chunk


def chip_split(chips: DataFrame, *, stride: int = 64, blocks: int = 3, per_dim: int = 8, buffer_strides: int = 1, fraction: float = 0.2, tolerance: float = 0.2, seed: str = "42", group: str = "place_key") -> DataFrame:
    """Chips with a role: test blocks are chosen per ``group`` over all its years, with a buffer around test chips.

    With ``group`` the raster, years may differ; with the place they share test positions.
    """
    side = max(1, per_dim // blocks)
    rows = chips.withColumn("cr", F.floor(F.col("row_off") / stride)).withColumn("cc", F.floor(F.col("col_off") / stride))
    rows = rows.withColumn("bx", F.least(F.floor(F.col("cr") / side), F.lit(blocks - 1))).withColumn("by", F.least(F.floor(F.col("cc") / side), F.lit(blocks - 1)))
    counted = rows.groupBy(group, "bx", "by").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "cdw").alias("cdw"))
    test = greedy_blocks(counted, [group], fraction, seed, tolerance=tolerance).withColumn("__t", F.lit(True))
    places = rows.select(group, "cr", "cc", "bx", "by").distinct().join(test, [group, "bx", "by"], "left")
    near = spatial.within_grid(places.select(group, "cr", "cc"), places.filter("__t"), [group], "cr", "cc", buffer_strides).distinct().withColumn("__b", F.lit(True))
    roles = places.join(near, [group, "cr", "cc"], "left").select(group, "cr", "cc", F.when(F.col("__t"), "test").when(F.col("__b"), "buffer").otherwise("train").alias("role"))
    return rows.join(roles, [group, "cr", "cc"]).drop("cr", "cc", "bx", "by")


def zone_split(chips: DataFrame, *, test_share: float = 0.1, val_share: float = 0.1, seed: str = "42", stride: int = 64, ring: int = 2, buffer_to_train: bool = False) -> DataFrame:
    """Map-sheet zones: hashed seeds become 3x3 test zones with a buffer ring, then val zones outside both,
    then train without mid confidence. Positions are shared by all years of a sheet.

    ``buffer_to_train`` lets buffer chips fall into train, as the method was first written.
    """
    rows = chips.withColumn("cr", F.floor(F.col("row_off") / stride).cast("int")).withColumn("cc", F.floor(F.col("col_off") / stride).cast("int"))
    spots = rows.select("tile", "cr", "cc").distinct()
    u = F.conv(F.substring(hashed(seed, "tile", "cr", "cc"), 1, 8), 16, 10).cast("long") % 10000
    spots = spots.withColumn("u", u)

    def grown(seeds: DataFrame, radius: int) -> DataFrame:
        return spatial.within_grid(spots, seeds, ["tile"], "cr", "cc", radius).select("tile", "cr", "cc")

    def marked(df: DataFrame, zone: DataFrame, name: str) -> DataFrame:
        return df.join(zone.withColumn(name, F.lit(True)), ["tile", "cr", "cc"], "left")

    seeds = spots.filter(F.col("u") < int(test_share * 10000))
    test, buffer = grown(seeds, 1), grown(seeds, 1 + ring)
    vseeds = spots.filter((F.col("u") >= 10000 - int(val_share * 10000))).join(buffer, ["tile", "cr", "cc"], "left_anti")
    out = marked(marked(marked(spots, test, "t"), buffer, "b"), grown(vseeds, 1), "v")
    zone = F.when(F.col("t"), "test").when(F.col("b"), "buffer").when(F.col("v"), "val").otherwise("train")
    roles = out.select("tile", "cr", "cc", zone.alias("zone"))
    train = F.coalesce(F.col("source").isin("manual", "auto_skip") | (F.col("model_prob") > 0.95) | (F.col("model_prob") < 0.05), F.lit(False))
    if buffer_to_train:
        role = F.when(F.col("zone").isin("test", "val"), F.col("zone")).when(train, "train").otherwise("none")
    else:
        role = F.when(F.col("zone") != "train", F.col("zone")).when(train, "train").otherwise("none")
    return rows.join(roles, ["tile", "cr", "cc"]).withColumn("role", role).drop("cr", "cc", "zone")


def bisection_split(tiles: DataFrame, *, buffer_m: float = 20.0, val_percent: int = 20, seed: str = "42") -> DataFrame:
    """Per map sheet: the longer axis is cut at its middle, the side with fewer rows is the test candidate,
    rows within the buffer of the cut go; places in test are pruned from train, and val is taken by place."""
    ends = tiles.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    wide = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
    ends = cut(ends.select("tile", wide.alias("wide"), F.when(wide, (F.col("x0") + F.col("x1")) / 2).otherwise((F.col("y0") + F.col("y1")) / 2).alias("mid")))
    axis = F.when(F.col("wide"), F.col("x")).otherwise(F.col("y"))
    placed = tiles.join(ends, "tile").withColumn("side", (axis > F.col("mid")).cast("int")).withColumn("near", F.abs(axis - F.col("mid")) <= buffer_m)
    sides = placed.groupBy("tile").agg(F.when(2 * F.sum("side") <= F.count("*"), 1).otherwise(0).alias("test_side"))
    rows = placed.join(sides, "tile").withColumn("role", F.when(F.col("near"), "buffer").when(F.col("side") == F.col("test_side"), "test").otherwise("train"))
    tested = rows.filter("role = 'test'").select("place").distinct().withColumn("__t", F.lit(True))
    rows = rows.join(tested, "place", "left")
    val = F.conv(F.substring(hashed(seed, "place"), 1, 8), 16, 10).cast("long") % 100 < val_percent
    role = F.when((F.col("role") == "train") & F.col("__t"), "pruned").when((F.col("role") == "train") & val, "val").otherwise(F.col("role"))
    return rows.withColumn("role", role).drop("wide", "mid", "side", "near", "test_side", "__t")


def fence_id(metres: float, pixels: int) -> Column:
    """Cell of map coordinates where there are any, else of pixel offsets within the raster."""
    by_map = F.concat(F.lit("m"), F.floor(F.col("x") / metres).cast("string"), F.lit("_"), F.floor(F.col("y") / metres).cast("string"))
    by_px = F.concat(F.lit("p"), F.col("raster"), F.lit("_"), F.floor(F.col("row_off") / pixels).cast("string"), F.lit("_"), F.floor(F.col("col_off") / pixels).cast("string"))
    return F.coalesce(by_map, by_px)


def grouped_folds(df: DataFrame, group: Column, folds: int, seed: str) -> DataFrame:
    """Fold of each row by its group's hash; a group is never split."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), group)), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (h % folds).cast("int"))


def size_ordered_folds(groups: DataFrame, key: str, size: str, folds: int) -> DataFrame:
    """Groups dealt to folds by falling size, back and forth (snake order); ties by key."""
    rows = global_row_number(groups.select(key, size), [F.desc(size), F.asc(key)])
    at = (F.col("rn") - 1) % (2 * folds)
    return rows.withColumn("fold", F.when(at < folds, at).otherwise(2 * folds - 1 - at).cast("int")).drop("rn")


def instance_split(instances: DataFrame, key: str, seed: str, cuts: tuple[int, int] = (70, 85)) -> DataFrame:
    """Split of each instance group by hash cut points in per cent."""
    u = F.conv(F.substring(hashed(seed, key), 1, 8), 16, 10).cast("long") % 100
    return instances.withColumn("split", F.when(u < cuts[0], "train").when(u < cuts[1], "val").otherwise("test"))


def probe_block_sizes(df: DataFrame, candidates: list[float], folds: int, seed: str) -> DataFrame:
    """For each candidate fence size: groups, relative spread of fold sizes, spread of positive rates, score.

    One pass: every row is exploded to its fence under each candidate.
    """
    cand = F.explode(F.lit([float(c) for c in candidates]))
    rows = df.select("x", "y", "label", cand.alias("block"))
    group = F.concat_ws("_", F.floor(F.col("x") / F.col("block")).cast("string"), F.floor(F.col("y") / F.col("block")).cast("string"))
    g = rows.groupBy("block", group.alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "cdw").alias("p"))
    f = grouped_folds(g, F.concat_ws("|", F.col("block").cast("int").cast("string"), "g"), folds, seed).groupBy("block", "fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count("*").alias("groups"))
    s = f.groupBy("block").agg(F.sum("groups").alias("groups"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("size_cv"), F.round(F.stddev_pop(F.col("p") / F.col("n")), 6).alias("rate_std"), F.min("p").alias("min_pos"))
    return s.withColumn("score", F.round(F.col("size_cv") + F.col("rate_std") + F.when(F.col("min_pos") <= 0, 1.0).otherwise(0.0), 6))


# leaks


def origin_leaks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are in more than one split."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def overlap_leaks(rows: DataFrame, group: list[str], size: float, key: str = "id") -> DataFrame:
    """Pairs of one group with overlapping rectangles in different splits, each pair once."""
    slim = rows.select(*group, key, "split", "minx", "miny", "maxx", "maxy")
    pairs = spatial.overlapping_rectangles(slim, slim, group, size).filter(F.col(f"a.{key}") < F.col(f"b.{key}"))
    return pairs.filter(F.col("a.split") != F.col("b.split")).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b"))


def remediate(rows: DataFrame, group: list[str], size: float, strategy: str = "prefer_test", key: str = "id") -> DataFrame:
    """``rows`` with one split for each component of overlapping rectangles."""
    slim = rows.select(*group, key, "split", "minx", "miny", "maxx", "maxy")
    pairs = spatial.overlapping_rectangles(slim, slim, group, size).filter(F.col(f"a.{key}") < F.col(f"b.{key}")).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))
    named = rows.join(connected_components(pairs).withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    n = {s: F.count_if(F.col("split") == s) for s in ("test", "val", "train")}
    per = named.groupBy("component").agg(*[c.alias(s) for s, c in n.items()])
    if strategy == "majority":
        top = F.greatest("test", "val", "train")
        new = F.when(F.col("test") == top, "test").when(F.col("val") == top, "val").otherwise("train")
    elif strategy == "prefer_val_test":
        new = F.when(F.col("val") > 0, "val").when(F.col("test") > 0, "test").otherwise("train")
    else:
        new = F.when(F.col("test") > 0, "test").when(F.col("val") > 0, "val").otherwise("train")
    return named.join(per.select("component", new.alias("new_split")), "component")


def touching_components(tiles: DataFrame, by: str, side: int = 1) -> DataFrame:
    """Mosaic groups: tiles of one ``by`` that touch, at corners too, in the integer grid x, y."""
    t = tiles.select(by, "x", "y", "tile").distinct()
    near = t.select(by, F.col("tile").alias("a"), "x", "y", spatial.shifted(side).alias("s")).select(by, "a", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    label = lambda c: F.concat_ws("|", F.col(by).cast("string"), c)
    edges = near.join(t.withColumnRenamed("tile", "b"), [by, "x", "y"]).select(label("a").alias("a"), label("b").alias("b"))
    parts = connected_components(edges).withColumn("year", F.split("node", r"\|")[0])
    return parts.select("year", F.split("node", r"\|")[1].alias("tile"), F.split("component", r"\|")[1].alias("component"))
