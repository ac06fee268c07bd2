"""Raster and tile operators over long pixel tables (tile_id, row, col, value; null is no data).

Windows are partitioned by tile and row or column, so a task holds lines of a tile, never a raster.
Focal operators are two passes of one-dimensional windows. Pixel tables are dense: a pixel without
data is a row with a null value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.plans.ranking import quantiles

PIXEL = ["tile_id", "row", "col"]


def along_row(*, by: str = "tile_id"):
    return Window.partitionBy(by, "row").orderBy("col")


def along_col(*, by: str = "tile_id"):
    return Window.partitionBy(by, "col").orderBy("row")


def nodata_share(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("tile_id").agg((100.0 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("nodata_pct"))


def summary(pixels: DataFrame, by: list[str]) -> DataFrame:
    v = F.col("value")
    return pixels.groupBy(*by).agg(
        F.count(v).alias("valid"),
        F.count_if(v.isNull()).alias("nodata"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev_pop(v), 6).alias("std"),
        F.round(F.percentile(v, F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"),
        F.round(F.percentile(v, F.lit(0.99)), 6).alias("p99"),
    )


def rounded(c: Column) -> Column:
    """Six digits; a mean that lies on a tie goes up whatever the order of its sum."""
    return F.round(c + 1e-9, 6)


# chips


def offsets(size: Column, chunk: int, overlap: float = 0.5, *, cover: bool = False) -> Column:
    """Chip offsets along one axis.

    The border chip comes if more than a quarter chip is left uncovered or, with ``cover``, always.
    """
    stride = max(1, int(chunk * (1 - overlap)))
    regular = F.sequence(F.lit(0), F.greatest(size - chunk, F.lit(0)), F.lit(stride))
    border = size - chunk
    gap = border - F.element_at(regular, -1)
    add = (gap > 0) if cover else (gap > chunk // 4)
    return F.when(size <= chunk, F.array(F.lit(0))).when(add, F.array_append(regular, border)).otherwise(regular)


def chip_index(rasters: DataFrame, chunk: int, overlap: float = 0.5, *, cover: bool = False) -> DataFrame:
    """``rasters`` (with height and width) exploded into chips with row_off and col_off."""
    rows = rasters.withColumn("row_off", F.explode(offsets(F.col("height"), chunk, overlap, cover=cover)))
    return rows.withColumn("col_off", F.explode(offsets(F.col("width"), chunk, overlap, cover=cover)))


def chip_centre(resolution: float = 0.2, chunk: int = 128) -> list[Column]:
    """Map centre of a chip on a square-kilometre sheet with bounds minx and maxy."""
    x = F.col("minx") + (F.col("col_off") + chunk / 2) * resolution
    y = F.col("maxy") - (F.col("row_off") + chunk / 2) * resolution
    return [x.alias("centre_x"), y.alias("centre_y")]


# windows


def focal(df: DataFrame, column: str, f, radius: int, name: str) -> DataFrame:
    """Square focal ``f`` (F.min or F.max, which ignore nulls); windows end at the edges."""
    one = f(column).over(along_row().rowsBetween(-radius, radius))
    two = f("__f").over(along_col().rowsBetween(-radius, radius))
    return df.withColumn("__f", one).withColumn(name, two).drop("__f")


def by_tile(pixels: DataFrame) -> DataFrame:
    """Pixels dealt by tile once, for operators whose windows go both along rows and along columns.

    Windows then sort within a task and shuffle no more. A task holds whole tiles on disk or in memory as
    its sorts spill; cut a raster into chips first if one of them is too much for a task.
    """
    return pixels.repartition("tile_id")


def filled(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.coalesce("value", F.lit(0.0)))


def gradients(df: DataFrame, v: str = "v") -> DataFrame:
    """Absolute differences gr (down), gc (right), d45 and d135; null beyond the edge."""
    df = df.withColumn("__down", F.lead(v).over(along_col()))
    df = df.withColumn("gr", F.abs(F.col("__down") - F.col(v))).withColumn("gc", F.abs(F.lead(v).over(along_row()) - F.col(v)))
    df = df.withColumn("d45", F.abs(F.lead("__down").over(along_row()) - F.col(v))).withColumn("d135", F.abs(F.lag("__down").over(along_row()) - F.col(v)))
    return df.drop("__down")


def feature_bank(pixels: DataFrame) -> DataFrame:
    """24 features per tile: moments, quantiles, gradients, Laplacian, top-hat and ridgeness.

    Windows alternate between columns and rows five times, each time a sort within the task: square minima and
    maxima are taken along one axis, then the other, in whichever order the passes come.
    """
    row, col, v = along_row(), along_col(), F.col("v")
    near = lambda w: w.rowsBetween(-1, 1)
    df = filled(by_tile(pixels)).withColumns({"down": F.lead("v").over(col), "up": F.lag("v").over(col)})
    around = [F.coalesce(c, v) for c in (F.lag("v").over(row), F.col("up"), F.lead("v").over(row), F.col("down"))]
    steps = {"gr": F.col("down"), "gc": F.lead("v").over(row), "d45": F.lead("down").over(row), "d135": F.lag("down").over(row)}
    df = df.withColumns({**{g: F.abs(c - v) for g, c in steps.items()}, "lap": around[0] + around[1] + around[2] + around[3] - 4 * v, "low": F.min("v").over(near(row))})
    df = df.withColumns({"eroded": F.min("low").over(near(col)), "steep": F.max(F.abs("lap")).over(near(col))})
    df = df.withColumns({"wide": F.max("eroded").over(near(row)), "ridge": F.max("steep").over(near(row))})
    df = df.withColumn("tophat", v - F.max("wide").over(near(col)))
    r = lambda c, name: rounded(c).alias(name)
    aggs = [r(F.avg("v"), "mean"), r(F.stddev_pop("v"), "std"), r(F.min("v"), "min"), r(F.max("v"), "max")]
    aggs += [r(F.percentile("v", F.lit(q / 100)), f"q{q}") for q in (10, 25, 50, 75, 90)]
    aggs.append(r(F.avg(F.when(F.col("v") <= 1e-6, 1.0).otherwise(0.0)), "zero_share"))
    for g in ("gr", "gc", "d45", "d135"):
        aggs += [r(F.avg(g), f"{g}_mean"), r(F.stddev_pop(g), f"{g}_std")]
    aggs += [r(F.avg("lap"), "lap_mean"), r(F.var_pop("lap"), "lap_var")]
    for g in ("tophat", "ridge"):
        aggs += [r(F.avg(g), f"{g}_mean"), r(F.stddev_pop(g), f"{g}_std")]
    return df.groupBy("tile_id").agg(*aggs)


BANDS = [0.15, 0.3, 0.5, 0.7, 0.9, 1.1, 1.2, 1.3]


def height_features(pixels: DataFrame, threshold: float = 0.15) -> DataFrame:
    """22 height-band features of a tile's valid pixels, and of those above the threshold."""
    v = F.col("value")
    above = F.when(v > threshold, v)
    w = Window.partitionBy("tile_id").orderBy("row", "col")
    rows = pixels.filter(v.isNotNull()).withColumn("__up", (v > threshold) & ~F.coalesce(F.lag(v > threshold).over(w), F.lit(True)))
    n = F.count("*")
    r = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    q = lambda p: F.percentile(above, F.lit(p))
    aggs = [r(F.count_if(v > b) / n, f"over_{k}") for k, b in enumerate(BANDS)]
    aggs += [r(q(p / 100), f"p{p}") for p in (10, 25, 50, 75, 90, 99)]
    aggs += [r(F.avg(above), "above_mean"), r(F.stddev_pop(above), "above_std"), r(F.max(above), "above_max"), r(F.count(above) / n, "above_share"), F.count_if("__up").alias("runs")]
    aggs.append(F.round(F.coalesce(q(0.75) / F.greatest(q(0.25), F.lit(0.01)), F.lit(1.0)), 6).alias("spread"))
    aggs += [r(F.count_if(v > 0.5) / n, "over_half"), r(F.count_if(v > 1.0) / n, "over_one")]
    return rows.groupBy("tile_id").agg(*aggs)


def geometric_score(pixels: DataFrame, low: float = 0.4, high: float = 1.1, edge: float = 0.1, least_valid: float = 0.5) -> DataFrame:
    """Share of strong gradients in the height band, less for saturated or mostly empty tiles."""
    df = pixels.withColumn("ok", F.coalesce(F.col("value") >= 0, F.lit(False))).withColumn("v", F.when(F.col("ok"), F.col("value")).otherwise(0.0))

    def slope(w) -> Column:
        back, on = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(back.isNull(), on - F.col("v")).when(on.isNull(), F.col("v") - back).otherwise((on - back) / 2)

    df = df.withColumn("dx", slope(along_row())).withColumn("dy", slope(along_col()))
    band = F.col("ok") & F.col("v").between(low, high)
    strong = band & (F.hypot("dx", "dy") > edge)
    g = df.groupBy("tile_id").agg((F.count_if("ok") / F.count("*")).alias("valid_frac"), (F.count_if(band) / F.greatest(F.count_if("ok"), F.lit(1))).alias("cwd_frac"), (F.count_if(strong) / F.greatest(F.count_if("ok"), F.lit(1))).alias("edge_frac"))
    sat = F.when(F.col("cwd_frac") < 0.4, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("cwd_frac") - 0.4) / 0.4))
    score = F.when(F.col("valid_frac") < least_valid, 0.0).otherwise(F.col("edge_frac") * sat * F.col("valid_frac"))
    return g.select("tile_id", *[F.round(c, 6).alias(c) for c in ("valid_frac", "cwd_frac", "edge_frac")], F.round(score, 6).alias("score"))


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _smooth(column: str, w, weights: list[float]) -> Column:
    """Weighted window sum; beyond the edges the edge value repeats."""
    radius = len(weights) // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(column).over(whole), F.last(column).over(whole)
    total = F.col(column) * weights[radius]
    for k in range(1, radius + 1):
        total = total + F.coalesce(F.lag(column, k).over(w), first) * weights[radius - k] + F.coalesce(F.lead(column, k).over(w), last) * weights[radius + k]
    return total


def masked_gaussian(pixels: DataFrame, sigma: float = 0.75) -> DataFrame:
    """Normalised convolution: data and mask are smoothed alike and divided."""
    weights = gaussian_weights(sigma)
    df = filled(pixels).withColumn("m", F.col("value").isNotNull().cast("double"))
    df = df.withColumn("sv", _smooth("v", along_row(), weights)).withColumn("sm", _smooth("m", along_row(), weights))
    df = df.withColumn("v", F.col("sv")).withColumn("m", F.col("sm"))
    df = df.withColumn("sv", _smooth("v", along_col(), weights)).withColumn("sm", _smooth("m", along_col(), weights))
    return df.select(*PIXEL, F.round(F.when(F.col("sm") > 1e-6, F.col("sv") / F.col("sm")), 6).alias("value"))


def bilinear(pixels: DataFrame, size: int, source: int = 8) -> DataFrame:
    """Tiles of ``source`` pixels a side resampled to ``size``; weights of null neighbours go to the others.

    Each source pixel is sent to the target pixels it weighs on, so resampling is one explode and one
    aggregation.
    """
    scale = source / size
    targets: dict[int, list[tuple[int, float]]] = {}
    for i in range(size):
        at = min(max((i + 0.5) * scale - 0.5, 0.0), source - 1.0)
        low = min(int(at), source - 1)
        high = min(low + 1, source - 1)
        for k, w in ((low, 1 - (at - low)), (high, at - low)):
            if w > 0:
                targets.setdefault(k, []).append((i, w))
    none = F.array().cast("array<struct<i:int,w:double>>")
    pair = lambda i, w: F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"))
    table = F.array(*[F.array(*[pair(i, w) for i, w in targets[k]]) if k in targets else none for k in range(source)])
    rows = pixels.select("tile_id", "value", F.explode(F.get(table, F.col("row"))).alias("r"), "col").select("tile_id", "value", "r", F.explode(F.get(table, F.col("col"))).alias("c"))
    w = F.when(F.col("value").isNotNull(), F.col("r.w") * F.col("c.w"))
    return rows.groupBy("tile_id", F.col("r.i").alias("row"), F.col("c.i").alias("col")).agg(F.round(F.sum(w * F.col("value")) / F.sum(w), 6).alias("value"))


def stretch(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Tiles stretched by the table's exact percentiles to 0-255, with statistics; empty tiles go."""
    bounds = quantiles(pixels, [], "value", {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("b")).scalar()
    scaled = pixels.filter("value IS NOT NULL").withColumn("b", bounds).select("*", "b.*").withColumn("s", F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))))))
    return scaled.groupBy("tile_id").agg(F.min("s").alias("min"), F.max("s").alias("max"), F.round(F.avg("s"), 4).alias("mean"), F.round(F.stddev_pop("s"), 4).alias("std"), F.count("*").alias("valid"))


def minmax(pixels: DataFrame) -> DataFrame:
    w = Window.partitionBy("tile_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return pixels.withColumn("scaled", F.round(F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.when(F.col("value").isNotNull(), 0.0)), 6))


def otsu(pixels: DataFrame) -> DataFrame:
    """Threshold of each tile's clipped values in 0-255 by largest between-class variance, lowest first.

    Works on the tile's histogram of at most 256 rows.
    """
    level = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "value")) * 255).cast("int")
    hist = pixels.filter("value IS NOT NULL").groupBy("tile_id", level.alias("level")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("tile_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("tile_id")
    weight = F.col("n") * F.col("level")
    h = hist.withColumn("n0", F.sum("n").over(up)).withColumn("s0", F.sum(weight).over(up)).withColumn("nt", F.sum("n").over(all_)).withColumn("st", F.sum(weight).over(all_))
    n1 = F.col("nt") - F.col("n0")
    between = F.when(n1 > 0, F.round(F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1, F.lit(2.0)), 6)).otherwise(0.0)
    best = h.withColumn("between", between).groupBy("tile_id").agg(F.max(F.struct("between", (-F.col("level")).alias("l"))).alias("m"))
    return best.select("tile_id", (-F.col("m.l")).cast("int").alias("threshold"))


def cap_positive(pixels: DataFrame, mask: Column, ratio: float) -> DataFrame:
    """Mask with at most ``ratio`` of a tile's pixels: those of the highest values, ties by place."""
    w = Window.partitionBy("tile_id")
    df = pixels.withColumn("mask", mask.cast("int")).withColumn("rk", F.row_number().over(w.orderBy(F.desc_nulls_last("value"), "row", "col"))).withColumn("n", F.count("*").over(w)).withColumn("on", F.sum("mask").over(w))
    keep = F.greatest(F.lit(1), F.bround(F.col("n") * ratio))
    return df.select(*PIXEL, F.when(F.col("on") / F.col("n") <= ratio, F.col("mask")).otherwise((F.col("rk") <= keep).cast("int")).alias("mask"))


def border_uncertainty(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean of 1 - abs(2c - 1) on the mask's border, else inside it, else over the tile."""
    df = by_tile(pixels).withColumn("c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("value", F.lit(0.0)))))
    df = df.withColumn("m", (F.col("c") >= threshold).cast("int"))
    df = focal(focal(df, "m", F.max, 1, "hi"), "m", F.min, 1, "lo")
    u = 1 - F.abs(2 * F.col("c") - 1)
    g = df.groupBy("tile_id").agg(F.avg(F.when(F.col("hi") > F.col("lo"), u)).alias("b"), F.avg(F.when(F.col("m") == 1, u)).alias("i"), F.avg(u).alias("a"))
    return g.select("tile_id", rounded(F.coalesce("b", "i", "a")).alias("uncertainty"))


def affinity_smooth(maps: DataFrame, beta: float = 7.5, eps: float = 1e-6) -> DataFrame:
    """3x3 mean of ``prob`` weighted by exp(-beta * height gradients); the last gradient repeats."""
    right = F.abs(F.lead("v").over(along_row()) - F.col("v"))
    down = F.abs(F.lead("v").over(along_col()) - F.col("v"))
    df = by_tile(maps).withColumn("gx", right).withColumn("gy", down)
    df = df.withColumn("gx", F.coalesce("gx", F.lag("gx").over(along_row()))).withColumn("gy", F.coalesce("gy", F.lag("gy").over(along_col())))
    df = df.withColumn("a", F.exp(-beta * (F.col("gx") + F.col("gy")))).withColumn("pa", F.col("a") * F.col("prob"))
    for c in ("a", "pa"):
        df = df.withColumn("__s", F.sum(c).over(along_row().rowsBetween(-1, 1))).withColumn(f"s_{c}", F.sum("__s").over(along_col().rowsBetween(-1, 1)) / 9)
    return df.select(*PIXEL, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s_pa") / (F.col("s_a") + eps))), 6).alias("prob"))


def seed_and_grow(maps: DataFrame) -> DataFrame:
    """Seeds over 0.7 grow by two pixels where probability and height support it."""
    df = focal(maps.withColumn("seed", (F.col("prob") > 0.7).cast("double")), "seed", F.max, 2, "grown")
    support = ((F.col("prob") > 0.35) & (F.col("v") > 0.05)).cast("double")
    return df.select(*PIXEL, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest("prob", F.col("grown") * support))), 6).alias("prob"))


def mask_components(pixels: DataFrame, mask: Column, connectivity: int = 8) -> DataFrame:
    """Connected regions of a mask: first pixel, area, bounding box, axes, mean value; one row per region.

    Neighbours meet by an equi-join on exploded offsets; regions are connected components of (tile, row, col). The
    axes are those of the rectangle with the region's second moments, so a slanting log keeps its length and
    width: a row of n pixels has a long axis of n and a short one of 1.
    """
    from canopyframe.operators.graph import connected_components

    on = pixels.filter(mask).withColumn("node", F.struct("tile_id", "row", "col"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps]))
    near = on.select("tile_id", F.col("node").alias("a"), "row", "col", shift.alias("s")).select("tile_id", "a", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    edges = near.join(on.select("tile_id", "row", "col", F.col("node").alias("b")), ["tile_id", "row", "col"]).select("a", "b")
    labelled = on.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    moments = [F.var_pop("row").alias("vr"), F.var_pop("col").alias("vc"), F.covar_pop("row", "col").alias("cv")]
    g = labelled.groupBy("tile_id", "component").agg(F.count("*").alias("area"), (F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w"), F.round(F.avg("value"), 6).alias("mean_value"), *moments)
    mean, half = (F.col("vr") + F.col("vc")) / 2, (F.col("vr") - F.col("vc")) / 2
    reach = F.sqrt(half * half + F.col("cv") * F.col("cv"))
    axis = lambda v, name: F.sqrt(12 * F.greatest(v, F.lit(0.0)) + 1).alias(name)
    first = [F.col("component")[c].alias(f"first_{c}") for c in ("row", "col")]
    return g.select("tile_id", *first, "area", F.greatest("h", "w").alias("length"), F.least("h", "w").alias("width"), axis(mean + reach, "long_axis"), axis(mean - reach, "short_axis"), "mean_value")


def line_regions(regions: DataFrame, *, length: tuple[float, float] = (20, 200), width: tuple[float, float] = (1, 6), occluded: float = 8, confident: float = 0.5) -> DataFrame:
    """Regions of ``mask_components`` with ``width_px`` and a ``rule``: main, occluded, fallback or none.

    Main regions have the long axis and width of a log; the width blends area over length with the short
    axis (0.6 and 0.4), which holds for bent regions too. Occluded ones are as wide, shorter, at least ``occluded``
    long, and of a mean value of at least ``confident``. In a tile where neither rule takes a region, all of
    its regions stay, as fallback; else the others have none.
    """
    wide = 0.6 * F.col("area") / F.greatest("long_axis", F.lit(1.0)) + 0.4 * F.col("short_axis")
    rows = regions.withColumn("width_px", wide)
    slim = F.col("width_px").between(*width)
    main = slim & F.col("long_axis").between(*length)
    short = slim & (F.col("long_axis") >= occluded) & (F.col("long_axis") < length[0]) & (F.col("mean_value") >= confident)
    rows = rows.withColumn("rule", F.when(main, "main").when(short, "occluded"))
    taken = rows.groupBy("tile_id").agg(F.count("rule").alias("__taken"))
    left = F.when(F.col("__taken") == 0, "fallback").otherwise("none")
    return rows.join(taken, "tile_id").withColumn("rule", F.coalesce("rule", left)).drop("__taken")
