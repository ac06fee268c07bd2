"""Raster, tile and chip operators."""

from pyspark.sql import functions as F

from canopyframe.functions import keys as K
from canopyframe.operators import labels as L
from canopyframe.operators import rasters as R
from canopyframe.queries.base import query

RASTERS = "SELECT sample_id, p_partkey, CAST(100 + (p_partkey * 37) % 900 AS INTEGER) AS height, CAST(60 + (p_partkey * 53) % 1100 AS INTEGER) AS width FROM samples"


def rasters(t):
    return t.samples().select("sample_id", "p_partkey", (100 + (F.col("p_partkey") * 37) % 900).cast("int").alias("height"), (60 + (F.col("p_partkey") * 53) % 1100).cast("int").alias("width"))


def offsets_sql(c, quarter):
    add = f"({c} - 128) % 64 > {quarter}"
    return f"CASE WHEN {c} <= 128 THEN [0] WHEN {add} THEN list_append(range(0, {c} - 127, 64), {c} - 128) ELSE range(0, {c} - 127, 64) END"


def index_sql(quarter):
    return f"SELECT sample_id, p_partkey, CAST(row_off AS INTEGER) AS row_off, CAST(unnest({offsets_sql('width', quarter)}) AS INTEGER) AS col_off FROM (SELECT *, unnest({offsets_sql('height', quarter)}) AS row_off FROM ({RASTERS}))"


@query("ras01_chip_offsets", index_sql(32))
def _(t):
    return R.chip_index(rasters(t), 128).select("sample_id", "p_partkey", "row_off", "col_off")


@query("ras02_cover_offsets", index_sql(0))
def _(t):
    return R.chip_index(rasters(t), 128, cover=True).select("sample_id", "p_partkey", "row_off", "col_off")


@query(
    "ras03_tile_index",
    "SELECT DISTINCT raster, row_off, col_off, grid_y * 1000 + (col_off + 64) * 0.2::DOUBLE AS centre_x, 6001000 + grid_x * 1000 - (row_off + 64) * 0.2::DOUBLE AS centre_y, CAST(round_even((grid_y * 1000 + (col_off + 64) * 0.2::DOUBLE) / 10, 0) AS VARCHAR) || '_' || CAST(round_even((6001000 + grid_x * 1000 - (row_off + 64) * 0.2::DOUBLE) / 10, 0) AS VARCHAR) AS place FROM parsed".replace("CAST(round_even(", "CAST(CAST(round_even(").replace(", 0) AS VARCHAR)", ", 0) AS BIGINT) AS VARCHAR)"),
)
def _(t):
    c = K.with_identity(t.label_events()).select("raster", "row_off", "col_off", K.tile_bounds(F.col("grid_x"), F.col("grid_y")).alias("b")).select("raster", "row_off", "col_off", "b.minx", "b.maxy").distinct()
    c = c.select("raster", "row_off", "col_off", *R.chip_centre())
    cell = lambda x: F.bround(F.col(x) / 10).cast("long").cast("string")
    return c.withColumn("place", F.concat_ws("_", cell("centre_x"), cell("centre_y")))


@query("src07_chip_catalogue", f"SELECT sample_id, p_partkey, count(*) AS chips FROM ({index_sql(32)}) WHERE p_partkey % 3 <> 2 GROUP BY sample_id, p_partkey")
def _(t):
    known = rasters(t).withColumn("product", K.infer_product(F.concat("sample_id", F.element_at(F.lit(["_harmonized_dem_last_raw_chm", "_harmonized_dem_last_gauss_chm", "_dem"]), (F.col("p_partkey") % 3 + 1).cast("int"))))).filter("product IS NOT NULL")
    return R.chip_index(known, 128).groupBy("sample_id", "p_partkey").agg(F.count("*").alias("chips"))


W = "WINDOW wr AS (PARTITION BY tile_id, row ORDER BY col), wc AS (PARTITION BY tile_id, col ORDER BY row)"
W3 = "WINDOW wr AS (PARTITION BY tile_id, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
C3 = "WINDOW wc AS (PARTITION BY tile_id, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query("win14_axis_differences", f"SELECT tile_id, row, col, round(abs(lead(v) OVER wc - v), 6) AS gr, round(abs(lead(v) OVER wr - v), 6) AS gc FROM (SELECT *, coalesce(value, 0) AS v FROM pixels) {W}")
def _(t):
    g = R.gradients(R.filled(t.pixels()))
    return g.select(*R.PIXEL, F.round("gr", 6).alias("gr"), F.round("gc", 6).alias("gc"))


@query("win15_moving_min_max", f"SELECT tile_id, row, col, min(mn) OVER wc AS low, max(mx) OVER wc AS high FROM (SELECT tile_id, row, col, min(value) OVER wr AS mn, max(value) OVER wr AS mx FROM pixels {W3}) {C3}")
def _(t):
    px = t.pixels()
    return R.focal(R.focal(px, "value", F.min, 1, "low"), "value", F.max, 1, "high").select(*R.PIXEL, "low", "high")


NAMES = ["gr", "gc", "d45", "d135"]
BANK = f"""WITH a AS (SELECT tile_id, row, col, coalesce(value, 0::DOUBLE) AS v FROM pixels),
b AS (SELECT *, lead(v) OVER wc AS down FROM a {W}),
c AS (SELECT *, abs(down - v) AS gr, abs(lead(v) OVER wr - v) AS gc, abs(lead(down) OVER wr - v) AS d45, abs(lag(down) OVER wr - v) AS d135,
  coalesce(lag(v) OVER wr, v) + coalesce(lead(v) OVER wr, v) + coalesce(lag(v) OVER wc, v) + coalesce(lead(v) OVER wc, v) - 4 * v AS lap FROM b {W}),
e1 AS (SELECT *, min(v) OVER wr AS e, max(abs(lap)) OVER wr AS g FROM c {W3}),
e2 AS (SELECT * REPLACE (min(e) OVER wc AS e, max(g) OVER wc AS g) FROM e1 {C3}),
o1 AS (SELECT *, max(e) OVER wr AS o FROM e2 {W3}),
o2 AS (SELECT * REPLACE (max(o) OVER wc AS o) FROM o1 {C3})
SELECT tile_id, round(avg(v) + 1e-9, 6) AS mean, round(stddev_pop(v) + 1e-9, 6) AS std, round(min(v) + 1e-9, 6) AS min, round(max(v) + 1e-9, 6) AS max, {", ".join(f"round(quantile_cont(v, {q / 100}) + 1e-9, 6) AS q{q}" for q in (10, 25, 50, 75, 90))},
round(avg(CASE WHEN v <= 1e-6 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS zero_share, {", ".join(f"round(avg({g}) + 1e-9, 6) AS {g}_mean, round(stddev_pop({g}) + 1e-9, 6) AS {g}_std" for g in NAMES)},
round(avg(lap) + 1e-9, 6) AS lap_mean, round(var_pop(lap) + 1e-9, 6) AS lap_var, round(avg(v - o) + 1e-9, 6) AS tophat_mean, round(stddev_pop(v - o) + 1e-9, 6) AS tophat_std, round(avg(g) + 1e-9, 6) AS ridge_mean, round(stddev_pop(g) + 1e-9, 6) AS ridge_std
FROM o2 GROUP BY tile_id"""


@query("ras04_feature_bank", BANK)
def _(t):
    return R.feature_bank(t.pixels())


def _heights():
    q = lambda p: f"quantile_cont(value, {p}) FILTER (value > 0.15)"
    over = ", ".join(f"round(count(*) FILTER (value > {b}) / count(*), 6) AS over_{k}" for k, b in enumerate(R.BANDS))
    ps = ", ".join(f"round(coalesce({q(p / 100)}, 0), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 99))
    ab = "FILTER (value > 0.15)"
    return f"""SELECT tile_id, {over}, {ps}, round(coalesce(avg(value) {ab}, 0), 6) AS above_mean, round(coalesce(stddev_pop(value) {ab}, 0), 6) AS above_std, round(coalesce(max(value) {ab}, 0), 6) AS above_max,
    round(count(*) {ab} / count(*), 6) AS above_share, CAST(count(*) FILTER (value > 0.15 AND NOT before) AS BIGINT) AS runs, round(coalesce({q(0.75)} / greatest({q(0.25)}, 0.01), 1), 6) AS spread,
    round(count(*) FILTER (value > 0.5) / count(*), 6) AS over_half, round(count(*) FILTER (value > 1.0) / count(*), 6) AS over_one
    FROM (SELECT *, coalesce(lag(value > 0.15) OVER (PARTITION BY tile_id ORDER BY row, col), true) AS before FROM pixels WHERE value IS NOT NULL) GROUP BY tile_id"""


@query("ras05_height_features", _heights())
def _(t):
    return R.height_features(t.pixels())


SLOPE = "CASE WHEN lag(v) OVER {w} IS NULL THEN lead(v) OVER {w} - v WHEN lead(v) OVER {w} IS NULL THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END"
GEOM = f"""WITH a AS (SELECT tile_id, row, col, coalesce(value >= 0, false) AS ok, CASE WHEN value >= 0 THEN value ELSE 0 END AS v FROM pixels),
b AS (SELECT *, {SLOPE.format(w="wr")} AS dx, {SLOPE.format(w="wc")} AS dy FROM a {W}),
g AS (SELECT tile_id, count(*) FILTER (ok) / count(*) AS vf, count(*) FILTER (ok AND v BETWEEN 0.4 AND 1.1) / greatest(count(*) FILTER (ok), 1) AS cf, count(*) FILTER (ok AND v BETWEEN 0.4 AND 1.1 AND sqrt(dx * dx + dy * dy) > 0.1) / greatest(count(*) FILTER (ok), 1) AS ef FROM b GROUP BY tile_id),
geom AS (SELECT tile_id, round(vf, 6) AS valid_frac, round(cf, 6) AS cwd_frac, round(ef, 6) AS edge_frac, round(CASE WHEN vf < 0.5 THEN 0 ELSE ef * CASE WHEN cf < 0.4 THEN 1 ELSE greatest(0, 1 - (cf - 0.4) / 0.4) END * vf END, 6) AS score FROM g)"""


@query("ras06_geometric_score", f"{GEOM} SELECT * FROM geom")
def _(t):
    return R.geometric_score(t.pixels())


@query("ras07_score_blend", f"{GEOM}, m AS (SELECT key, avg(prob) AS p FROM scores GROUP BY key) SELECT tile_id, round(0.6 * score + 0.4 * coalesce(p, 0), 6) AS blended FROM geom LEFT JOIN m ON tile_id = key")
def _(t):
    m = t.scores().groupBy("key").agg(F.avg("prob").alias("p"))
    s = R.geometric_score(t.pixels()).join(m, F.col("tile_id") == F.col("key"), "left")
    return s.select("tile_id", F.round(0.6 * F.col("score") + 0.4 * F.coalesce("p", F.lit(0.0)), 6).alias("blended"))


def _gauss(sigma):
    ws = R.gaussian_weights(sigma)
    kern = ", ".join(f"({k - len(ws) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(ws))
    return f"""WITH k(d, w) AS (VALUES {kern}), a AS (SELECT tile_id, row, col, coalesce(value, 0) AS v, CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS m FROM pixels),
    h AS (SELECT a.tile_id, a.row, a.col, sum(w * b.v) AS v, sum(w * b.m) AS m FROM a CROSS JOIN k JOIN a b ON a.tile_id = b.tile_id AND a.row = b.row AND b.col = least(greatest(a.col + d, 0), 7) GROUP BY ALL),
    g AS (SELECT a.tile_id, a.row, a.col, sum(w * b.v) AS v, sum(w * b.m) AS m FROM h a CROSS JOIN k JOIN h b ON a.tile_id = b.tile_id AND a.col = b.col AND b.row = least(greatest(a.row + d, 0), 7) GROUP BY ALL)
    SELECT tile_id, row, col, round(CASE WHEN m > 1e-6 THEN v / m END, 6) AS value FROM g"""


@query("ras08_masked_gaussian", _gauss(0.75))
def _(t):
    return R.masked_gaussian(t.pixels())


BILINEAR = """WITH tgt AS (SELECT unnest(range(0, 5)) AS i), p AS (SELECT i, least(greatest((i + 0.5) * 1.6 - 0.5, 0), 7)::DOUBLE AS pos FROM tgt),
w AS (SELECT i, CAST(floor(pos) AS INTEGER) AS k, 1 - (pos - floor(pos)) AS w FROM p UNION ALL SELECT i, CAST(least(floor(pos) + 1, 7) AS INTEGER), pos - floor(pos) FROM p WHERE pos > floor(pos))
SELECT tile_id, CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col, round(sum(r.w * c.w * value) / sum(CASE WHEN value IS NOT NULL THEN r.w * c.w END), 6) AS value FROM pixels JOIN w r ON pixels.row = r.k JOIN w c ON pixels.col = c.k GROUP BY ALL"""


@query("ras09_bilinear_resample", BILINEAR)
def _(t):
    return R.bilinear(t.pixels(), 5)


@query(
    "ras10_composite",
    "SELECT r.tile_id, r.row, r.col, round(r.value * 0.9, 6) AS gauss, r.value AS raw, b.value AS base, CASE WHEN r.value IS NOT NULL AND b.value IS NOT NULL THEN 1 ELSE 0 END AS mask FROM pixels r JOIN pixels b ON r.tile_id = b.tile_id AND r.row = b.row AND r.col = b.col WHERE (b.tile_id + b.row) % 5 <> 0",
)
def _(t):
    px = t.pixels()
    gauss = px.select(*R.PIXEL, F.round(F.col("value") * 0.9, 6).alias("gauss"))
    base = px.filter("(tile_id + row) % 5 <> 0").select(*R.PIXEL, F.col("value").alias("base"))
    rows = px.select(*R.PIXEL, F.col("value").alias("raw")).join(gauss, R.PIXEL).join(base, R.PIXEL)
    return rows.withColumn("mask", (F.col("raw").isNotNull() & F.col("base").isNotNull()).cast("int"))


@query("ras11_value_and_mask", "SELECT tile_id, row, col, coalesce(value, 0) AS value, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS mask FROM pixels")
def _(t):
    return t.pixels().select(*R.PIXEL, F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().cast("int").alias("mask"))


@query(
    "ras12_percentile_stretch",
    """WITH q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixels), s AS (SELECT tile_id, CAST(floor(255 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - lo) / (hi - lo)))) AS BIGINT) AS s FROM pixels, q WHERE value IS NOT NULL)
    SELECT tile_id, min(s) AS min, max(s) AS max, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS std, count(*) AS valid FROM s GROUP BY tile_id""",
)
def _(t):
    return R.stretch(t.pixels())


@query("ras13_minmax", "SELECT tile_id, row, col, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) WHEN value IS NOT NULL THEN 0 END, 6) AS scaled FROM pixels WINDOW w AS (PARTITION BY tile_id)")
def _(t):
    return R.minmax(t.pixels()).select(*R.PIXEL, "scaled")


@query(
    "ras14_otsu",
    """WITH h AS (SELECT tile_id, CAST(round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value)) * 255, 0) AS INTEGER) AS level, count(*) AS n FROM pixels WHERE value IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER u AS n0, sum(n * level) OVER u AS s0, sum(n) OVER a AS nt, sum(n * level) OVER a AS st FROM h WINDOW u AS (PARTITION BY tile_id ORDER BY level), a AS (PARTITION BY tile_id)),
    b AS (SELECT tile_id, level, CASE WHEN nt > n0 THEN round(n0 * (nt - n0) * power(s0 / n0 - (st - s0) / (nt - n0), 2), 6) ELSE 0 END AS v FROM c)
    SELECT tile_id, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY v DESC, level) AS rn FROM b) WHERE rn = 1""",
)
def _(t):
    return R.otsu(t.pixels())


@query(
    "ras15_positive_cap",
    """WITH a AS (SELECT tile_id, row, col, CASE WHEN value > 0.9 THEN 1 ELSE 0 END AS m, row_number() OVER (PARTITION BY tile_id ORDER BY value DESC NULLS LAST, row, col) AS rk, count(*) OVER (PARTITION BY tile_id) AS n FROM pixels)
    SELECT tile_id, row, col, CASE WHEN (sum(m) OVER (PARTITION BY tile_id)) / n <= 0.2 THEN m WHEN rk <= greatest(1, round_even(n * 0.2, 0)) THEN 1 ELSE 0 END AS mask FROM a""",
)
def _(t):
    return R.cap_positive(t.pixels(), F.coalesce(F.col("value") > 0.9, F.lit(False)), 0.2)


REGIONS = """on_ AS (SELECT tile_id, row, col, value, (tile_id * 8 + row) * 8 + col AS node FROM pixels WHERE value > 1.0),
    e AS (SELECT a.node AS a, b.node AS b FROM on_ a JOIN on_ b ON a.tile_id = b.tile_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.node <> b.node),
    r(a, b) AS (SELECT node, node FROM on_ UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)"""


@query(
    "ras16_mask_components",
    f"""WITH RECURSIVE {REGIONS}
    SELECT tile_id, component, count(*) AS area, greatest(max(row) - min(row) + 1, max(col) - min(col) + 1) AS length, least(max(row) - min(row) + 1, max(col) - min(col) + 1) AS width, round(avg(value), 6) AS mean_value
    FROM on_ JOIN c USING (node) GROUP BY tile_id, component HAVING count(*) >= 3""",
)
def _(t):
    first = (F.col("tile_id") * 8 + F.col("first_row")) * 8 + F.col("first_col")
    return R.mask_components(t.pixels(), F.col("value") > 1.0).filter("area >= 3").select("tile_id", first.alias("component"), "area", "length", "width", "mean_value")


@query(
    "ras16_line_regions",
    f"""WITH RECURSIVE {REGIONS}, m AS (SELECT tile_id, component, count(*) AS area, avg(value) AS v, (var_pop(row) + var_pop(col)) / 2 AS mean, sqrt(power((var_pop(row) - var_pop(col)) / 2, 2) + power(covar_pop(row, col), 2)) AS reach FROM on_ JOIN c USING (node) GROUP BY tile_id, component),
    x AS (SELECT *, sqrt(12 * greatest(mean + reach, 0) + 1) AS la, sqrt(12 * greatest(mean - reach, 0) + 1) AS sa FROM m), w AS (SELECT *, 0.6::DOUBLE * area / greatest(la, 1) + 0.4::DOUBLE * sa AS wd FROM x),
    g AS (SELECT *, CASE WHEN wd BETWEEN 0.9 AND 2.5 AND la BETWEEN 3.5 AND 8 THEN 'main' WHEN wd BETWEEN 0.9 AND 2.5 AND la >= 1.9 AND la < 3.5 AND round(v, 6) >= 1.1 THEN 'occluded' END AS rule FROM w)
    SELECT tile_id, component, area, round(la, 6) AS long_axis, round(wd, 6) AS width_px, coalesce(rule, CASE WHEN count(rule) OVER (PARTITION BY tile_id) = 0 THEN 'fallback' ELSE 'none' END) AS rule FROM g""",
)
def _(t):
    first = (F.col("tile_id") * 8 + F.col("first_row")) * 8 + F.col("first_col")
    rows = R.line_regions(R.mask_components(t.pixels(), F.col("value") > 1.0), length=(3.5, 8), width=(0.9, 2.5), occluded=1.9, confident=1.1)
    return rows.select("tile_id", first.alias("component"), "area", F.round("long_axis", 6).alias("long_axis"), F.round("width_px", 6).alias("width_px"), "rule")


@query(
    "ras17_border_uncertainty",
    f"""WITH a AS (SELECT tile_id, row, col, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(value, 0))) AS c FROM pixels), b AS (SELECT *, CASE WHEN c >= 0.5 THEN 1 ELSE 0 END AS m FROM a),
    h AS (SELECT *, max(m) OVER wr AS hi, min(m) OVER wr AS lo FROM b {W3}), g AS (SELECT * REPLACE (max(hi) OVER wc AS hi, min(lo) OVER wc AS lo) FROM h {C3})
    SELECT tile_id, round(coalesce(avg(1 - abs(2 * c - 1)) FILTER (hi > lo), avg(1 - abs(2 * c - 1)) FILTER (m = 1), avg(1 - abs(2 * c - 1))) + 1e-9, 6) AS uncertainty FROM g GROUP BY tile_id""",
)
def _(t):
    return R.border_uncertainty(t.pixels())


MAPS = "SELECT tile_id, row, col, coalesce(value, 0::DOUBLE) AS v, least(1.0::DOUBLE, coalesce(value, 0) / 1.2) AS prob FROM pixels"


def maps(t):
    return R.filled(t.pixels()).withColumn("prob", F.least(F.lit(1.0), F.col("v") / 1.2)).select(*R.PIXEL, "v", "prob")


@query(
    "ras18_affinity_smooth",
    f"""WITH m AS ({MAPS}), g AS (SELECT *, abs(lead(v) OVER wr - v) AS gx0, abs(lead(v) OVER wc - v) AS gy0 FROM m {W}), g2 AS (SELECT *, coalesce(gx0, lag(gx0) OVER wr) AS gx, coalesce(gy0, lag(gy0) OVER wc) AS gy FROM g {W}),
    a AS (SELECT tile_id, row, col, exp(-7.5 * (gx + gy)) AS a, prob * exp(-7.5 * (gx + gy)) AS pa FROM g2), s AS (SELECT tile_id, row, col, sum(a) OVER wr AS a, sum(pa) OVER wr AS pa FROM a {W3})
    SELECT tile_id, row, col, round(greatest(0, least(1, (sum(pa) OVER wc / 9) / (sum(a) OVER wc / 9 + 1e-6))), 6) AS prob FROM s {C3}""",
)
def _(t):
    return R.affinity_smooth(maps(t))


@query(
    "ras19_seed_and_grow",
    f"""WITH m AS ({MAPS}), s AS (SELECT *, max(CASE WHEN prob > 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY tile_id, row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS g FROM m),
    h AS (SELECT *, max(g) OVER (PARTITION BY tile_id, col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS grown FROM s)
    SELECT tile_id, row, col, round(greatest(prob, CASE WHEN prob > 0.35 AND v > 0.05 THEN grown::DOUBLE ELSE 0.0::DOUBLE END), 6) AS prob FROM h""",
)
def _(t):
    return R.seed_and_grow(maps(t))


@query("ras20_polygon_text", "SELECT tile_id, '0 ' || array_to_string(list_transform(band[1:8], lambda v: CAST(CAST(round(coalesce(v, 0) * 1000) AS BIGINT) AS VARCHAR)), ' ') AS line FROM tiles")
def _(t):
    coords = F.transform(F.slice("band", 1, 8), lambda v: F.round(F.coalesce(v, F.lit(0.0)) * 1000).cast("long").cast("string"))
    return t.tiles().select("tile_id", F.concat(F.lit("0 "), F.array_join(coords, " ")).alias("line"))


ND = "SELECT tile_id, count(*) FILTER (value IS NULL) / 64 AS f FROM pixels GROUP BY tile_id"


@query("flt07_nodata_gates", f"SELECT tile_id, f <= 0.5 AS detect, f <= 0.7 AS instance, f <= 0.95 AS line FROM ({ND})")
def _(t):
    f = F.col("nodata_pct") / 100
    return R.nodata_share(t.pixels()).select("tile_id", (f <= 0.5).alias("detect"), (f <= 0.7).alias("instance"), (f <= 0.95).alias("line"))


@query("flt08_queue_nodata_gate", f"SELECT key, avg(prob) AS score FROM scores JOIN ({ND}) n ON key = tile_id WHERE f <= 0.1 GROUP BY key".replace("avg(prob)", "round(avg(prob), 6)"))
def _(t):
    ok = R.nodata_share(t.pixels()).filter("nodata_pct <= 10").select(F.col("tile_id").alias("key"))
    return t.scores().join(ok, "key", "left_semi").groupBy("key").agg(F.round(F.avg("prob"), 6).alias("score"))


@query(
    "flt09_geometry_gate",
    """SELECT arrival FROM (SELECT arrival, (1 + arrival % 40) * 0.5::DOUBLE AS w, (1 + arrival % 7) * 0.3::DOUBLE AS h, coalesce(model_prob, 0) AS solid FROM label_events)
    WHERE w * h >= 1 AND w * h <= 40 AND greatest(w, h) >= 2 AND greatest(w, h) <= 15 AND least(w, h) <= 2 AND greatest(w, h) / least(w, h) >= 2 AND solid >= 0.3""",
)
def _(t):
    from canopyframe.operators.detections import geometry_gate

    d = t.label_events().select("arrival", ((1 + F.col("arrival") % 40) * 0.5).alias("width"), ((1 + F.col("arrival") % 7) * 0.3).alias("height"), F.coalesce("model_prob", F.lit(0.0)).alias("solidity"))
    return geometry_gate(d).select("arrival")


@query("flt10_bad_examples", "SELECT tile_id, f > 0.5 OR n < 3 AS bad FROM (SELECT tile_id, count(*) FILTER (value IS NULL) / 64 AS f, count(*) FILTER (value > 1.0) AS n FROM pixels GROUP BY tile_id)")
def _(t):
    g = t.pixels().groupBy("tile_id").agg((F.count_if(F.col("value").isNull()) / F.count("*")).alias("f"), F.count_if(F.col("value") > 1.0).alias("n"))
    return g.select("tile_id", ((F.col("f") > 0.5) | (F.col("n") < 3)).alias("bad"))


@query(
    "x06_saliency_correlation",
    "SELECT label, round(avg(r), 6) AS mean_r, CAST(count(*) FILTER (s < 0.05) AS BIGINT) AS low_activity FROM (SELECT label, tile_id, corr(value, col * value + row) AS r, stddev_pop(value) AS s FROM pixels WHERE value IS NOT NULL GROUP BY label, tile_id) GROUP BY label",
)
def _(t):
    px = t.pixels().filter("value IS NOT NULL")
    per = px.groupBy("label", "tile_id").agg(F.corr("value", F.col("col") * F.col("value") + F.col("row")).alias("r"), F.stddev_pop("value").alias("s"))
    return per.groupBy("label").agg(F.round(F.avg("r"), 6).alias("mean_r"), F.count_if(F.col("s") < 0.05).alias("low_activity"))


@query(
    "x05_raster_compare",
    """SELECT label, CAST(count(*) FILTER (abs(coalesce(a, 0) - coalesce(b, 0)) > 1e-6) AS BIGINT) AS differ, round(max(abs(coalesce(a, 0) - coalesce(b, 0))), 6) AS max_diff, round(avg(abs(coalesce(a, 0) - coalesce(b, 0))), 6) AS mean_diff
    FROM (SELECT coalesce(p.label, q.label) AS label, p.value AS a, q.value AS b FROM (SELECT * FROM pixels WHERE row < 6) p FULL JOIN (SELECT * REPLACE (round(value * 1.01, 4) AS value) FROM pixels WHERE row > 1) q ON p.tile_id = q.tile_id AND p.row = q.row AND p.col = q.col)
    WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY label""",
)
def _(t):
    px = t.pixels()
    a = px.filter("row < 6").select(*R.PIXEL, "label", F.col("value").alias("a"))
    b = px.filter("row > 1").select(*R.PIXEL, F.col("label").alias("lb"), F.round(F.col("value") * 1.01, 4).alias("b"))
    j = a.join(b, R.PIXEL, "full").filter("a IS NOT NULL OR b IS NOT NULL").withColumn("label", F.coalesce("label", "lb"))
    d = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return j.groupBy("label").agg(F.count_if(d > 1e-6).alias("differ"), F.round(F.max(d), 6).alias("max_diff"), F.round(F.avg(d), 6).alias("mean_diff"))
