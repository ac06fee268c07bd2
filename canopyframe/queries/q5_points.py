"""Point clouds, grids and nearest neighbours."""

from pyspark.sql import functions as F

from canopyframe.operators import points as P
from canopyframe.operators import spatial
from canopyframe.queries.base import query

BY = ["tile_id", "year"]
CELL = "cells AS (SELECT *, CAST(floor((13.0::DOUBLE - y) / 0.5::DOUBLE + 1e-9) AS INTEGER) AS row, CAST(floor(x / 0.5::DOUBLE + 1e-9) AS INTEGER) AS col FROM points)"
MED = "med AS (SELECT tile_id, year, row, col, median(z) AS ground FROM cells WHERE classification = 2 GROUP BY ALL)"
LOW = "low AS (SELECT tile_id, year, row, col, min(z) AS ground FROM cells WHERE classification = 2 GROUP BY ALL)"
HAG = "hag AS (SELECT c.*, c.z - m.ground AS hag FROM cells c JOIN med m USING (tile_id, year, row, col))"


def cells(t):
    return P.to_cells(t.points(), 0.5)


def hags(t):
    c = cells(t)
    return P.heights(c, P.surface(c, BY, "median"), BY)


@query("src05_point_sample", "SELECT point_id, tile_id, year, coalesce(scan_angle, 0) AS scan_angle, nir FROM points ORDER BY md5(CAST(point_id AS VARCHAR)), point_id LIMIT 1000")
def _(t):
    p = t.points().withColumn("scan_angle_rank", F.lit(None).cast("double"))
    rows = p.select("point_id", *BY, F.coalesce("scan_angle", "scan_angle_rank", F.lit(0.0)).alias("scan_angle"), "nir")
    return rows.orderBy(F.md5(F.col("point_id").cast("string")), "point_id").limit(1000)


@query("src06_tile_year_selection", "SELECT tile_id, year, count(*) AS n FROM points WHERE tile_id = '436640' AND year IN (1998, 2000) GROUP BY ALL")
def _(t):
    return t.points().filter("tile_id = '436640' AND year IN (1998, 2000)").groupBy(*BY).agg(F.count("*").alias("n"))


@query("flt05_class_and_return_masks", "SELECT 'all' AS mode, count(*) AS n FROM points WHERE classification NOT IN (6) UNION ALL SELECT 'last', count(*) FROM points WHERE classification NOT IN (6) AND return_number = number_of_returns UNION ALL SELECT 'last2', count(*) FROM points WHERE classification NOT IN (6) AND return_number >= greatest(1, number_of_returns - 1)")
def _(t):
    p = P.class_mask(t.points(), [6])
    parts = [P.return_mask(p, m).select(F.lit(m).alias("mode")) for m in ("all", "last", "last2")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("mode").agg(F.count("*").alias("n"))


@query("flt06_height_policy", f"WITH {CELL}, {MED}, {HAG} SELECT point_id, round(least(1.3, greatest(0, hag)), 6) AS clipped, hag BETWEEN 0 AND 1.3 AS kept FROM hag")
def _(t):
    h = hags(t)
    kept = F.col("hag").between(0.0, 1.3)
    c = cells(t)
    clipped = P.heights(c, P.surface(c, BY, "median"), BY, most=1.3, drop=False).select("point_id", F.round("hag", 6).alias("clipped"))
    return clipped.join(h.select("point_id", kept.alias("kept")), "point_id")


@query("pc01_common_grid", "SELECT tile_id, year, round(floor(min(x) / 0.2) * 0.2, 6) AS origin_x, round(max(y), 6) AS max_y, CAST(greatest(1, ceil((max(x) - floor(min(x) / 0.2::DOUBLE) * 0.2::DOUBLE) / 0.2::DOUBLE)) AS BIGINT) AS width, CAST(greatest(1, ceil((max(y) - min(y)) / 0.2::DOUBLE)) AS BIGINT) AS height FROM points GROUP BY tile_id, year")
def _(t):
    return P.common_grid(t.points(), BY, 0.2)


@query("pc02_cell_mapping", f"WITH {CELL} SELECT point_id, row, col FROM cells WHERE row >= 0 AND col >= 0")
def _(t):
    return cells(t).select("point_id", "row", "col")


@query("pc03_median_surface", f"WITH {CELL}, {MED} SELECT tile_id, year, row, col, round(ground, 6) AS ground FROM med")
def _(t):
    return P.surface(cells(t), BY, "median").withColumn("ground", F.round("ground", 6))


@query("pc04_lowest_surface", f"WITH {CELL}, {LOW} SELECT tile_id, year, row, col, ground, low_all FROM (SELECT tile_id, year, row, col, min(z) AS low_all FROM cells GROUP BY ALL) LEFT JOIN low USING (tile_id, year, row, col)")
def _(t):
    c = cells(t)
    every = P.surface(c, BY, "lowest", ground_only=False).withColumnRenamed("ground", "low_all")
    return every.join(P.surface(c, BY, "lowest"), [*BY, "row", "col"], "left")


@query(
    "pc05_local_fallback",
    f"""WITH {CELL}, loc AS (SELECT tile_id, row, col, median(z) AS l FROM cells WHERE year = 2000 AND classification = 2 GROUP BY ALL), ref AS (SELECT tile_id, row, col, median(z) AS r FROM cells WHERE year = 1999 AND classification = 2 GROUP BY ALL),
    b AS (SELECT * FROM ref FULL JOIN loc USING (tile_id, row, col)), d AS (SELECT * FROM b WHERE abs(r - l) > 2.0),
    f AS (SELECT b.*, b.l IS NOT NULL AND EXISTS (SELECT 1 FROM d WHERE d.tile_id = b.tile_id AND abs(d.row - b.row) <= 2 AND abs(d.col - b.col) <= 2) AS fallback FROM b)
    SELECT tile_id, row, col, round(CASE WHEN fallback OR r IS NULL THEN l ELSE r END, 6) AS ground, fallback FROM f""",
)
def _(t):
    c = cells(t)
    ref, loc = (P.surface(c.filter(f"year = {y}"), ["tile_id"], "median") for y in (1999, 2000))
    return P.local_fallback(ref, loc, ["tile_id"], 2.0).withColumn("ground", F.round("ground", 6))


# of the ground points at one place only the three first ids can be among the three nearest
NN = """g AS (SELECT * FROM (SELECT tile_id, year, x, y, z, point_id, row_number() OVER (PARTITION BY tile_id, year, x, y ORDER BY point_id) AS r FROM points WHERE classification = 2) WHERE r <= 3),
pos AS (SELECT DISTINCT tile_id, year, x, y FROM points),
near AS (SELECT p.tile_id, p.year, p.x, p.y, min({'d': sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)), 'id': g.point_id, 'z': g.z}, 3) AS n FROM pos p JOIN g USING (tile_id, year) GROUP BY ALL),
nn AS (SELECT point_id, z, unnest(range(1, len(n) + 1)) AS rk, unnest(n) AS n FROM points JOIN near USING (tile_id, year, x, y))"""


@query("join18_nearest_ground", f"WITH {NN} SELECT point_id, CAST(rk AS INTEGER) AS rk, n.id AS ground_id, round(n.d, 6) AS d FROM nn")
def _(t):
    p = t.points()
    g = p.filter("classification = 2").withColumnRenamed("point_id", "ground_id")
    return spatial.nearest(p, g, BY, ["x", "y"], "point_id", "ground_id", 3).select("point_id", "rk", "ground_id", F.round("d", 6).alias("d"))


@query("pc06_idw_height", f"WITH {NN} SELECT point_id, round(any_value(z) - sum(n.z / (n.d + 1e-8)) / sum(1 / (n.d + 1e-8)), 4) AS hag FROM nn GROUP BY point_id")
def _(t):
    return P.idw_heights(t.points(), BY).select("point_id", F.round("hag", 4).alias("hag"))


@query("pc07_max_height", f"WITH {CELL}, {MED}, {HAG} SELECT tile_id, year, row, col, round(max(hag), 6) AS chm FROM hag WHERE hag BETWEEN 0 AND 1.3 GROUP BY ALL")
def _(t):
    return P.max_height(hags(t).filter(F.col("hag").between(0.0, 1.3)), BY).withColumn("chm", F.round("chm", 6))


@query("pc08_intensity_range", f"WITH {CELL}, {MED}, {HAG} SELECT tile_id, year, min(intensity) AS lo, max(intensity) AS hi FROM hag WHERE hag BETWEEN 0.4 AND 1.3 GROUP BY ALL")
def _(t):
    return hags(t).filter(F.col("hag").between(0.4, 1.3)).groupBy(*BY).agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"))


BANDS = f"""{CELL}, {MED}, {HAG}, rng AS (SELECT tile_id, year, min(intensity) AS lo, max(intensity) AS hi FROM hag WHERE hag BETWEEN 0.4 AND 1.3 GROUP BY ALL),
bands AS (SELECT tile_id, year, row, col, max(hag) FILTER (hag >= 0 AND hag < 0.4) AS band0, max(hag) FILTER (hag >= 0.4 AND hag < 0.7) AS band1, max(hag) FILTER (hag >= 0.7) AS band2,
avg(CASE WHEN hi > lo THEN greatest(0, least(1, (intensity - lo) / (hi - lo))) END) FILTER (hag >= 0.4) AS intensity, count(*) AS n FROM hag LEFT JOIN rng USING (tile_id, year) WHERE hag BETWEEN 0 AND 1.3 GROUP BY ALL)"""
B6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("band0", "band1", "band2", "intensity"))


@query("pc09_feature_bands", f"WITH {BANDS} SELECT tile_id, year, row, col, {B6}, n FROM bands")
def _(t):
    b = P.feature_bands(hags(t), BY, 1.3)
    return b.select(*BY, "row", "col", *[F.round(c, 6).alias(c) for c in ("band0", "band1", "band2", "intensity")], "n")


@query("pc10_band_merge", f"WITH {BANDS} SELECT tile_id, year, row, col, round(greatest(band0, band1, band2), 6) AS chm, round(coalesce(band0, 0), 6) AS r, round(coalesce(band1, 0), 6) AS g, round(coalesce(band2, 0), 6) AS b FROM bands")
def _(t):
    b = P.feature_bands(hags(t), BY, 1.3)
    return b.select(*BY, "row", "col", F.round(F.greatest("band0", "band1", "band2"), 6).alias("chm"), *[F.round(F.coalesce(f"band{i}", F.lit(0.0)), 6).alias(c) for i, c in enumerate("rgb")])


@query("pc11_delta_vs_baseline", f"WITH {CELL}, {MED}, {LOW} SELECT tile_id, year, row, col, round(med.ground - low.ground, 6) AS delta FROM med JOIN low USING (tile_id, year, row, col)")
def _(t):
    c = cells(t)
    low = P.surface(c, BY, "lowest").withColumnRenamed("ground", "base")
    return P.surface(c, BY, "median").join(low, [*BY, "row", "col"]).select(*BY, "row", "col", F.round(F.col("ground") - F.col("base"), 6).alias("delta"))


VOTES = "v AS (SELECT tile_id, row, col, count(*) AS votes, count(*) FILTER (classification = 1) AS v1, count(*) FILTER (classification = 2) AS v2, count(*) FILTER (classification = 6) AS v6 FROM cells WHERE year <> 2000 GROUP BY ALL)"


@query("pc12_class_votes", f"WITH {CELL}, {VOTES} SELECT tile_id, row, col, votes, CAST(v1 AS BIGINT) AS v1, CAST(v2 AS BIGINT) AS v2, CAST(v6 AS BIGINT) AS v6 FROM v")
def _(t):
    return P.votes(cells(t).filter("year <> 2000"), ["tile_id"], classes=[1, 2, 6]).select("tile_id", "row", "col", "votes", "v1", "v2", "v6")


CONS = f"""WITH {CELL}, {VOTES}, w AS (SELECT *, greatest(v1, v2, v6) AS top, CASE WHEN (v1 = greatest(v1, v2, v6))::INT + (v2 = greatest(v1, v2, v6))::INT + (v6 = greatest(v1, v2, v6))::INT = 1 THEN CASE greatest(v1, v2, v6) WHEN v1 THEN 1 WHEN v2 THEN 2 ELSE 6 END END AS winner FROM v)
SELECT point_id, CASE WHEN votes >= 5 AND top / votes >= 0.6 AND winner IS NOT NULL AND classification <> 6 THEN winner ELSE classification END AS new_class FROM (SELECT * FROM cells WHERE year = 2000) LEFT JOIN w USING (tile_id, row, col)"""


@query("pc13_consensus_class", CONS)
def _(t):
    c = cells(t)
    voted = P.votes(c.filter("year <> 2000"), ["tile_id"], classes=[1, 2, 6])
    return P.consensus(c.filter("year = 2000"), voted, ["tile_id"], preserved=[6]).select("point_id", "new_class")


@query("join20_ground_lookup", f"WITH {CELL}, {LOW} SELECT point_id, round(z - ground, 6) AS hag FROM cells JOIN low USING (tile_id, year, row, col)")
def _(t):
    c = cells(t)
    return P.heights(c, P.surface(c, BY, "lowest"), BY).select("point_id", F.round("hag", 6).alias("hag"))


@query("join21_cell_votes", f"WITH {CELL}, {VOTES} SELECT point_id, coalesce(votes, 0) AS votes FROM (SELECT * FROM cells WHERE year = 2000) LEFT JOIN v USING (tile_id, row, col)")
def _(t):
    c = cells(t)
    v = P.votes(c.filter("year <> 2000"), ["tile_id"], classes=[1, 2, 6]).select("tile_id", "row", "col", "votes")
    return c.filter("year = 2000").join(v, ["tile_id", "row", "col"], "left").select("point_id", F.coalesce("votes", F.lit(0).cast("long")).alias("votes"))


@query("pc14_robust_scale", "WITH q AS (SELECT quantile_cont(z, 0.01) AS a, quantile_cont(z, 0.99) AS b, quantile_cont(intensity, 0.01) AS c, quantile_cont(intensity, 0.99) AS d FROM points) SELECT point_id, round(greatest(0, least(1, (z - a) / (b - a))), 6) AS z, round(greatest(0, least(1, (intensity - c) / (d - c))), 6) AS intensity FROM points, q")
def _(t):
    return P.robust_scale(t.points().select("point_id", "z", "intensity"), ["z", "intensity"]).select("point_id", F.round("z", 6).alias("z"), F.round("intensity", 6).alias("intensity"))


@query("pc15_return_features", "SELECT point_id, CASE WHEN number_of_returns = 1 THEN 1 ELSE 0 END AS is_single, CASE WHEN return_number = 1 THEN 1 ELSE 0 END AS is_first, CASE WHEN return_number = number_of_returns THEN 1 ELSE 0 END AS is_last, CASE WHEN return_number > 1 AND return_number < number_of_returns THEN 1 ELSE 0 END AS is_middle, round(return_number / number_of_returns, 6) AS return_ratio, round(CASE WHEN nir + intensity <> 0 THEN (nir - intensity) / (nir + intensity) ELSE 0 END, 6) AS index FROM points")
def _(t):
    cols = ["is_single", "is_first", "is_last", "is_middle"]
    return P.return_features(t.points()).select("point_id", *cols, F.round("return_ratio", 6).alias("return_ratio"), F.round("index", 6).alias("index"))


K8 = """near AS (SELECT p.point_id, p.z, min({'d': sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y) + (p.z - g.z) * (p.z - g.z)), 'id': g.point_id, 'x': g.x, 'y': g.y, 'z': g.z}, 8) AS n
FROM points p JOIN points g ON p.tile_id = g.tile_id AND p.year = g.year AND p.point_id <> g.point_id GROUP BY ALL),
n8 AS (SELECT point_id, z, unnest(range(1, len(n) + 1)) AS rk, unnest(n) AS n FROM near)"""
# the eigenvalues of a symmetric 3x3 matrix in closed form, largest first; the normal as the longest cross product of rows less the least
EIGEN = """cov AS (SELECT point_id, var_samp(n.x) AS xx, var_samp(n.y) AS yy, var_samp(n.z) AS zz, covar_samp(n.x, n.y) AS xy, covar_samp(n.x, n.z) AS xz, covar_samp(n.y, n.z) AS yz,
  count(*) FILTER (n.d <= 1) AS near, stddev_pop(n.z) AS zs, max(z) - min(n.z) AS above FROM n8 GROUP BY ALL),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov), p AS (SELECT *, sqrt((power(xx - q, 2) + power(yy - q, 2) + power(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p > 0 THEN ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (p * p * p) / 2 END AS r FROM p),
phi AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS phi FROM r),
raw AS (SELECT *, coalesce(q + 2 * p * cos(phi), q) AS a, coalesce(q + 2 * p * cos(phi + 2 * 3.141592653589793 / 3), q) AS c FROM phi),
mat AS (SELECT *, [[xx - c, xy, xz], [xy, yy - c, yz], [xz, yz, zz - c]] AS m FROM raw),
cr AS (SELECT *, list_transform([[1, 2], [1, 3], [2, 3]], lambda k: [m[k[1]][2] * m[k[2]][3] - m[k[1]][3] * m[k[2]][2], m[k[1]][3] * m[k[2]][1] - m[k[1]][1] * m[k[2]][3], m[k[1]][1] * m[k[2]][2] - m[k[1]][2] * m[k[2]][1]]) AS cs FROM mat),
nm AS (SELECT *, list_sort(list_transform(cs, lambda v: {'n': list_dot_product(v, v), 'z': v[3] * v[3]}))[3] AS nv, list_sort(list_transform(m, lambda v: {'n': list_dot_product(v, v), 'z': v[3] * v[3]}))[3] AS ax FROM cr),
l AS (SELECT *, greatest(a, 1e-12) AS l1, greatest(3 * q - a - c, 1e-12) AS l2, greatest(c, 1e-12) AS l3,
  1 - sqrt(greatest(0, CASE WHEN nv.n > 1e-18::DOUBLE * power(a, 4) THEN nv.z / nv.n WHEN ax.n > 1e-18::DOUBLE * power(a, 2) THEN 1 - ax.z / ax.n ELSE 1 END)) AS up FROM nm)"""
SHAPES = """round((l1 - l2) / l1, 3) AS linearity, round((l2 - l3) / l1, 3) AS planarity, round(l3 / l1, 3) AS scattering, round((l1 - l3) / l1, 3) AS anisotropy, round(cbrt(l1 * l2 * l3), 3) AS omnivariance,
round(-(l1 * ln(l1) + l2 * ln(l2) + l3 * ln(l3)), 3) AS eigenentropy, round(l3 / (l1 + l2 + l3), 3) AS surface_variation, round(up, 3) AS verticality, round(zs, 3) AS local_z_std, round(above, 3) AS height_above_local_min,
round(near / 3.141592653589793, 3) AS density_radius, round((l1 - l2) / l1 * up, 3) AS skeleton_proxy"""
SHAPE_NAMES = ["linearity", "planarity", "scattering", "anisotropy", "omnivariance", "eigenentropy", "surface_variation", "verticality", "local_z_std", "height_above_local_min", "density_radius", "skeleton_proxy"]


def eight(t):
    return spatial.nearest(t.points(), t.points(), BY, ["x", "y", "z"], "point_id", "point_id", 8)


@query("join19_nearest_neighbours", f"WITH {K8} SELECT point_id, CAST(rk AS INTEGER) AS rk, n.id AS neighbour, round(n.d, 6) AS d FROM n8")
def _(t):
    return eight(t).select("point_id", "rk", "neighbour", F.round("d", 6).alias("d"))


@query("pc16_shape_features", f"WITH {K8}, {EIGEN} SELECT point_id, {SHAPES} FROM l")
def _(t):
    near = spatial.nearest_lists(t.points(), t.points(), BY, ["x", "y", "z"], "point_id", "point_id", 8, place=True)
    return P.shape_features(near, BY).select("point_id", *[F.round(c, 3).alias(c) for c in SHAPE_NAMES])


@query(
    "pc17_experiment_grid",
    "WITH " + CELL + ", m AS (SELECT unnest(['median', 'lowest']) AS dtm), r AS (SELECT unnest(['all', 'last', 'last2']) AS mode), g AS (SELECT 'median' AS dtm, tile_id, year, row, col, median(z) AS ground FROM cells WHERE classification = 2 GROUP BY ALL UNION ALL SELECT 'lowest', tile_id, year, row, col, min(z) FROM cells WHERE classification = 2 GROUP BY ALL) SELECT c.tile_id, c.year, g.dtm, r.mode, count(*) AS points, round(max(z - ground), 6) AS max_hag, round(avg(z - ground), 6) AS mean_hag FROM cells c JOIN g ON c.tile_id = g.tile_id AND c.year = g.year AND c.row = g.row AND c.col = g.col, r WHERE z - ground BETWEEN 0 AND 1.3 AND (r.mode = 'all' OR (r.mode = 'last' AND return_number = number_of_returns) OR (r.mode = 'last2' AND return_number >= greatest(1, number_of_returns - 1))) GROUP BY ALL",
)
def _(t):
    c = cells(t)
    parts = None
    for dtm in ("median", "lowest"):
        h = P.heights(c, P.surface(c, BY, dtm), BY, most=1.3)
        rn, nr = F.col("return_number"), F.col("number_of_returns")
        modes = F.array_compact(F.array(F.lit("all"), F.when(rn == nr, "last"), F.when(rn >= F.greatest(F.lit(1), nr - 1), "last2")))
        g = h.select(*BY, "hag", F.explode(modes).alias("mode")).groupBy(*BY, "mode").agg(F.count("*").alias("points"), F.round(F.max("hag"), 6).alias("max_hag"), F.round(F.avg("hag"), 6).alias("mean_hag")).withColumn("dtm", F.lit(dtm))
        parts = g if parts is None else parts.unionByName(g)
    return parts
