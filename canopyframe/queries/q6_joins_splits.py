"""Joins, audits, splits and leak checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopyframe.functions import keys as K
from canopyframe.operators import detections as D
from canopyframe.operators import folds
from canopyframe.operators import labels as L
from canopyframe.operators import spatial
from canopyframe.operators import splits as S
from canopyframe.queries import split_sql as Q
from canopyframe.queries.base import query


def chips(t):
    return K.with_identity(L.latest(t.label_events()))


def curated(t):
    return K.with_identity(L.curate(t.label_events()))


def rect(df, size=128):
    return df.withColumns({"minx": F.col("col_off"), "maxx": F.col("col_off") + size, "miny": F.col("row_off"), "maxy": F.col("row_off") + size})


H32 = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
SPLITS = "sp AS (SELECT *, CASE WHEN arrival % 10 < 7 THEN 'train' WHEN arrival % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM curated)"


def with_split(df):
    a = F.col("arrival") % 10
    return df.withColumn("split", F.when(a < 7, "train").when(a < 8, "val").otherwise("test"))


@query(
    "join01_matching_triples",
    "WITH f AS (SELECT mapsheet, year, sample_id, p_partkey FROM samples) SELECT mapsheet, year, min(g) AS gauss, min(r) AS raw, min(b) AS base FROM (SELECT mapsheet, year, min(sample_id) AS g FROM f WHERE p_partkey % 3 = 0 GROUP BY ALL) JOIN (SELECT mapsheet, year, min(sample_id) AS r FROM f WHERE p_partkey % 4 = 0 GROUP BY ALL) USING (mapsheet, year) JOIN (SELECT mapsheet, year, min(sample_id) AS b FROM f WHERE p_partkey % 5 = 0 GROUP BY ALL) USING (mapsheet, year) GROUP BY ALL",
)
def _(t):
    s = t.samples()
    first = lambda m, n: s.filter(F.col("p_partkey") % m == 0).groupBy("mapsheet", "year").agg(F.min("sample_id").alias(n))
    return first(3, "gauss").join(first(4, "raw"), ["mapsheet", "year"]).join(first(5, "base"), ["mapsheet", "year"])


@query("join02_labels_by_variant", "SELECT s.sample_id, l.raster, l.row_off, l.col_off, l.label FROM latest l JOIN samples s ON CAST(s.mapsheet AS INTEGER) = CAST(l.tile AS INTEGER) - 436640 + 436640 AND CAST(s.year AS VARCHAR) = l.year WHERE s.has_raw")
def _(t):
    s = t.samples().filter("has_raw").select("sample_id", F.col("mapsheet").alias("tile"), F.col("year").cast("string").alias("year"))
    return chips(t).join(s, ["tile", "year"]).select("sample_id", "raster", "row_off", "col_off", "label")


REG = "SELECT sample_id, p_partkey, has_raw, has_gauss, has_baseline, has_label, has_label AND (has_raw OR has_gauss OR has_baseline) AS trainable FROM (SELECT sample_id, min(p_partkey) AS p_partkey, bool_or(has_raw) AS has_raw, bool_or(has_gauss) AS has_gauss, bool_or(has_baseline) AS has_baseline, bool_or(has_label) AS has_label FROM samples GROUP BY sample_id)"


def registry(t):
    from canopyframe.operators.registry import sample_registry

    s = t.samples()
    base = s.groupBy("sample_id").agg(F.min("p_partkey").alias("p_partkey"))
    return sample_registry(base, {n: s.filter(f"has_{n}") for n in ("raw", "gauss", "baseline", "label")})


@query("join03_sample_registry", REG)
def _(t):
    return registry(t)


@query(
    "snk06_manifest_merge",
    """WITH c AS (SELECT name AS filename, folder, year, size_bytes FROM files WHERE name LIKE '%.laz'), p AS (SELECT name AS filename, v AS line, CASE WHEN year = 2018 THEN NULL ELSE 'sheet' || year END AS mapsheet, 'list' || v || '/' || name AS url FROM files, (SELECT unnest([1, 2]) AS v) WHERE year <> 2020 AND (v = 1 OR year = 2019)),
    o AS (SELECT filename, arg_max({'m': mapsheet, 'u': url}, line) AS o FROM p GROUP BY filename)
    SELECT coalesce(c.filename, o.filename) AS filename, coalesce(o.m, CASE WHEN c.filename IS NOT NULL THEN split_part(folder, '/', 2) END) AS mapsheet, coalesce(o.u, CASE WHEN c.filename IS NOT NULL THEN '' END) AS url, folder, year, size_bytes,
      CASE WHEN c.filename IS NULL THEN 'gone' WHEN o.filename IS NULL THEN 'new' ELSE 'kept' END AS status FROM c FULL JOIN o ON c.filename = o.filename""",
)
def _(t):
    from canopyframe.operators.registry import merge_manifest

    current = t.files().filter("name LIKE '%.laz'").withColumnRenamed("name", "filename")
    lines = t.files().filter("year <> 2020").select(F.col("name").alias("filename"), "year", F.explode(F.array(F.lit(1), F.lit(2))).alias("line")).filter("line = 1 OR year = 2019")
    sheet = F.when(F.col("year") != 2018, F.concat(F.lit("sheet"), F.col("year").cast("string")))
    previous = lines.select("filename", "line", sheet.alias("mapsheet"), F.concat(F.lit("list"), F.col("line").cast("string"), F.lit("/"), F.col("filename")).alias("url"))
    return merge_manifest(current, previous, {"mapsheet": F.split("folder", "/")[1], "url": F.lit("")})


@query("snk06_variants", f"WITH r AS ({REG}) SELECT sample_id, v AS variant, CASE v WHEN 'raw' THEN has_raw WHEN 'gauss' THEN has_gauss ELSE has_baseline END AS tif_exists, has_label AND CASE v WHEN 'raw' THEN has_raw WHEN 'gauss' THEN has_gauss ELSE has_baseline END AS trainable FROM r, (SELECT unnest(['raw', 'gauss', 'baseline']) AS v)")
def _(t):
    from canopyframe.operators.registry import variants

    return variants(registry(t), ["raw", "gauss", "baseline"])


@query("src08_sample_records", f"WITH r AS ({REG}) SELECT sample_id FROM r WHERE trainable AND has_gauss")
def _(t):
    return registry(t).filter("trainable AND has_gauss").select("sample_id")


@query(
    "join06_window_labels",
    """WITH w AS (SELECT DISTINCT raster, unnest(range(0, 512, 64)) AS r FROM latest), g AS (SELECT raster, CAST(r AS INTEGER) AS row_off, CAST(unnest(range(0, 512, 64)) AS INTEGER) AS col_off FROM w),
    l AS (SELECT *, row_number() OVER (PARTITION BY raster, row_off, col_off ORDER BY source IN ('manual', 'auto_reviewed') DESC, arrival) AS rn FROM label_events WHERE label <> 'unknown') SELECT g.raster, g.row_off, g.col_off, l.label, l.source FROM g LEFT JOIN l ON g.raster = l.raster AND g.row_off = l.row_off AND g.col_off = l.col_off AND rn = 1""",
)
def _(t):
    e = t.label_events()
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.lit(448), F.lit(64))).alias(c)
    grid = e.select("raster").distinct().select("raster", steps("row_off")).select("raster", "row_off", steps("col_off"))
    best = L.first_per_key(L.labelled(e), L.KEY, K.is_manual().desc(), F.asc("arrival")).select(*L.KEY, "label", "source")
    return grid.join(best, L.KEY, "left")


@query(
    "join07_cascading_lookup",
    """WITH a AS (SELECT raster, max(model_prob) AS v FROM label_events WHERE arrival % 3 = 0 GROUP BY raster), b AS (SELECT tile, year, max(model_prob) AS v FROM parsed WHERE arrival % 5 = 0 GROUP BY tile, year), c AS (SELECT tile, max(model_prob) AS v FROM parsed WHERE arrival % 7 = 0 GROUP BY tile)
    SELECT l.arrival, coalesce(CASE WHEN l.arrival % 2 = 0 THEN a.v END, CASE WHEN l.arrival % 3 = 0 THEN b.v END, c.v) AS seed FROM latest l LEFT JOIN a USING (raster) LEFT JOIN b USING (tile, year) LEFT JOIN c USING (tile)""",
)
def _(t):
    p = K.with_identity(t.label_events())
    top = lambda m, by: p.filter(F.col("arrival") % m == 0).groupBy(*by).agg(F.max("model_prob").alias(f"v{m}"))
    rows = chips(t).join(top(3, ["raster"]), "raster", "left").join(top(5, ["tile", "year"]), ["tile", "year"], "left").join(top(7, ["tile"]), "tile", "left")
    return rows.select("arrival", F.coalesce(F.when(F.col("arrival") % 2 == 0, F.col("v3")), F.when(F.col("arrival") % 3 == 0, F.col("v5")), "v7").alias("seed"))


@query("join08_match_coverage", "SELECT l.year, count(*) AS n, count(c.label) AS matched, round(avg(CASE WHEN c.label IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM latest l LEFT JOIN curated c ON l.raster = c.raster AND l.row_off = c.row_off AND l.col_off = c.col_off AND l.chunk_size = c.chunk_size GROUP BY l.year")
def _(t):
    key = [*L.KEY, "chunk_size"]
    rows = chips(t).join(curated(t).select(*key, F.lit(True).alias("hit")), key, "left")
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.count("hit").alias("matched"), F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6).alias("coverage"))


PAIR = "a.raster = b.raster AND abs(a.row_off - b.row_off) < 128 AND abs(a.col_off - b.col_off) < 128 AND a.arrival < b.arrival"


@query("join09_overlap_pairs", f"SELECT a.arrival AS a, b.arrival AS b FROM curated a JOIN curated b ON {PAIR}")
def _(t):
    r = rect(curated(t)).select("raster", "arrival", "minx", "maxx", "miny", "maxy")
    pairs = spatial.overlapping_rectangles(r, r, ["raster"], 256).filter("a.arrival < b.arrival")
    return pairs.select(F.col("a.arrival").alias("a"), F.col("b.arrival").alias("b"))


@query("join10_conflicts", f"SELECT a.arrival AS a, b.arrival AS b FROM curated a JOIN curated b ON {PAIR} WHERE a.label <> b.label")
def _(t):
    pairs = spatial.near_pairs(curated(t), ["raster"], "row_off", "col_off", "arrival", 128, ["label"])
    return pairs.filter("label_a <> label_b").select(F.col("arrival_a").alias("a"), F.col("arrival_b").alias("b"))


NEAR = "SELECT a.arrival, CAST(count(b.arrival) AS BIGINT) AS near FROM curated a LEFT JOIN curated b ON a.raster = b.raster AND b.label = 'cdw' AND abs(a.row_off - b.row_off) <= 64 AND abs(a.col_off - b.col_off) <= 64 AND a.arrival <> b.arrival GROUP BY a.arrival"


@query("join11_neighbour_counts", NEAR)
def _(t):
    return spatial.neighbour_counts(curated(t), ["raster"], "row_off", "col_off", 64, F.col("label") == "cdw").select("arrival", "near")


@query("qa02_isolated_positives", f"SELECT n.arrival FROM ({NEAR}) n JOIN curated c USING (arrival) WHERE near = 0 AND c.label = 'cdw'")
def _(t):
    return spatial.neighbour_counts(curated(t), ["raster"], "row_off", "col_off", 64, F.col("label") == "cdw").filter("near = 0 AND label = 'cdw'").select("arrival")


@query("join12_distance_semi_join", "SELECT DISTINCT p.place_key FROM parsed p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT grid_x, grid_y FROM parsed WHERE place_key IN ('436640_madal', '439643_tava')) a WHERE greatest(abs(a.grid_x - p.grid_x), abs(a.grid_y - p.grid_y)) <= 1)")
def _(t):
    p = K.identities(t.label_events()).select("place_key", "grid_x", "grid_y").distinct()
    return spatial.within_grid(p, p.filter(F.col("place_key").isin("436640_madal", "439643_tava")), [], "grid_x", "grid_y", 1).select("place_key").distinct()


@query("join13_chip_buffer", "SELECT DISTINCT l.raster, l.row_off, l.col_off FROM latest l JOIN latest a ON l.raster = a.raster AND a.source = 'manual' AND abs(l.row_off // 64 - a.row_off // 64) <= 2 AND abs(l.col_off // 64 - a.col_off // 64) <= 2")
def _(t):
    c = chips(t).withColumn("cr", F.floor(F.col("row_off") / 64)).withColumn("cc", F.floor(F.col("col_off") / 64))
    return spatial.within_grid(c, c.filter("source = 'manual'"), ["raster"], "cr", "cc", 2).select(*L.KEY)


@query("join14_rectangle_anti_join", "SELECT a.arrival FROM latest a WHERE a.source = 'auto' AND NOT EXISTS (SELECT 1 FROM latest m WHERE m.source = 'manual' AND m.raster = a.raster AND abs(a.row_off - m.row_off) < 128 AND abs(a.col_off - m.col_off) < 128)")
def _(t):
    r = rect(chips(t)).select("raster", "arrival", "source", "minx", "maxx", "miny", "maxy")
    auto = r.filter("source = 'auto'")
    hit = spatial.overlapping_rectangles(auto, r.filter("source = 'manual'"), ["raster"], 256).select(F.col("a.arrival").alias("arrival")).distinct()
    return auto.join(hit, "arrival", "left_anti").select("arrival")


@query("join15_rectangle_semi_join", "SELECT a.source, count(*) AS n, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM curated m WHERE m.raster = a.raster AND m.label = 'cdw' AND a.row_off < m.row_off // 256 * 256 + 256 AND m.row_off // 256 * 256 < a.row_off + 128 AND a.col_off < m.col_off // 256 * 256 + 256 AND m.col_off // 256 * 256 < a.col_off + 128)) AS BIGINT) AS inside FROM latest a WHERE a.label = 'no_cdw' GROUP BY a.source".replace("CAST(count(*) FILTER (EXISTS (", "CAST(sum(CASE WHEN EXISTS (").replace("< a.col_off + 128)) AS BIGINT)", "< a.col_off + 128) THEN 1 ELSE 0 END) AS BIGINT)"))
def _(t):
    neg = rect(chips(t).filter("label = 'no_cdw'")).select("raster", "arrival", "source", "minx", "maxx", "miny", "maxy")
    big = curated(t).filter("label = 'cdw'").select("raster", K.parent_offset("row_off", 256).alias("row_off"), K.parent_offset("col_off", 256).alias("col_off")).distinct()
    hit = spatial.overlapping_rectangles(neg, rect(big, 256).select("raster", "minx", "maxx", "miny", "maxy"), ["raster"], 256).select(F.col("a.arrival").alias("arrival")).distinct().withColumn("hit", F.lit(True))
    return neg.join(hit, "arrival", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("inside"))


INST = "inst AS (SELECT arrival AS id, raster, CAST(arrival % 5 AS INTEGER) AS z, CAST(col_off + arrival % 50 AS INTEGER) AS minx, CAST(row_off + arrival % 40 AS INTEGER) AS miny, CAST(col_off + arrival % 50 + 20 + arrival % 90 AS INTEGER) AS maxx, CAST(row_off + arrival % 40 + 10 + arrival % 30 AS INTEGER) AS maxy FROM curated)"


def instances(t):
    a = F.col("arrival")
    c = curated(t).select(a.alias("id"), "raster", (a % 5).cast("int").alias("z"), (F.col("col_off") + a % 50).cast("int").alias("minx"), (F.col("row_off") + a % 40).cast("int").alias("miny"), a)
    return c.select("id", "raster", "z", "minx", "miny", (F.col("minx") + 20 + a % 90).cast("int").alias("maxx"), (F.col("miny") + 10 + a % 30).cast("int").alias("maxy"))


@query(
    "join16_visible_instances",
    f"""WITH {INST}, cl AS (SELECT l.arrival AS tile, i.id, z, greatest(i.minx, l.col_off) AS minx, least(i.maxx, l.col_off + 128) AS maxx, greatest(i.miny, l.row_off) AS miny, least(i.maxy, l.row_off + 128) AS maxy
      FROM latest l JOIN inst i ON l.raster = i.raster AND i.minx < l.col_off + 128 AND i.maxx > l.col_off AND i.miny < l.row_off + 128 AND i.maxy > l.row_off),
    co AS (SELECT a.tile, a.id, greatest(a.minx, b.minx) AS x0, least(a.maxx, b.maxx) AS x1, greatest(a.miny, b.miny) AS y0, least(a.maxy, b.maxy) AS y1 FROM cl a JOIN cl b ON a.tile = b.tile AND (b.z > a.z OR (b.z = a.z AND b.id > a.id)) AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy),
    px AS (SELECT *, max(y1) OVER (PARTITION BY tile, id, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT tile, id, y0, y1, unnest(range(x0, x1)) AS x FROM co)),
    hi AS (SELECT tile, id, sum(greatest(0, y1 - greatest(y0, coalesce(before, y0)))) AS hidden FROM px GROUP BY ALL)
    SELECT tile, id, minx, maxx, miny, maxy, CAST(a - coalesce(hidden, 0) AS BIGINT) AS visible, round((a - coalesce(hidden, 0)) / a, 6) AS share FROM (SELECT *, (maxx - minx) * (maxy - miny) AS a FROM cl) LEFT JOIN hi USING (tile, id) WHERE a > coalesce(hidden, 0)""",
)
def _(t):
    tiles = rect(chips(t)).select("raster", F.col("arrival").alias("tile"), "minx", "maxx", "miny", "maxy")
    return spatial.visible_boxes(tiles, instances(t), ["raster"], 128).withColumn("visible", F.col("visible").cast("long")).withColumn("share", F.round("share", 6))


@query("join17_buffered_lines", f"WITH {INST} SELECT tile, id, px FROM (SELECT l.arrival AS tile, i.id, (least(l.col_off + 128, i.maxx + 5) - greatest(l.col_off, i.minx - 5)) * (least(l.row_off + 128, i.maxy + 5) - greatest(l.row_off, i.miny - 5)) AS px FROM latest l JOIN inst i ON l.raster = i.raster AND i.minx - 5 < l.col_off + 128 AND i.maxx + 5 > l.col_off AND i.miny - 5 < l.row_off + 128 AND i.maxy + 5 > l.row_off) WHERE px >= 200")
def _(t):
    i = instances(t).withColumns({"minx": F.col("minx") - 5, "miny": F.col("miny") - 5, "maxx": F.col("maxx") + 5, "maxy": F.col("maxy") + 5})
    tiles = rect(chips(t)).select("raster", "arrival", "minx", "maxx", "miny", "maxy")
    p = spatial.overlapping_rectangles(tiles, i, ["raster"], 128)
    side = lambda lo, hi: F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}")
    return p.select(F.col("a.arrival").alias("tile"), F.col("b.id").alias("id"), (side("minx", "maxx") * side("miny", "maxy")).alias("px")).filter("px >= 200")


@query("join22_temporal_views", "SELECT arrival, year, other FROM (SELECT a.arrival, b.year, b.arrival AS other, row_number() OVER (PARTITION BY a.arrival, b.year ORDER BY b.arrival = a.arrival DESC, b.raster = a.raster DESC, b.arrival DESC) AS rn FROM (SELECT * FROM latest WHERE source = 'manual') a JOIN latest b ON a.place_key = b.place_key AND a.row_off = b.row_off AND a.col_off = b.col_off) WHERE rn = 1")
def _(t):
    c = chips(t)
    b = c.select("place_key", "row_off", "col_off", "year", F.col("arrival").alias("other"), F.col("raster").alias("other_raster"))
    j = c.filter("source = 'manual'").select("place_key", "row_off", "col_off", "arrival", "raster").join(b, ["place_key", "row_off", "col_off"])
    w = Window.partitionBy("arrival", "year").orderBy((F.col("other") == F.col("arrival")).desc(), (F.col("other_raster") == F.col("raster")).desc(), F.desc("other"))
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("arrival", "year", "other")


@query("join23_product_views", "SELECT a.p_partkey, list(b.prod ORDER BY b.ord) AS products FROM samples a JOIN (SELECT mapsheet, year, 'raw' AS prod, 1 AS ord FROM samples WHERE has_raw GROUP BY ALL UNION ALL SELECT mapsheet, year, 'gauss', 2 FROM samples WHERE has_gauss GROUP BY ALL UNION ALL SELECT mapsheet, year, 'baseline', 3 FROM samples WHERE has_baseline GROUP BY ALL) b ON a.mapsheet = b.mapsheet AND a.year = b.year GROUP BY a.p_partkey")
def _(t):
    s = t.samples()
    per = s.groupBy("mapsheet", "year").agg(*[F.max(f"has_{n}").alias(n) for n in ("raw", "gauss", "baseline")])
    products = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in ("raw", "gauss", "baseline")]))
    return s.join(per.select("mapsheet", "year", products.alias("products")), ["mapsheet", "year"]).select("p_partkey", "products").filter(F.size("products") > 0)


@query("join24_temporal_archive", "SELECT raster, other FROM (SELECT DISTINCT a.raster, b.raster AS other, row_number() OVER (PARTITION BY a.raster, b.year ORDER BY b.site = 'madal' DESC, b.raster) AS rn FROM (SELECT DISTINCT raster, tile, year FROM parsed) a JOIN (SELECT DISTINCT raster, tile, year, site FROM parsed) b ON a.tile = b.tile AND a.year <> b.year) WHERE rn = 1")
def _(t):
    r = K.identities(t.label_events()).select("raster", "tile", "year", "site")
    j = r.select("raster", "tile", F.col("year").alias("y")).join(r.select(F.col("raster").alias("other"), "tile", "year", "site"), "tile").filter("y <> year")
    w = Window.partitionBy("raster", "year").orderBy((F.col("site") == "madal").desc(), "other")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("raster", "other")


@query("join25_neighbourhood", "SELECT a.arrival, d.dr, d.dc, b.arrival AS neighbour FROM (SELECT * FROM latest WHERE source = 'manual') a CROSS JOIN (SELECT CAST(x.i AS INTEGER) AS dr, CAST(z.i AS INTEGER) AS dc FROM (SELECT unnest([-1, 0, 1]) AS i) x, (SELECT unnest([-1, 0, 1]) AS i) z WHERE x.i <> 0 OR z.i <> 0) d LEFT JOIN latest b ON a.raster = b.raster AND b.row_off = a.row_off + 64 * d.dr AND b.col_off = a.col_off + 64 * d.dc")
def _(t):
    c = chips(t)
    want = c.filter("source = 'manual'").select("raster", "arrival", "row_off", "col_off", spatial.shifted(1).alias("s")).filter("s.dx <> 0 OR s.dy <> 0")
    want = want.select("raster", "arrival", F.col("s.dx").alias("dr"), F.col("s.dy").alias("dc"), (F.col("row_off") + 64 * F.col("s.dx")).alias("row_off"), (F.col("col_off") + 64 * F.col("s.dy")).alias("col_off"))
    return want.join(c.select(*L.KEY, F.col("arrival").alias("neighbour")), L.KEY, "left").select("arrival", "dr", "dc", "neighbour")


@query("join26_tile_adjacency", "WITH t AS (SELECT DISTINCT year, tile, grid_x, grid_y FROM parsed) SELECT a.year, a.tile AS a, b.tile AS b, CASE WHEN a.grid_x = b.grid_x THEN 'horizontal' WHEN a.grid_y = b.grid_y THEN 'vertical' ELSE 'corner' END AS kind FROM t a JOIN t b ON a.year = b.year AND a.tile < b.tile AND abs(a.grid_x - b.grid_x) <= 1 AND abs(a.grid_y - b.grid_y) <= 1")
def _(t):
    p = K.identities(t.label_events()).select("year", "tile", "grid_x", "grid_y").distinct()
    pairs = spatial.near_pairs(p, ["year"], "grid_x", "grid_y", "tile", 1, [], strict=False)
    kind = F.when(F.col("grid_x_a") == F.col("grid_x_b"), "horizontal").when(F.col("grid_y_a") == F.col("grid_y_b"), "vertical").otherwise("corner")
    return pairs.select("year", F.col("tile_a").alias("a"), F.col("tile_b").alias("b"), kind.alias("kind"))


@query("join27_temporal_anti_join", f"WITH {SPLITS} SELECT arrival FROM sp WHERE split = 'train' AND place_key || row_off NOT IN (SELECT place_key || row_off FROM sp WHERE split = 'test')")
def _(t):
    s = with_split(curated(t))
    return s.filter("split = 'train'").join(s.filter("split = 'test'").select("place_key", "row_off").distinct(), ["place_key", "row_off"], "left_anti").select("arrival")


@query("join28_fence_anti_join", f"WITH {SPLITS} SELECT arrival FROM sp a WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM sp b WHERE b.split = 'test' AND a.raster = b.raster AND a.row_off // 128 = b.row_off // 128 AND a.col_off // 128 = b.col_off // 128)")
def _(t):
    s = with_split(curated(t)).withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}).withColumn("fence", S.fence_id(20.0, 128))
    return s.filter("split = 'train'").join(s.filter("split = 'test'").select("fence").distinct(), "fence", "left_anti").select("arrival")


# audits


@query("qa01_disagreements", "SELECT arrival, round(abs(model_prob - CASE WHEN label = 'cdw' THEN 1 ELSE 0 END), 6) AS gap FROM curated WHERE abs(model_prob - CASE WHEN label = 'cdw' THEN 1 ELSE 0 END) > 0.605")
def _(t):
    return L.disagreements(curated(t), 0.605).select("arrival", F.round("gap", 6).alias("gap"))


@query("qa03_conflict_summary", f"SELECT a.raster, count(*) AS conflicts FROM curated a JOIN curated b ON {PAIR} WHERE a.label <> b.label GROUP BY a.raster")
def _(t):
    pairs = spatial.near_pairs(curated(t), ["raster"], "row_off", "col_off", "arrival", 128, ["label"])
    return pairs.filter("label_a <> label_b").groupBy("raster").agg(F.count("*").alias("conflicts"))


@query("qa04_borderline", "SELECT arrival FROM latest WHERE model_prob BETWEEN 0.32 AND 0.68")
def _(t):
    return L.borderline(chips(t), 0.9).select("arrival")


STRAT = "SELECT raster, row_off, col_off, label, arrival, row_number() OVER (PARTITION BY raster, label ORDER BY md5('s|' || raster || '|' || row_off || '|' || col_off), raster, row_off, col_off) AS rn, count(*) OVER (PARTITION BY raster, label) AS n FROM {0}"


@query("top05_stratified_sample", f"SELECT arrival FROM ({STRAT.format('latest')}) WHERE rn <= greatest(1, round_even(n * 0.1, 0))")
def _(t):
    return L.stratified_sample(chips(t), ["raster", "label"], 0.1, L.KEY, "s").select("arrival")


@query("qa05_spot_check", f"SELECT arrival FROM ({STRAT.format('curated')}) WHERE rn <= greatest(1, round_even(n * 0.05, 0))")
def _(t):
    return L.stratified_sample(curated(t), ["raster", "label"], 0.05, L.KEY, "s").select("arrival")


QUEUE = f"""WITH q AS (SELECT raster, row_off, col_off, 'disagreement' AS "check", 1 AS priority FROM curated WHERE abs(model_prob - CASE WHEN label = 'cdw' THEN 1 ELSE 0 END) > 0.605
UNION ALL SELECT c.raster, c.row_off, c.col_off, 'isolated', 2 FROM ({NEAR}) n JOIN curated c USING (arrival) WHERE near = 0 AND c.label = 'cdw'
UNION ALL SELECT a.raster, a.row_off, a.col_off, 'conflict', 3 FROM curated a JOIN curated b ON {PAIR.replace("a.arrival < b.arrival", "a.arrival <> b.arrival")} WHERE a.label <> b.label
UNION ALL SELECT raster, row_off, col_off, 'borderline', 4 FROM curated WHERE model_prob BETWEEN 0.32 AND 0.68)"""


def review_queue(t):
    c = curated(t)
    iso = spatial.neighbour_counts(c, ["raster"], "row_off", "col_off", 64, F.col("label") == "cdw").filter("near = 0 AND label = 'cdw'")
    pairs = spatial.near_pairs(c, ["raster"], "row_off", "col_off", "arrival", 128, ["label"]).filter("label_a <> label_b")
    conf = pairs.select("raster", F.explode(F.array(F.struct(F.col("row_off_a").alias("row_off"), F.col("col_off_a").alias("col_off")), F.struct(F.col("row_off_b").alias("row_off"), F.col("col_off_b").alias("col_off")))).alias("k")).select("raster", "k.*")
    return L.review_queue([("disagreement", 1, L.disagreements(c, 0.605)), ("isolated", 2, iso), ("conflict", 3, conf), ("borderline", 4, L.borderline(c, 0.9))])


@query("win09_review_queue", QUEUE + """ SELECT raster, row_off, col_off, min(priority) AS priority, arg_min("check", priority) AS "check" FROM q GROUP BY raster, row_off, col_off""")
def _(t):
    return review_queue(t)


@query("qa06_queue_summary", QUEUE + """ SELECT "check", count(*) AS n FROM (SELECT raster, row_off, col_off, arg_min("check", priority) AS "check" FROM q GROUP BY raster, row_off, col_off) GROUP BY "check" """)
def _(t):
    return review_queue(t).groupBy("check").agg(F.count("*").alias("n"))


AUDIT = "CASE WHEN abs(model_prob - 0.5) < 0.1 THEN 1 WHEN source = 'auto' AND model_prob > 0.9 THEN 2 WHEN source = 'auto_skip' THEN 3 END"


@query("win08_audit_dedup", f"SELECT raster, row_off, col_off, min({AUDIT}) AS priority, round(min(abs(model_prob - 0.5)), 6) AS conf FROM label_events WHERE {AUDIT} IS NOT NULL GROUP BY ALL ORDER BY priority, conf LIMIT 100000")
def _(t):
    p = F.when(F.abs(F.col("model_prob") - 0.5) < 0.1, 1).when((F.col("source") == "auto") & (F.col("model_prob") > 0.9), 2).when(F.col("source") == "auto_skip", 3)
    rows = t.label_events().withColumn("p", p).filter("p IS NOT NULL")
    return rows.groupBy(*L.KEY).agg(F.min("p").alias("priority"), F.round(F.min(F.abs(F.col("model_prob") - 0.5)), 6).alias("conf")).orderBy("priority", "conf")


RANKQ = "r AS (SELECT arrival, tile, round((0.6 * (1 - abs(2 * coalesce(model_prob, 0.5) - 1)) + 0.4 * exp(-0.5 * power((row_off / 512 - 0.3) / 0.2, 2))) / power(count(*) OVER (PARTITION BY tile), 0.5), 9) AS score FROM latest), k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score DESC, arrival) AS rn FROM r)"


def ranking(t):
    base = 0.6 * (1 - F.abs(2 * F.coalesce("model_prob", F.lit(0.5)) - 1)) + 0.4 * K.gaussian_score(F.col("row_off") / 512, 0.3, 0.2)
    # the sheet's row count is joined, so that no window holds a whole sheet
    c = chips(t)
    n = c.groupBy("tile").agg(F.count("*").alias("freq"))
    return c.join(n, "tile").withColumn("score", F.round(base / F.pow("freq", F.lit(0.5)), 9))


@query("qa07_tile_ranking", f"WITH {RANKQ} SELECT arrival, tile, round(score, 6) AS score FROM k")
def _(t):
    return ranking(t).select("arrival", "tile", F.round("score", 6).alias("score"))


@query("win11_capped_ranking", f"WITH {RANKQ} SELECT arrival, tile FROM k WHERE rn <= 3 ORDER BY score DESC, arrival LIMIT 40")
def _(t):
    w = Window.partitionBy("tile").orderBy(F.desc("score"), "arrival")
    return ranking(t).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").orderBy(F.desc("score"), "arrival").limit(40).select("arrival", "tile")


# splits


@query("spl01_block_split", f"WITH RECURSIVE {Q.block_roles("['42']")} SELECT place_key, rows, role FROM ro")
def _(t):
    return S.block_split(S.place_registry(curated(t))).select("place_key", "rows", "role")


@query("spl02_pseudo_blocks", f"WITH p AS (SELECT DISTINCT place_key, grid_x, grid_y, {Q.CRC32.format('place_key')} AS h FROM curated) SELECT place_key, CASE WHEN grid_x % 2 = 0 THEN grid_x // 2 ELSE 10000000 + h % 10000 END AS bx, CASE WHEN grid_x % 2 = 0 THEN grid_y // 2 ELSE 10000000 + h // 10000 % 10000 END AS by FROM p")
def _(t):
    p = S.place_registry(curated(t)).withColumn("grid_x", F.when(F.col("grid_x") % 2 == 0, F.col("grid_x"))).withColumn("grid_y", F.when(F.col("grid_x").isNotNull(), F.col("grid_y")))
    return p.select("place_key", *S.block_of(2))


@query("spl03_distance_split", f"WITH RECURSIVE {Q.LLOYD}, {Q.DISTANCE_ROLES} SELECT place_key, region, rows, role FROM ro")
def _(t):
    return S.distance_split(S.place_registry(curated(t)), fraction=0.1, val_fraction=0.05).select("place_key", "region", "rows", "role")


@query("spl04_lloyd_regions", f"WITH RECURSIVE {Q.LLOYD} SELECT place_key, CAST(CASE WHEN d1 <= d2 AND d1 <= d3 THEN 0 WHEN d2 <= d3 THEN 1 ELSE 2 END AS INTEGER) AS region FROM (SELECT DISTINCT place_key, " + ", ".join(f"(grid_x - a{k}) ** 2 + (grid_y - b{k}) ** 2 AS d{k}" for k in (1, 2, 3)) + " FROM curated, ce)")
def _(t):
    return S.lloyd(S.place_registry(curated(t)), 3, "42").select("place_key", "region")


@query("spl05_raster_chip_split", f"WITH RECURSIVE {Q.chip_roles('raster')} SELECT raster, row_off, col_off, role FROM ro")
def _(t):
    return S.chip_split(curated(t), group="raster").select("raster", "row_off", "col_off", "role")


@query("spl06_place_chip_split", f"WITH RECURSIVE {Q.chip_roles('place_key')} SELECT place_key, raster, row_off, col_off, role FROM ro")
def _(t):
    return S.chip_split(curated(t)).select("place_key", "raster", "row_off", "col_off", "role")


@query("spl06_year_invariant", f"WITH RECURSIVE {Q.chip_roles('place_key')} SELECT count(*) AS positions, count(*) FILTER (roles > 1) AS mixed FROM (SELECT count(DISTINCT role) AS roles FROM ro GROUP BY place_key, row_off, col_off)")
def _(t):
    """Positions of a place, and those with more than one role among its years: none."""
    s = S.chip_split(curated(t)).groupBy("place_key", "row_off", "col_off").agg(F.countDistinct("role").alias("roles"))
    return s.agg(F.count("*").alias("positions"), F.count_if(F.col("roles") > 1).alias("mixed"))


@query("spl07_stride", "SELECT CAST(list_reduce(list(DISTINCT v), lambda a, b: gcd(a, b)) AS INTEGER) AS stride FROM (SELECT unnest([row_off, col_off]) AS v FROM latest) WHERE v > 0")
def _(t):
    return S.infer_stride(chips(t))


ZU = H32.format("'42|' || tile || '|' || cr || '|' || cc") + " % 10000"
ZONE = f"""WITH c AS (SELECT *, row_off // 64 AS cr, col_off // 64 AS cc FROM latest), s AS (SELECT DISTINCT tile, cr, cc FROM c), u AS (SELECT *, {ZU} AS u FROM s),
te AS (SELECT * FROM u WHERE u < 1000), vs AS (SELECT * FROM u WHERE u >= 9000 AND NOT EXISTS (SELECT 1 FROM te WHERE te.tile = u.tile AND greatest(abs(te.cr - u.cr), abs(te.cc - u.cc)) <= 3)),
z AS (SELECT tile, cr, cc, CASE WHEN EXISTS (SELECT 1 FROM te WHERE te.tile = u.tile AND greatest(abs(te.cr - u.cr), abs(te.cc - u.cc)) <= 1) THEN 'test' WHEN EXISTS (SELECT 1 FROM te WHERE te.tile = u.tile AND greatest(abs(te.cr - u.cr), abs(te.cc - u.cc)) <= 3) THEN 'buffer'
 WHEN EXISTS (SELECT 1 FROM vs WHERE vs.tile = u.tile AND greatest(abs(vs.cr - u.cr), abs(vs.cc - u.cc)) <= 1) THEN 'val' ELSE 'train' END AS zone FROM u),
zr AS (SELECT c.*, CASE WHEN zone <> 'train' THEN zone WHEN coalesce(source IN ('manual', 'auto_skip') OR model_prob > 0.95 OR model_prob < 0.05, false) THEN 'train' ELSE 'none' END AS role FROM c JOIN z USING (tile, cr, cc))"""


@query("spl08_zone_split", f"{ZONE} SELECT arrival, role FROM zr")
def _(t):
    return S.zone_split(chips(t)).select("arrival", "role")


@query("agg32_split_comparison", f"{ZONE} SELECT 'zones' AS method, role, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM zr), 4) AS pct, round(100.0 * count(*) FILTER (label = 'cdw') / count(*), 4) AS cdw_pct FROM zr GROUP BY role")
def _(t):
    z = S.zone_split(chips(t)).select(F.lit("zones").alias("method"), "role", "label")
    g = z.groupBy("method", "role").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("label") == "cdw") / F.count("*"), 4).alias("cdw_pct"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("method")), 4))


def clusters(t):
    # the table has thirty places, so a place is a cluster of its own
    return S.cluster_split(curated(t), size=1, fraction=0.1, val_fraction=0.05)


@query("spl09_cluster_split", f"WITH RECURSIVE {Q.CLUSTER_ROLES} SELECT arrival, attempt, role, is_manual, is_pseudo FROM cs")
def _(t):
    return clusters(t).select("arrival", "attempt", "role", "is_manual", "is_pseudo")


LISTS = "(SELECT role AS list, * FROM cs WHERE role IN ('test', 'val', 'train') UNION ALL SELECT 'manual', * FROM cs WHERE is_manual UNION ALL SELECT 'pseudo', * FROM cs WHERE is_pseudo)"


@query("spl09_key_lists", f"WITH RECURSIVE {Q.CLUSTER_ROLES} SELECT DISTINCT list, raster, row_off, col_off FROM {LISTS}")
def _(t):
    return S.cluster_keys(clusters(t))


def map_tiles(t):
    return curated(t).select("arrival", "tile", F.col("place_key").alias("place0"), "row_off", "col_off", (F.col("grid_y") * 1000 + (F.col("col_off") + 64) * 0.2).alias("x"), (6001000 + F.col("grid_x") * 1000 - (F.col("row_off") + 64) * 0.2).alias("y"), "raster", "label").withColumn("place", F.concat_ws("_", "place0", F.col("row_off").cast("string"), F.col("col_off").cast("string")))


MAPT = "mt AS (SELECT arrival, tile, raster, label, place_key || '_' || row_off || '_' || col_off AS place, row_off, col_off, grid_y * 1000 + (col_off + 64) * 0.2::DOUBLE AS x, 6001000 + grid_x * 1000 - (row_off + 64) * 0.2::DOUBLE AS y FROM curated)"


@query(
    "spl10_bisection_split",
    f"""WITH {MAPT}, a AS (SELECT *, CASE WHEN max(x) OVER w - min(x) OVER w >= max(y) OVER w - min(y) OVER w THEN x ELSE y END AS axis, CASE WHEN max(x) OVER w - min(x) OVER w >= max(y) OVER w - min(y) OVER w THEN (min(x) OVER w + max(x) OVER w) / 2 ELSE (min(y) OVER w + max(y) OVER w) / 2 END AS mid FROM mt WINDOW w AS (PARTITION BY tile)),
    s AS (SELECT *, CASE WHEN axis > mid THEN 1 ELSE 0 END AS side, abs(axis - mid) <= 10 AS near FROM a), h AS (SELECT *, CASE WHEN sum(side) OVER (PARTITION BY tile) <= count(*) OVER (PARTITION BY tile) - sum(side) OVER (PARTITION BY tile) THEN 1 ELSE 0 END AS ts FROM s),
    r AS (SELECT *, CASE WHEN near THEN 'buffer' WHEN side = ts THEN 'test' ELSE 'train' END AS role0 FROM h)
    SELECT arrival, CASE WHEN role0 = 'train' AND place IN (SELECT place FROM r WHERE role0 = 'test') THEN 'pruned' WHEN role0 = 'train' AND {H32.format("'42|' || place")} % 100 < 20 THEN 'val' ELSE role0 END AS role FROM r""",
)
def _(t):
    return S.bisection_split(map_tiles(t), buffer_m=10.0).select("arrival", "role")


@query("spl11_fence_groups", f"WITH {MAPT} SELECT 'm' || CAST(CAST(floor(x / 50) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y / 50) AS BIGINT) AS VARCHAR) AS fence, count(*) AS n FROM mt GROUP BY fence")
def _(t):
    return map_tiles(t).withColumn("fence", S.fence_id(50.0, 128)).groupBy("fence").agg(F.count("*").alias("n"))


@query(
    "spl12_block_size_probe",
    f"""WITH {MAPT}, g AS (SELECT b AS block, CAST(CAST(floor(x / b) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y / b) AS BIGINT) AS VARCHAR) AS g, count(*) AS n, count(*) FILTER (label = 'cdw') AS p FROM mt, (SELECT unnest([25.0::DOUBLE, 50.0::DOUBLE, 100.0::DOUBLE]) AS b) GROUP BY ALL),
    f AS (SELECT block, {H32.format("'42|' || CAST(CAST(block AS INTEGER) AS VARCHAR) || '|' || g")} % 5 AS fold, sum(n) AS n, sum(p) AS p, count(*) AS groups FROM g GROUP BY ALL), s AS (SELECT block, CAST(sum(groups) AS BIGINT) AS groups, round(stddev_pop(n) / avg(n), 6) AS size_cv, round(stddev_pop(p / n), 6) AS rate_std, CAST(min(p) AS BIGINT) AS min_pos FROM f GROUP BY block)
    SELECT *, round(size_cv + rate_std + CASE WHEN min_pos <= 0 THEN 1 ELSE 0 END, 6) AS score FROM s""",
)
def _(t):
    return S.probe_block_sizes(map_tiles(t), [25.0, 50.0, 100.0], 5, "42")


@query("spl13_grouped_folds", f"SELECT arrival, CAST({H32.format('''42|'' || place_key || ''_'' || year''').replace(chr(39) * 2, chr(39))} % 5 AS INTEGER) AS fold FROM curated".replace("md5(42|' ||", "md5('42|' ||"))
def _(t):
    return S.grouped_folds(curated(t), F.concat_ws("_", "place_key", "year"), 5, "42").select("arrival", "fold")


@query("spl13_size_ordered_folds", "SELECT place_key, n, CAST(CASE WHEN (rn - 1) % 10 < 5 THEN (rn - 1) % 10 ELSE 9 - (rn - 1) % 10 END AS INTEGER) AS fold FROM (SELECT place_key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, place_key) AS rn FROM curated GROUP BY place_key)")
def _(t):
    g = curated(t).groupBy("place_key").agg(F.count("*").alias("n"))
    return S.size_ordered_folds(g, "place_key", "n", 5)


@query("spl14_leave_one_out", "SELECT raster, count(*) AS n FROM curated GROUP BY raster HAVING count(*) >= 10 AND count(DISTINCT label) = 2")
def _(t):
    return curated(t).groupBy("raster").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).filter("n >= 10 AND k = 2").select("raster", "n")


U = H32.format("'42|' || id")


@query("spl15_instance_split", f"WITH {INST}, u AS (SELECT id, {U} % 100 AS u FROM inst) SELECT id, CASE WHEN u < 70 THEN 'train' WHEN u < 85 THEN 'val' ELSE 'test' END AS split FROM u")
def _(t):
    return S.instance_split(instances(t), "id", "42").select("id", "split")


@query("spl16_buffer_gap", "SELECT arrival, (arrival % 6 + 1) * 64 - chunk_size AS gap_px, round(((arrival % 6 + 1) * 64 - chunk_size) * 0.2::DOUBLE, 1) AS gap_m FROM label_events")
def _(t):
    gap = S.gap_pixels(F.col("arrival") % 6, F.lit(64), F.col("chunk_size"))
    return t.label_events().select("arrival", gap.alias("gap_px"), F.round(gap * 0.2, 1).alias("gap_m"))


@query("x16_place_group_folds", f"WITH RECURSIVE {Q.stratified_folds('curated', 'place_key', 4, 'g')} SELECT arrival, fold FROM curated JOIN sf ON grp = place_key")
def _(t):
    return folds.stratified_group_folds(curated(t), "place_key", "label", ["cdw", "no_cdw"], 4, "g").select("arrival", "fold")


@query("spl13_stratified_folds", f"WITH RECURSIVE {Q.stratified_folds('curated', "place_key || '_' || year", 5, '42')} SELECT fold, count(*) AS n, count(DISTINCT grp) AS groups, count(*) FILTER (label = 'cdw') AS cdw FROM curated JOIN sf ON grp = place_key || '_' || year GROUP BY fold")
def _(t):
    """Folds by place and year: their rows, groups and positives."""
    rows = curated(t).withColumn("grp", F.concat_ws("_", "place_key", F.col("year").cast("string")))
    f = folds.stratified_group_folds(rows, "grp", "label", ["cdw", "no_cdw"], 5, "42")
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"), F.count_if(F.col("label") == "cdw").alias("cdw"))


OR_ = f"WITH {SPLITS}"


@query("leak01_origin_groups", f"{OR_} SELECT place_key, row_off, col_off, list_sort(list(DISTINCT split)) AS splits FROM sp GROUP BY ALL HAVING count(DISTINCT split) > 1")
def _(t):
    return S.origin_leaks(with_split(curated(t)), ["place_key", "row_off", "col_off"])


@query("leak02_overlap_pairs", f"{OR_} SELECT a.arrival AS a, b.arrival AS b, a.split AS split_a, b.split AS split_b FROM sp a JOIN sp b ON {PAIR} WHERE a.split <> b.split")
def _(t):
    return S.overlap_leaks(rect(with_split(curated(t))).withColumnRenamed("arrival", "id"), ["raster"], 256)


REM = f"""WITH RECURSIVE {SPLITS}, e AS (SELECT a.arrival AS a, b.arrival AS b FROM sp a JOIN sp b ON {PAIR.replace("a.arrival < b.arrival", "a.arrival <> b.arrival")}), r(a, b) AS (SELECT arrival, arrival FROM sp UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS arrival, min(b) AS component FROM r GROUP BY a),
p AS (SELECT component, count(*) FILTER (split = 'test') AS te, count(*) FILTER (split = 'val') AS va, count(*) FILTER (split = 'train') AS tr FROM sp JOIN c USING (arrival) GROUP BY component)"""


@query("leak03_remediation", f"{REM} SELECT arrival AS id, component, CASE WHEN te > 0 THEN 'test' WHEN va > 0 THEN 'val' ELSE 'train' END AS new_split FROM c JOIN p USING (component)")
def _(t):
    return S.remediate(rect(with_split(curated(t))).withColumnRenamed("arrival", "id"), ["raster"], 256).select("id", "component", "new_split")


@query("leak03_remediation_majority", f"{REM} SELECT arrival AS id, CASE WHEN te = greatest(te, va, tr) THEN 'test' WHEN va = greatest(te, va, tr) THEN 'val' ELSE 'train' END AS new_split FROM c JOIN p USING (component)")
def _(t):
    return S.remediate(rect(with_split(curated(t))).withColumnRenamed("arrival", "id"), ["raster"], 256, "majority").select("id", "new_split")


@query("gra01_components", f"{REM} SELECT arrival AS node, component FROM c WHERE arrival IN (SELECT a FROM e)")
def _(t):
    from canopyframe.operators.graph import connected_components

    pairs = spatial.near_pairs(curated(t), ["raster"], "row_off", "col_off", "arrival", 128, [])
    return connected_components(pairs, "arrival_a", "arrival_b")


@query(
    "ras21_mosaic_groups",
    "WITH RECURSIVE t AS (SELECT DISTINCT year, tile, grid_x, grid_y FROM parsed), e AS (SELECT a.year, a.tile AS a, b.tile AS b FROM t a JOIN t b ON a.year = b.year AND abs(a.grid_x - b.grid_x) <= 1 AND abs(a.grid_y - b.grid_y) <= 1), r(year, a, b) AS (SELECT year, tile, tile FROM t UNION SELECT r.year, r.a, e.b FROM r JOIN e ON r.year = e.year AND r.b = e.a) SELECT year, a AS tile, min(b) AS component FROM r GROUP BY year, a",
)
def _(t):
    p = K.with_identity(t.label_events()).select("year", "tile", F.col("grid_x").alias("x"), F.col("grid_y").alias("y"))
    return S.touching_components(p, "year")


BOXES = f"{INST}, bo AS (SELECT inst.*, coalesce(model_prob, 0.5::DOUBLE) AS confidence FROM inst JOIN curated ON arrival = id)"


@query("ens06_suppression", f"WITH RECURSIVE {BOXES}, {Q.SUPPRESS} SELECT id, confidence FROM kept")
def _(t):
    return suppressed(t).select("id", "confidence")


def boxes(t):
    return instances(t).join(curated(t).select(F.col("arrival").alias("id"), F.coalesce("model_prob", F.lit(0.5)).alias("confidence")), "id")


def suppressed(t):
    return D.non_maximum_suppression(boxes(t), 128, "raster", least=0.2)


@query(
    "ens06_suppression_invariant",
    f"WITH RECURSIVE {BOXES}, {Q.SUPPRESS} SELECT (SELECT count(*) FROM kept a JOIN kept b ON {Q.OVERLAP} AND a.id < b.id) AS overlapping, (SELECT count(*) FROM bo a WHERE id NOT IN (SELECT id FROM kept) AND NOT EXISTS (SELECT 1 FROM kept b WHERE {Q.OVERLAP} AND (b.confidence, -b.id) > (a.confidence, -a.id))) AS unexplained",
)
def _(t):
    """Kept boxes that overlap another kept one, and dropped boxes without a better kept one: none."""
    from canopyframe.plans.lineage import cut

    b = cut(boxes(t))
    kept = cut(D.non_maximum_suppression(b, 128, "raster", least=0.2))
    bad = D.overlapping_pairs(kept, 128, "raster", least=0.2).select(F.lit(1).alias("o"), F.lit(0).alias("u"))
    pairs = D.overlapping_pairs(b, 128, "raster", least=0.2)
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    why = both.join(kept.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id")).distinct()
    dropped = b.join(kept, "id", "left_anti").join(why, "id", "left_anti").select(F.lit(0).alias("o"), F.lit(1).alias("u"))
    return bad.union(dropped).agg(F.coalesce(F.sum("o"), F.lit(0)).alias("overlapping"), F.coalesce(F.sum("u"), F.lit(0)).alias("unexplained"))


MASKP = "mp AS (SELECT tile_id * 4 + k AS mask, tile_id * 64 + row * 8 + col AS pixel, (k + 1) / 4.0::DOUBLE AS confidence FROM pixels, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE value > 0.8 + 0.1 * k)"


@query(
    "ens05_mask_votes",
    f"""WITH RECURSIVE {MASKP}, s AS (SELECT mask, count(*) AS n, max(confidence) AS c FROM mp GROUP BY mask), i AS (SELECT a.mask AS a, b.mask AS b, count(*) AS i FROM mp a JOIN mp b ON a.pixel = b.pixel AND a.mask <> b.mask GROUP BY ALL),
    e AS (SELECT i.a, i.b FROM i JOIN s x ON x.mask = i.a JOIN s y ON y.mask = i.b WHERE i.i / (x.n + y.n - i.i) > 0.3), r(a, b) AS (SELECT mask, mask FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS mask, min(b) AS cluster FROM r GROUP BY a),
    t AS (SELECT cluster, sum(c) AS total FROM g JOIN s USING (mask) GROUP BY cluster), v AS (SELECT cluster, pixel, sum(c) AS votes FROM mp JOIN g USING (mask) JOIN s USING (mask) GROUP BY ALL) SELECT cluster, pixel FROM v JOIN t USING (cluster) WHERE round(votes / total, 9) > 0.5""",
)
def _(t):
    k = F.explode(F.lit([0, 1, 2, 3]))
    px = t.pixels().select("tile_id", "row", "col", "value", k.alias("k")).filter(F.col("value") > 0.8 + 0.1 * F.col("k"))
    return D.merge_masks(px.select((F.col("tile_id") * 4 + F.col("k")).alias("mask"), (F.col("tile_id") * 64 + F.col("row") * 8 + F.col("col")).alias("pixel"), ((F.col("k") + 1) / 4.0).alias("confidence")))
