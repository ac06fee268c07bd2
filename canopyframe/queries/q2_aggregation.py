"""Aggregations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopyframe.functions import keys as K
from canopyframe.operators import balance as B
from canopyframe.operators import labels as L
from canopyframe.queries.base import query

BAL = "CAST(count(*) FILTER (label = 'cdw') AS BIGINT) AS cdw, CAST(count(*) FILTER (label = 'no_cdw') AS BIGINT) AS no_cdw, count(*) AS total, round(100.0 * count(*) FILTER (label = 'cdw') / count(*), 4) AS cdw_pct, round(count(*) FILTER (label = 'no_cdw') / greatest(count(*) FILTER (label = 'cdw'), 1), 4) AS imbalance"
OK = "label IN ('cdw', 'no_cdw')"


def parsed(t):
    return K.with_identity(t.label_events())


def chips(t):
    """Labelled chips: the last event of each."""
    return K.with_identity(L.latest(t.label_events()))


@query("agg01_global_balance", f"SELECT {BAL} FROM label_events WHERE {OK}")
def _(t):
    return B.class_balance(L.labelled(t.label_events()), [])


for _name, _by in (("mapsheet", "tile"), ("year", "year"), ("source", "source")):

    @query(f"agg02_balance_per_{_name}", f"SELECT {_by}, {BAL} FROM parsed WHERE {OK} GROUP BY {_by}")
    def _(t, by=_by):
        return B.class_balance(L.labelled(parsed(t)), [by])


COVER = "count(*) AS tiles, count(DISTINCT raster) AS rasters, count(DISTINCT tile) AS sheets, round(count(*) / count(DISTINCT raster), 4) AS tiles_per_raster, round(100.0 * count(*) FILTER (label = 'cdw') / count(*), 4) AS cdw_pct"


def coverage(rows, by):
    pct = F.round(100.0 * F.count_if(F.col("label") == "cdw") / F.count("*"), 4)
    return rows.groupBy(*by).agg(F.count("*").alias("tiles"), F.countDistinct("raster").alias("rasters"), F.countDistinct("tile").alias("sheets"), F.round(F.count("*") / F.countDistinct("raster"), 4).alias("tiles_per_raster"), pct.alias("cdw_pct"))


@query("agg03_coverage_by_year", f"SELECT year, {COVER} FROM chips GROUP BY year")
def _(t):
    return coverage(chips(t), ["year"])


@query("agg03_coverage_by_area_type", f"SELECT site, {COVER} FROM chips GROUP BY site")
def _(t):
    return coverage(chips(t), ["site"])


@query("agg04_sheet_year_cube", "SELECT tile, year, count(*) AS tiles, count(DISTINCT raster) AS rasters FROM chips GROUP BY CUBE (tile, year)")
def _(t):
    return chips(t).cube("tile", "year").agg(F.count("*").alias("tiles"), F.countDistinct("raster").alias("rasters"))


@query(
    "agg05_raster_characteristics",
    "SELECT year, count(*) AS rasters, round(avg(n), 4) AS mean_tiles, min(n) AS min_tiles, max(n) AS max_tiles, round(median(n), 4) AS median_tiles FROM (SELECT raster, year, count(*) AS n FROM chips GROUP BY raster, year) GROUP BY year",
)
def _(t):
    per = chips(t).groupBy("raster", "year").agg(F.count("*").alias("n"))
    return per.groupBy("year").agg(F.count("*").alias("rasters"), F.round(F.avg("n"), 4).alias("mean_tiles"), F.min("n").alias("min_tiles"), F.max("n").alias("max_tiles"), F.round(F.median("n"), 4).alias("median_tiles"))


@query("agg06_mapsheet_statistics", "SELECT tile, count(*) AS tiles, count(DISTINCT raster) AS rasters, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year FROM chips GROUP BY tile")
def _(t):
    return chips(t).groupBy("tile").agg(F.count("*").alias("tiles"), F.countDistinct("raster").alias("rasters"), F.countDistinct("year").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query(
    "agg07_data_quality",
    """SELECT count(*) AS rows, CAST(count(*) FILTER (model_prob IS NULL) AS BIGINT) AS null_prob, CAST(count(*) FILTER (label NOT IN ('cdw', 'no_cdw')) AS BIGINT) AS bad_labels,
    CAST(count(*) FILTER (row_off < 0 OR col_off < 0 OR row_off % 64 <> 0) AS BIGINT) AS bad_offsets, min(row_off) AS min_row, max(row_off) AS max_row, min(model_prob) AS min_prob, max(model_prob) AS max_prob,
    (SELECT count(*) FROM (SELECT 1 FROM label_events GROUP BY raster, row_off, col_off HAVING count(*) > 1)) AS duplicate_groups,
    (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM label_events GROUP BY raster, row_off, col_off)) AS surplus_rows FROM label_events""",
)
def _(t):
    e = t.label_events()
    # one pass: chips are summed first, and what is per row is summed with them
    per = e.groupBy(*L.KEY).agg(F.count("*").alias("c"), F.count_if(F.col("model_prob").isNull()).alias("np"), F.count_if(~F.col("label").isin("cdw", "no_cdw")).alias("bl"), F.min("model_prob").alias("lo"), F.max("model_prob").alias("hi"))
    bad = (F.col("row_off") < 0) | (F.col("col_off") < 0) | (F.col("row_off") % 64 != 0)
    return per.agg(
        F.sum("c").alias("rows"),
        F.sum("np").alias("null_prob"),
        F.sum("bl").alias("bad_labels"),
        F.sum(F.when(bad, F.col("c")).otherwise(0)).alias("bad_offsets"),
        F.min("row_off").alias("min_row"),
        F.max("row_off").alias("max_row"),
        F.min("lo").alias("min_prob"),
        F.max("hi").alias("max_prob"),
        F.count_if(F.col("c") > 1).alias("duplicate_groups"),
        F.sum(F.col("c") - 1).alias("surplus_rows"),
    )


@query("agg08_raster_label", "SELECT raster, max(CASE WHEN label = 'cdw' THEN 1 ELSE 0 END) AS label FROM latest GROUP BY raster")
def _(t):
    return L.latest(t.label_events()).groupBy("raster").agg(F.max(F.when(F.col("label") == "cdw", 1).otherwise(0)).alias("label"))


@query("agg09_parent_score", "SELECT raster, CAST(row_off // 256 * 256 AS INTEGER) AS parent_row, CAST(col_off // 256 * 256 AS INTEGER) AS parent_col, round(avg(model_prob), 6) AS score FROM label_events WHERE model_prob IS NOT NULL GROUP BY ALL")
def _(t):
    e = t.label_events().filter("model_prob IS NOT NULL")
    return e.groupBy("raster", K.parent_offset("row_off", 256).alias("parent_row"), K.parent_offset("col_off", 256).alias("parent_col")).agg(F.round(F.avg("model_prob"), 6).alias("score"))


PLACE = "count(*) AS rows, list_sort(list(DISTINCT year)) AS years, CAST(count(*) FILTER (label = 'cdw') AS BIGINT) AS cdw, CAST(count(*) FILTER (label = 'no_cdw') AS BIGINT) AS no_cdw, CAST(count(*) FILTER (reason = 'manual_or_reviewed') AS BIGINT) AS manual, CAST(count(*) FILTER (reason = 'threshold_gate') AS BIGINT) AS gate"


@query("agg10_place_registry", f"SELECT place_key, {PLACE} FROM curated GROUP BY place_key")
def _(t):
    from canopyframe.operators import splits as S

    return S.place_registry(K.with_identity(L.curate(t.label_events()))).select("place_key", "rows", "years", "cdw", "no_cdw", "manual", "gate")


@query(
    "agg11_curation_counters",
    "SELECT reason, count(*) AS n FROM gated GROUP BY reason UNION ALL SELECT 'after_dedup', count(*) FROM curated UNION ALL SELECT 'labelled', count(*) FROM gated",
)
def _(t):
    g = L.gate(t.label_events())
    counted = g.groupBy("reason").agg(F.count("*").alias("n"))
    total = g.agg(F.lit("labelled").alias("reason"), F.count("*").alias("n"))
    return counted.union(L.curate(t.label_events()).agg(F.lit("after_dedup").alias("reason"), F.count("*").alias("n"))).union(total)


@query("agg12_label_counts_rollup", "SELECT raster, CAST(count(*) FILTER (label = 'cdw') AS BIGINT) AS cdw, CAST(count(*) FILTER (label = 'no_cdw') AS BIGINT) AS no_cdw, count(*) AS total FROM latest GROUP BY ROLLUP (raster)")
def _(t):
    rows = L.latest(t.label_events())
    return rows.rollup("raster").agg(F.count_if(F.col("label") == "cdw").alias("cdw"), F.count_if(F.col("label") == "no_cdw").alias("no_cdw"), F.count("*").alias("total"))


@query(
    "agg13_tile_label_summary",
    """SELECT l.year, count(*) AS tiles, count(c.label) AS labelled, round(count(c.label) / count(*), 6) AS coverage, round(count(*) FILTER (c.label = 'cdw') / greatest(count(c.label), 1), 6) AS positive_ratio,
    round(avg(CASE WHEN c.label IS NOT NULL THEN CASE WHEN c.model_prob IS NULL THEN 1.0 WHEN c.label = 'cdw' THEN greatest(c.model_prob, 0.05) ELSE greatest(1 - c.model_prob, 0.05) END END), 6) AS mean_confidence, count(DISTINCT l.place_key) AS places
    FROM latest l LEFT JOIN curated c ON l.raster = c.raster AND l.row_off = c.row_off AND l.col_off = c.col_off GROUP BY l.year""",
)
def _(t):
    e = t.label_events()
    c = L.curate(e).select(*L.KEY, F.col("label").alias("c"), F.col("model_prob").alias("p"))
    rows = K.with_identity(L.latest(e)).join(c, L.KEY, "left")
    conf = F.when(F.col("c").isNotNull(), F.when(F.col("p").isNull(), 1.0).when(F.col("c") == "cdw", F.greatest("p", F.lit(0.05))).otherwise(F.greatest(1 - F.col("p"), F.lit(0.05))))
    n = F.count("c")
    return rows.groupBy("year").agg(F.count("*").alias("tiles"), n.alias("labelled"), F.round(n / F.count("*"), 6).alias("coverage"), F.round(F.count_if(F.col("c") == "cdw") / F.greatest(n, F.lit(1)), 6).alias("positive_ratio"), F.round(F.avg(conf), 6).alias("mean_confidence"), F.countDistinct("place_key").alias("places"))


@query(
    "agg14_density_estimate",
    "SELECT year, label, site, count(*) AS tiles, count(*) * 655.36::DOUBLE AS area_m2, count(*) * 655.36::DOUBLE * 1.0 AS points_low, count(*) * 655.36::DOUBLE * 2.5 AS points_mid, count(*) * 655.36::DOUBLE * 4.0 AS points_high FROM chips GROUP BY GROUPING SETS ((year), (label), (site), ())",
)
def _(t):
    c = chips(t)
    g = c.groupingSets([["year"], ["label"], ["site"], []], "year", "label", "site").agg(F.count("*").alias("tiles"))
    area = F.col("tiles") * 655.36
    return g.select("year", "label", "site", "tiles", area.alias("area_m2"), (area * 1.0).alias("points_low"), (area * 2.5).alias("points_mid"), (area * 4.0).alias("points_high"))


@query("agg15_file_size_density", "SELECT year, count(*) AS n, min(size_bytes) AS min_size, max(size_bytes) AS max_size, round(avg(size_bytes), 3) AS avg_size, round(stddev_samp(size_bytes), 3) AS std_size, median(size_bytes) AS median_size FROM files GROUP BY year")
def _(t):
    s = F.col("size_bytes")
    return t.files().groupBy("year").agg(F.count("*").alias("n"), F.min(s).alias("min_size"), F.max(s).alias("max_size"), F.round(F.avg(s), 3).alias("avg_size"), F.round(F.stddev_samp(s), 3).alias("std_size"), F.median(s).alias("median_size"))


@query(
    "agg16_hag_range_counts",
    "SELECT classification, return_number, count(*) AS n, CAST(count(*) FILTER (z >= 0 AND z < 1.3) AS BIGINT) AS in_range, CAST(count(*) FILTER (z >= 0 AND z < 1.3 AND classification <> 6) AS BIGINT) AS in_range_after_exclusion FROM points GROUP BY GROUPING SETS ((classification), (return_number), ())",
)
def _(t):
    return hag_counts(t.points())


def hag_counts(points):
    """Counts in the height range by class, by return and over all, with and without excluded classes."""
    p = points.select("classification", "return_number", ((F.col("z") >= 0) & (F.col("z") < 1.3)).alias("inside"), (F.col("classification") != 6).alias("wanted"))
    return p.groupingSets([["classification"], ["return_number"], []], "classification", "return_number").agg(F.count("*").alias("n"), F.count_if("inside").alias("in_range"), F.count_if(F.col("inside") & F.col("wanted")).alias("in_range_after_exclusion"))


TRANS = "SELECT from_label, to_label, count(*) AS n FROM (SELECT lag(label) OVER w AS from_label, label AS to_label FROM label_events WINDOW w AS (PARTITION BY raster, row_off, col_off ORDER BY arrival)) WHERE from_label IS NOT NULL GROUP BY from_label, to_label"


@query("agg17_class_transitions", f"SELECT from_label, to_label, n, round(100.0 * n / (SELECT sum(n) FROM ({TRANS})), 4) AS pct FROM ({TRANS}) WHERE from_label <> to_label ORDER BY n DESC, from_label, to_label LIMIT 20")
def _(t):
    w = Window.partitionBy(*L.KEY).orderBy("arrival")
    pairs = t.label_events().select(F.lag("label").over(w).alias("from_label"), F.col("label").alias("to_label")).filter("from_label IS NOT NULL")
    n = pairs.groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
    share = n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
    return share.filter("from_label <> to_label").orderBy(F.desc("n"), "from_label", "to_label").limit(20)


ND = "SELECT tile_id, 100.0 * count(*) FILTER (value IS NULL) / count(*) AS pct FROM pixels GROUP BY tile_id"


@query("agg18_nodata_histogram", f"SELECT CAST(least(floor(pct / 10), 9) AS INTEGER) AS bin, count(*) AS tiles, round(avg(pct), 4) AS mean_pct FROM ({ND}) GROUP BY bin")
def _(t):
    from canopyframe.operators import rasters as R

    return R.nodata_share(t.pixels()).groupBy(F.least(F.floor(F.col("nodata_pct") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("tiles"), F.round(F.avg("nodata_pct"), 4).alias("mean_pct"))


STATS = "count(value) AS valid, count(*) - count(value) AS nodata, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"


@query("agg19_raster_summary", f"SELECT tile_id, {STATS} FROM pixels GROUP BY tile_id")
def _(t):
    from canopyframe.operators import rasters as R

    return R.summary(t.pixels(), ["tile_id"])


@query("agg20_pixel_stats_per_class", f"SELECT label, {STATS}, (SELECT round(quantile_cont(f, 0.9), 6) FROM (SELECT label AS l, count(*) FILTER (value IS NULL) / 64.0 AS f FROM pixels GROUP BY label, tile_id) WHERE l = p.label) AS nodata_p90 FROM pixels p GROUP BY label")
def _(t):
    from canopyframe.operators import rasters as R

    px = t.pixels()
    part = px.groupBy("label", "tile_id").agg((F.count_if(F.col("value").isNull()) / 64.0).alias("f")).groupBy("label").agg(F.round(F.percentile("f", F.lit(0.9)), 6).alias("nodata_p90"))
    return R.summary(px, ["label"]).join(part, "label")


@query(
    "agg21_gini",
    "SELECT round(2.0 * sum(v * rk) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 6) AS gini FROM (SELECT v, row_number() OVER (ORDER BY v) AS rk FROM (SELECT raster, CAST(count(*) FILTER (label = 'cdw') AS DOUBLE) AS v FROM label_events GROUP BY raster))",
)
def _(t):
    per = t.label_events().groupBy("raster").agg(F.count_if(F.col("label") == "cdw").alias("v"))
    return B.gini(per, "v")


@query("agg22_sketched_quantiles", "SELECT source, CAST(share AS DOUBLE) AS share, true AS within FROM (SELECT DISTINCT source FROM label_events WHERE model_prob IS NOT NULL), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS share)")
def _(t):
    """Quantiles by source from sketches of each source and year, and whether their exact ranks are within the sketches' error."""
    from canopyframe.plans.ranking import RANK_ERROR, quantile_sketches, sketched_quantiles

    e = K.with_identity(t.label_events()).select("source", "year", "model_prob").filter("model_prob IS NOT NULL")
    shares = {f"q{i}": q for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))}
    found = sketched_quantiles(quantile_sketches(e, ["source", "year"], "model_prob"), ["source"], shares)
    said = found.select("source", F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(n).alias("value")) for n, q in shares.items()])).alias("s")).select("source", "s.*")
    counts = e.groupBy("source", "model_prob").agg(F.count("*").alias("c"))
    ranks = said.join(counts, "source").groupBy("source", "share", "value").agg((F.sum(F.when(F.col("model_prob") < F.col("value"), F.col("c")).otherwise(0)) / F.sum("c")).alias("less"), (F.sum(F.when(F.col("model_prob") <= F.col("value"), F.col("c")).otherwise(0)) / F.sum("c")).alias("upto"))
    return ranks.select("source", "share", ((F.col("less") - RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("upto") + RANK_ERROR)).alias("within"))


@query(
    "agg22_probability_stats",
    "SELECT y, split, count(*) AS n, round(avg(prob), 6) AS mean, round(stddev_samp(prob), 6) AS std, min(prob) AS min, max(prob) AS max, round(quantile_cont(prob, 0.5), 6) AS median FROM scores GROUP BY GROUPING SETS ((), (y), (split))",
)
def _(t):
    from canopyframe.operators import metrics as M

    return M.grouped_stats(t.scores(), [[], ["y"], ["split"]], ["y", "split"], "prob")


@query(
    "agg23_probability_changes",
    """WITH d AS (SELECT a.prob AS p, b.prob AS q FROM scores a JOIN scores b ON a.key = b.key AND a.model = 'alpha' AND b.model = 'beta')
    SELECT count(*) AS n, round(avg(abs(q - p)), 6) AS mean_abs, round(median(abs(q - p)), 6) AS median_abs, round(avg(q - p), 6) AS mean_signed, round(quantile_cont(abs(q - p), 0.25), 6) AS q1, round(quantile_cont(abs(q - p), 0.75), 6) AS q3,
    CAST(count(*) FILTER (abs(q - p) > 0.0105) AS BIGINT) AS over_1, CAST(count(*) FILTER (abs(q - p) > 0.0505) AS BIGINT) AS over_5, CAST(count(*) FILTER (abs(q - p) > 0.1005) AS BIGINT) AS over_10 FROM d""",
)
def _(t):
    from canopyframe.operators import metrics as M

    s = t.scores()
    return M.change_stats(M.compare_models(s, "alpha", "beta"), limits={"over_1": 0.0105, "over_5": 0.0505, "over_10": 0.1005})


BEST = "SELECT run, variant, max_by(f1, f1 * 1e6 - epoch / 100.0) AS best FROM runs GROUP BY run, variant"


@query("agg24_run_aggregation", "SELECT variant, count(*) AS runs, round(avg(best), 6) AS mean, round(stddev_samp(best), 6) AS std, min(best) AS min, max(best) AS max FROM (SELECT run, variant, max(f1) AS best FROM runs GROUP BY run, variant) GROUP BY variant")
def _(t):
    best = t.runs().groupBy("run", "variant").agg(F.max_by("f1", F.struct("f1", -F.col("epoch"))).alias("best"))
    return best.groupBy("variant").agg(F.count("*").alias("runs"), F.round(F.avg("best"), 6).alias("mean"), F.round(F.stddev_samp("best"), 6).alias("std"), F.min("best").alias("min"), F.max("best").alias("max"))


@query(
    "agg25_variant_by_architecture",
    "SELECT variant, " + ", ".join(f"round(avg(f1) FILTER (architecture = 'arch{i}'), 6) AS arch{i}" for i in range(1, 6)) + ", round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std FROM runs GROUP BY variant",
)
def _(t):
    r = t.runs()
    wide = r.groupBy("variant").pivot("architecture", [f"arch{i}" for i in range(1, 6)]).agg(F.round(F.avg("f1"), 6))
    return wide.join(r.groupBy("variant").agg(F.round(F.avg("f1"), 6).alias("mean"), F.round(F.stddev_pop("f1"), 6).alias("std")), "variant")


@query(
    "agg26_mode_confidence_interval",
    """WITH a AS (SELECT variant, avg(v) AS m, stddev_samp(v) AS s, count(*) AS n FROM (SELECT variant, fold, avg(f1) AS v FROM runs GROUP BY variant, fold) GROUP BY variant)
    SELECT variant, n, round(m, 6) AS mean, round(s, 6) AS std, round(m - 4.303 * s / sqrt(n), 5) AS low, round(m + 4.303 * s / sqrt(n), 5) AS high FROM a""",
)
def _(t):
    from canopyframe.operators import metrics as M

    return M.mode_intervals(t.runs().groupBy("variant", "fold").agg(F.avg("f1").alias("v")), "variant", "v")


SESSION = """WITH s AS (SELECT o_custkey % 20 AS raster, section, o_orderkey FROM orders, (SELECT unnest(['tp', 'fp', 'fn', 'tn']) AS section) x WHERE (o_orderkey % 4 = 0 AND section = 'tp') OR (o_orderkey % 4 = 1 AND section = 'fp') OR (o_orderkey % 4 = 2 AND section = 'fn') OR (o_orderkey % 4 = 3 AND section = 'tn'))
    SELECT raster, CAST(count(*) FILTER (section = 'tp') AS BIGINT) AS tp, CAST(count(*) FILTER (section = 'fp') AS BIGINT) AS fp, CAST(count(*) FILTER (section = 'fn') AS BIGINT) AS fn, CAST(count(*) FILTER (section = 'tn') AS BIGINT) AS tn,
    round(count(*) FILTER (section = 'tp') / count(*) FILTER (section IN ('tp', 'fp')), 6) AS precision, round(count(*) FILTER (section = 'tp') / count(*) FILTER (section IN ('tp', 'fn')), 6) AS recall,
    round(count(*) FILTER (section IN ('tp', 'tn')) / count(*), 6) AS agreement FROM s GROUP BY ROLLUP (raster)"""


@query("agg27_session_totals", SESSION)
def _(t):
    from canopyframe.operators import metrics as M

    o = t.raw("orders").select((F.col("o_custkey") % 20).alias("raster"), F.element_at(F.lit(["tp", "fp", "fn", "tn"]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("section"))
    return M.session_totals(o, ["raster"])


@query("agg28_raster_list", "SELECT l.raster, count(*) AS chips, count(c.label) AS labelled, list_sort(list(DISTINCT l.source)) AS sources FROM latest l LEFT JOIN curated c ON l.raster = c.raster AND l.row_off = c.row_off AND l.col_off = c.col_off GROUP BY l.raster")
def _(t):
    e = t.label_events()
    rows = L.latest(e).join(L.curate(e).select(*L.KEY, F.col("label").alias("c")), L.KEY, "left")
    return rows.groupBy("raster").agg(F.count("*").alias("chips"), F.count("c").alias("labelled"), F.array_sort(F.collect_set("source")).alias("sources"))


@query("agg29_suspect_labels", "SELECT arrival, CASE WHEN label = 'cdw' THEN 'cdw_low_prob' ELSE 'no_cdw_high_prob' END AS reason FROM label_events WHERE (label = 'cdw' AND model_prob < 0.1) OR (label = 'no_cdw' AND model_prob > 0.9)")
def _(t):
    p = F.col("model_prob")
    reason = F.when((F.col("label") == "cdw") & (p < 0.1), "cdw_low_prob").when((F.col("label") == "no_cdw") & (p > 0.9), "no_cdw_high_prob")
    return t.label_events().select("arrival", reason.alias("reason")).filter("reason IS NOT NULL")


@query("agg30_duplicate_images", "SELECT raster, row_off, col_off, count(*) AS copies, min(arrival) AS keep FROM label_events GROUP BY raster, row_off, col_off HAVING count(*) > 1")
def _(t):
    return t.label_events().groupBy(*L.KEY).agg(F.count("*").alias("copies"), F.min("arrival").alias("keep")).filter("copies > 1")


@query("agg31_split_statistics", "SELECT split, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM scores), 4) AS pct, round(100.0 * count(*) FILTER (prob > 0.95 OR prob < 0.05 OR source = 'manual') / count(*), 4) AS eligible_pct FROM scores GROUP BY split")
def _(t):
    eligible = (F.col("prob") > 0.95) | (F.col("prob") < 0.05) | (F.col("source") == "manual")
    g = t.scores().groupBy("split").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(eligible) / F.count("*"), 4).alias("eligible_pct"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query(
    "agg33_folder_inventory",
    "SELECT folder, CAST(count(*) FILTER (name LIKE '%.laz') AS BIGINT) AS laz_files, CAST(count(*) FILTER (name LIKE '%.laz' AND name NOT LIKE '%Copy%') AS BIGINT) AS primary_files, CAST(count(*) FILTER (name LIKE '%.laz' AND name LIKE '%Copy%') AS BIGINT) AS copy_files, contains(folder, 'copy') AS copy_folder, count(*) FILTER (name LIKE '%.laz') = 0 OR contains(folder, 'copy') AS delete_candidate FROM files GROUP BY folder",
)
def _(t):
    from canopyframe.operators import registry as G

    return G.folder_inventory(t.files())


@query("x07_share_matrix", "SELECT tile, " + ", ".join(f"round(avg(CASE WHEN label = 'cdw' THEN 1.0 ELSE 0.0 END) FILTER (year = '{y}'), 6) AS y{y}" for y in (2018, 2020, 2022, 2024)) + " FROM chips GROUP BY tile")
def _(t):
    c = chips(t).withColumn("y", F.concat(F.lit("y"), "year"))
    return c.groupBy("tile").pivot("y", ["y2018", "y2020", "y2022", "y2024"]).agg(F.round(F.avg(F.when(F.col("label") == "cdw", 1.0).otherwise(0.0)), 6))
