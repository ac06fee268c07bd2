"""Parsing, keys, filters and gates."""

from pyspark.sql import functions as F

from canopyframe.functions import keys as K
from canopyframe.operators import labels as L
from canopyframe.queries.base import query

E7 = "arrival"


@query("prj01_raster_identity", "SELECT arrival, tile, year, site, place_key, grid_x, grid_y FROM parsed")
def _(t):
    return K.with_identity(t.label_events()).select(E7, "tile", "year", "site", "place_key", "grid_x", "grid_y")


@query("prj02_legacy_sample_id", "SELECT arrival, replace(raster, '_chm_max_hag_20cm.tif', '') AS sample_id FROM label_events")
def _(t):
    return t.label_events().select(E7, K.legacy_sample_id("raster").alias("sample_id"))


@query("prj03_first_map_year", "SELECT arrival, substr(raster, 1, 6) AS mapsheet, CAST(substr(raster, 8, 4) AS INTEGER) AS year FROM label_events")
def _(t):
    rows = t.label_events().select(E7, K.first_map_year("annotator", "raster").alias("m"))
    return rows.select(E7, "m.mapsheet", "m.year")


@query("prj04_variant_key", "SELECT arrival, substr(raster, 1, 11) AS variant_key FROM label_events")
def _(t):
    return t.label_events().select(E7, K.variant_key("raster").alias("variant_key"))


@query("prj05_name_parts", "SELECT arrival, split_part(raster, '_', 1) AS mapsheet, split_part(raster, '_', 2) AS year, split_part(raster, '_', 3) AS landscape FROM label_events")
def _(t):
    return t.label_events().select(E7, K.name_part("raster", 0).alias("mapsheet"), K.name_part("raster", 1).alias("year"), K.name_part("raster", 2).alias("landscape"))


@query(
    "prj06_product_and_keys",
    """SELECT sample_id, CASE WHEN p_partkey % 3 = 0 THEN 'harmonized_raw' WHEN p_partkey % 3 = 1 THEN 'harmonized_gauss' ELSE NULL END AS product,
    mapsheet || '_' || CAST(year AS VARCHAR) || '_' || campaign AS location_key,
    mapsheet || '_' || CAST(year AS VARCHAR) || '_' || campaign || '__r' || CAST(p_size * 64 AS VARCHAR) || '_c0_s640' AS label_key FROM samples""",
)
def _(t):
    s = t.samples()
    name = F.concat("sample_id", F.element_at(F.lit(["_Harmonized_DEM_last_raw_chm", "_harmonized_dem_last_gauss_chm", "_other"]), (F.col("p_partkey") % 3 + 1).cast("int")))
    year = F.col("year").cast("string")
    return s.select("sample_id", K.infer_product(name).alias("product"), K.location_key(F.col("mapsheet"), year, F.col("campaign"), name).alias("location_key"), K.label_key(name, F.col("mapsheet"), year, F.col("campaign"), F.col("p_size") * 64, F.lit(0), F.lit(640)).alias("label_key"))


@query("prj07_tile_id_fields", "SELECT arrival, raster || ':x' AS sample, 'gauss' AS variant, row_off AS row, col_off AS col FROM label_events")
def _(t):
    tile = F.concat_ws(":", "raster", F.lit("x"), F.lit("gauss"), F.col("row_off").cast("string"), F.col("col_off").cast("string"))
    return t.label_events().select(E7, K.tile_id_fields(tile).alias("f")).select(E7, "f.*")


@query("prj08_parent_tile", "SELECT arrival, CAST(row_off // 256 * 256 AS INTEGER) AS parent_row, CAST(col_off // 256 * 256 AS INTEGER) AS parent_col FROM label_events")
def _(t):
    return t.label_events().select(E7, K.parent_offset("row_off", 256).alias("parent_row"), K.parent_offset("col_off", 256).alias("parent_col"))


@query("prj09_score_pick", "SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN event_id % 2 = 0 THEN value / 100 END, CASE WHEN event_id % 3 = 0 THEN value - 50 END, 0.5::DOUBLE))) AS score FROM events")
def _(t):
    return t.raw("events").select("event_id", K.pick_score(F.when(F.col("event_id") % 2 == 0, F.col("value") / 100), F.when(F.col("event_id") % 3 == 0, F.col("value") - 50), F.lit(0.5)).alias("score"))


@query("prj10_row_defaults", "SELECT arrival, CASE WHEN arrival % 5 = 0 THEN 'default.tif' ELSE raster END AS raster, CASE WHEN arrival % 4 = 0 THEN '128' ELSE '256' END AS chunk_size FROM label_events")
def _(t):
    e = t.label_events().withColumn("raster", F.when(F.col("arrival") % 5 != 0, F.col("raster"))).withColumn("chunk_size", F.when(F.col("arrival") % 4 == 0, "").otherwise("256"))
    return e.select(E7, K.filled("raster", "default.tif").alias("raster"), K.filled("chunk_size", "128").alias("chunk_size"))


@query("prj11_binary_label", "SELECT arrival, CASE label WHEN 'cdw' THEN 1.0::DOUBLE WHEN 'no_cdw' THEN 0.0::DOUBLE END AS y FROM label_events")
def _(t):
    return t.label_events().select(E7, K.binary_label(F.concat(F.lit(" "), F.initcap("label"))).alias("y"))


@query("prj12_manual_source", "SELECT arrival, source IN ('manual', 'auto_reviewed') AS manual FROM label_events")
def _(t):
    return t.label_events().select(E7, K.is_manual().alias("manual"))


@query(
    "prj13_source_maps",
    """SELECT arrival, CASE reason WHEN 'manual_or_reviewed' THEN 30 WHEN 'threshold_gate' THEN 20 ELSE 10 END AS priority,
    CASE source WHEN 'manual' THEN 4 WHEN 'auto_reviewed' THEN 3 WHEN 'auto' THEN 2 ELSE 1 END AS source_rank,
    CASE source WHEN 'manual' THEN 1.0::DOUBLE WHEN 'auto_reviewed' THEN 0.85::DOUBLE WHEN 'auto' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM gated""",
)
def _(t):
    return L.gate(t.label_events()).select(E7, K.mapped("reason", K.PRIORITY, 10).alias("priority"), K.source_rank().alias("source_rank"), K.mapped("source", K.SOURCE_WEIGHT, 0.5).alias("weight"))


@query(
    "prj14_label_confidence",
    """SELECT arrival, CASE WHEN model_prob IS NULL THEN CASE source WHEN 'manual' THEN 1.0::DOUBLE WHEN 'auto_reviewed' THEN 0.9::DOUBLE WHEN 'auto' THEN 0.75::DOUBLE ELSE 0.2::DOUBLE END
    ELSE greatest(0.05::DOUBLE, least(1.0::DOUBLE, CASE WHEN label = 'cdw' THEN model_prob ELSE 1 - model_prob END)) END AS confidence FROM gated""",
)
def _(t):
    return L.labelled(t.label_events()).select(E7, K.label_confidence(K.binary_label("label")).alias("confidence"))


@query("prj15_entropy", "SELECT arrival, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS entropy FROM (SELECT arrival, greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, model_prob)) AS q FROM label_events WHERE model_prob IS NOT NULL)")
def _(t):
    return t.label_events().filter("model_prob IS NOT NULL").select(E7, F.round(K.entropy("model_prob"), 6).alias("entropy"))


@query("prj16_gaussian_score", "SELECT arrival, round(exp(-0.5 * power((model_prob - 0.5) / 0.15, 2)), 6) AS score FROM label_events")
def _(t):
    return t.label_events().select(E7, F.round(K.gaussian_score("model_prob", 0.5, 0.15), 6).alias("score"))


@query("prj17_confidence_maps", "SELECT arrival, abs(model_prob - 0.5) AS confidence, round(0.2 + 0.8 * power(2 * abs(model_prob - 0.5), 1.5), 6) AS certainty FROM label_events")
def _(t):
    return t.label_events().select(E7, K.confidence("model_prob").alias("confidence"), F.round(K.certainty("model_prob"), 6).alias("certainty"))


@query("prj18_size_text", "SELECT folder, name, CASE WHEN size_bytes % 3 = 0 THEN size_bytes * 1000 ELSE size_bytes END AS bytes FROM files")
def _(t):
    f = t.files()
    text = F.when(F.col("size_bytes") % 3 == 0, F.concat(F.col("size_bytes").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.lit("size: "), F.col("size_bytes").cast("string"), F.lit("B")))
    return f.select("folder", "name", K.size_bytes(text).alias("bytes"))


@query("prj19_layer_name", "SELECT sample_id, 'of' || CAST(year AS VARCHAR) || CASE lower(campaign) WHEN 'econ' THEN 'madal' ELSE lower(campaign) END AS layer FROM samples")
def _(t):
    return t.samples().select("sample_id", K.layer_name(F.col("year"), F.col("campaign"), {"econ": "madal"}).alias("layer"))


@query("prj20_id_list", "SELECT mapsheet, CAST(min(p_partkey) AS BIGINT) AS first_at FROM samples GROUP BY mapsheet")
def _(t):
    rows = t.samples().withColumn("id", F.when(F.col("p_partkey") % 17 == 0, F.lit("not-an-id")).otherwise(F.col("mapsheet")))
    rows = rows.union(t.samples().withColumn("id", F.col("mapsheet"))).filter(F.col("id").rlike("^[0-9]{6}$"))
    return L.first_per_key(rows, ["id"], F.asc("p_partkey")).select(F.col("id").alias("mapsheet"), F.col("p_partkey").alias("first_at"))


@query("prj21_tile_bounds", "SELECT DISTINCT tile, grid_y * 1000 AS minx, 6000000 + grid_x * 1000 AS miny, grid_y * 1000 + 1000 AS maxx, 6001000 + grid_x * 1000 AS maxy FROM parsed")
def _(t):
    return K.identities(t.label_events()).select("tile", K.tile_bounds(F.col("grid_x"), F.col("grid_y")).alias("b")).select("tile", "b.*").distinct()


COLS = "arrival, raster, row_off, col_off, label, source"


@query("flt01_confidence_gate", "SELECT arrival, reason FROM gated")
def _(t):
    return L.gate(t.label_events()).select(E7, "reason")


@query("flt02_manual_and_pseudo_pools", "SELECT arrival, CASE WHEN source IN ('manual', 'auto_reviewed') THEN 'manual' ELSE 'pseudo' END AS pool FROM label_events WHERE source IN ('manual', 'auto_reviewed') OR model_prob >= 0.95 OR model_prob <= 0.05")
def _(t):
    e = t.label_events()
    return L.manual_pool(e).select(E7, F.lit("manual").alias("pool")).union(L.pseudo_pool(e).select(E7, F.lit("pseudo").alias("pool")))


@query("flt03_hard_band", "SELECT arrival FROM label_events WHERE source IN ('manual', 'auto_reviewed') OR model_prob BETWEEN 0.05 AND 0.30 OR model_prob BETWEEN 0.70 AND 0.95")
def _(t):
    return L.hard_band(t.label_events()).select(E7)


@query("flt04_split_eligible", "SELECT arrival, coalesce(source IN ('manual', 'auto_skip') OR model_prob > 0.95 OR model_prob < 0.05, false) AS eligible FROM label_events")
def _(t):
    return t.label_events().select(E7, L.split_eligible().alias("eligible"))


@query("flt11_catalogue_filter", "SELECT raster, row_off, col_off, source FROM latest WHERE year = '2020' AND site = 'madal' AND source IN ('manual', 'auto') AND label = 'cdw' ORDER BY raster, row_off, col_off LIMIT 200")
def _(t):
    c = K.with_identity(L.latest(t.label_events()))
    wanted = {"year": ["2020"], "site": ["madal"], "source": ["manual", "auto"], "label": ["cdw"]}
    for name, values in wanted.items():
        c = c.filter(F.col(name).isin(values))
    return c.orderBy(*L.KEY).limit(200).select(*L.KEY, "source")


@query("flt12_data_strategy", "SELECT 'full' AS strategy, count(*) AS n FROM latest UNION ALL SELECT 'manual_only', count(*) FROM latest WHERE source IN ('manual', 'auto_reviewed')")
def _(t):
    rows = L.latest(t.label_events())
    return rows.select(F.lit("full").alias("strategy")).union(L.manual_pool(rows).select(F.lit("manual_only"))).groupBy("strategy").agg(F.count("*").alias("n"))


@query("flt13_prediction_flags", "SELECT arrival, CASE WHEN model_prob >= 0.7 THEN 'ok' WHEN model_prob >= 0.3 THEN 'review' ELSE 'auto_skip' END AS flag, CASE WHEN model_prob >= 0.3 THEN 'cdw' ELSE 'no_cdw' END AS pred_label FROM label_events WHERE model_prob IS NOT NULL")
def _(t):
    return L.flag_predictions(t.label_events().filter("model_prob IS NOT NULL")).select(E7, "flag", "pred_label")


@query(
    "flt14_self_training",
    """SELECT raster, row_off, col_off, CASE WHEN model_prob >= 0.9 THEN 'cdw' ELSE 'no_cdw' END AS pseudo, abs(model_prob - 0.5) AS confidence FROM latest
    WHERE (model_prob >= 0.9 OR model_prob <= 0.1) AND NOT EXISTS (SELECT 1 FROM curated c WHERE c.raster = latest.raster AND c.row_off = latest.row_off AND c.col_off = latest.col_off)
    ORDER BY confidence DESC, raster, row_off, col_off LIMIT 500""",
)
def _(t):
    e = t.label_events()
    return L.self_training(L.latest(e), L.curate(e)).select(*L.KEY, "pseudo", "confidence")


@query("flt15_review_action", "SELECT arrival, CASE WHEN EXISTS (SELECT 1 FROM latest l WHERE l.model_prob BETWEEN 0.4 AND 0.6 AND l.raster = curated.raster AND l.row_off = curated.row_off AND l.col_off = curated.col_off) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM curated")
def _(t):
    e = t.label_events()
    return L.review_action(L.curate(e), L.latest(e).filter("model_prob BETWEEN 0.4 AND 0.6")).select(E7, "weight")


@query("win01_last_row_wins", f"SELECT {COLS} FROM latest")
def _(t):
    return L.latest(t.label_events()).select(*COLS.split(", "))


@query("win02_priority_dedup", f"SELECT {COLS}, reason FROM curated")
def _(t):
    return L.curate(t.label_events()).select(*COLS.split(", "), "reason")


RANK = "CASE source WHEN 'manual' THEN 4 WHEN 'auto_reviewed' THEN 3 WHEN 'auto' THEN 2 WHEN 'auto_skip' THEN 1 ELSE 0 END"


@query("win03_source_rank_dedup", f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY raster, row_off, col_off ORDER BY {RANK} DESC, arrival DESC) AS rn FROM label_events) WHERE rn = 1")
def _(t):
    return L.by_source_rank(t.label_events()).select(*COLS.split(", "))


@query("win04_newer_time_dedup", f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY raster, row_off, col_off ORDER BY {RANK} DESC, timestamp DESC, arrival) AS rn FROM label_events) WHERE rn = 1")
def _(t):
    return L.by_priority_then_newer(t.label_events()).select(*COLS.split(", "))


@query("win05_latest_event", "SELECT tile, year, row_off, col_off, max(arrival) AS arrival, arg_max(label, arrival) AS label FROM parsed GROUP BY tile, year, row_off, col_off")
def _(t):
    e = K.with_identity(t.label_events()).select("tile", "year", "row_off", "col_off", "arrival", "label")
    return L.latest_struct(e, ["tile", "year", "row_off", "col_off"])


@query(
    "curated_class_balance",
    """SELECT place_key, year, CAST(count(*) FILTER (label = 'cdw') AS BIGINT) AS cdw, CAST(count(*) FILTER (label = 'no_cdw') AS BIGINT) AS no_cdw, count(*) AS total,
    round(100.0 * count(*) FILTER (label = 'cdw') / count(*), 4) AS cdw_pct FROM curated GROUP BY place_key, year""",
)
def _(t):
    from canopyframe.operators import balance as B

    return B.class_balance(K.with_identity(L.curate(t.label_events())), ["place_key", "year"]).select("place_key", "year", "cdw", "no_cdw", "total", "cdw_pct")
