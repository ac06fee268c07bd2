"""Deterministic views of the driver's tables as this library's tables.

``label_events`` from events, ``points`` from lineitem, ``tiles`` and ``pixels`` from embeddings,
``scores`` from labels and documents, ``runs`` from orders, ``samples`` and ``files`` from part.
``CTES`` says the same in SQL for the oracle queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = "_chm_max_hag_20cm"
MODELS = ["alpha", "beta", "gamma"]


class Tables:
    """The library's tables over one folder of Parquet tables; every read is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def label_events(self) -> DataFrame:
        return label_events(self.raw("events"))

    def points(self) -> DataFrame:
        return points(self.raw("lineitem"))

    def tiles(self) -> DataFrame:
        return tiles(self.raw("embeddings"))

    def pixels(self) -> DataFrame:
        return pixels(self.raw("embeddings"))

    def scores(self) -> DataFrame:
        return scores(self.raw("labels"), self.raw("documents"))

    def runs(self) -> DataFrame:
        return runs(self.raw("orders"))

    def samples(self) -> DataFrame:
        return samples(self.raw("part"))

    def files(self) -> DataFrame:
        return files(self.raw("part"))


def label_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS arrival",
        f"concat(cast(436 + user_id % 5 as string), cast(640 + (user_id div 5) % 6 as string), '_', cast(2018 + 2 * (event_id % 4) as string), '_', if(user_id % 2 = 0, 'madal', 'tava'), '{SUFFIX}.tif') AS raster",
        "cast(64 * ((event_id div 4) % 8) as int) AS row_off",
        "cast(64 * ((event_id div 32) % 8) as int) AS col_off",
        "128 AS chunk_size",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 'cdw' WHEN event_type = 'error' THEN 'unknown' ELSE 'no_cdw' END AS label",
        "CASE event_id % 10 WHEN 0 THEN 'manual' WHEN 1 THEN 'auto_reviewed' WHEN 2 THEN 'auto_skip' ELSE 'auto' END AS source",
        "concat('user', cast(user_id % 7 as string)) AS annotator",
        "concat('model', cast(event_id % 3 as string)) AS model_name",
        "if(event_id % 29 = 0, null, (cast(floor(value * 100) as bigint) % 101) / 100.0D) AS model_prob",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm\") AS timestamp",
    )


def points(lineitem: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return lineitem.withColumn("n", n).selectExpr(
        "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS point_id",
        "concat('4366', cast(40 + l_suppkey % 2 as string)) AS tile_id",
        "year(l_shipdate) AS year",
        "(l_partkey % 100) * 0.13D AS x",
        "(l_suppkey % 100) * 0.13D AS y",
        "l_extendedprice / 16384 AS z",
        "l_quantity AS intensity",
        "l_linenumber AS return_number",
        "n AS number_of_returns",
        "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 6 END AS classification",
        "l_discount * 100 AS scan_angle",
        "l_tax AS nir",
    )


def tiles(embeddings: DataFrame) -> DataFrame:
    return embeddings.selectExpr(
        "vec_id AS tile_id",
        "label",
        "transform(embedding, v -> if(v < -0.2, null, round((cast(v as double) + 0.55D) * 1.5D, 4))) AS band",
    )


def pixels(embeddings: DataFrame) -> DataFrame:
    long = tiles(embeddings).selectExpr("tile_id", "label", "posexplode(band) AS (i, value)")
    return long.selectExpr("tile_id", "label", "cast(i div 8 as int) AS row", "cast(i % 8 as int) AS col", "value")


def scores(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per key and model; probabilities from hexadecimal digits of md5."""
    d = documents.select("doc_id", "lang", "source")
    rows = labels.join(d, "doc_id").select("doc_id", "lang", F.col("source").alias("place"), F.col("quality").alias("y"), F.explode(F.lit(MODELS)).alias("model"))
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "model")), 1, 4), 16, 10).cast("long")
    prob = F.when(F.col("y") == 1, (digits % 801 + 200) / 1000.0).otherwise((digits % 801) / 1000.0)
    return rows.select(F.col("doc_id").alias("key"), "model", prob.alias("prob"), "y", "lang", "place", F.expr("CASE WHEN doc_id % 10 < 2 THEN 'manual' ELSE 'gate' END").alias("source"), (2018 + 2 * (F.col("doc_id") % 4)).cast("int").alias("year"), F.expr("CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END").alias("split"))


def runs(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderkey % 40 as int) AS run",
        "CASE o_orderstatus WHEN 'P' THEN 'raw' WHEN 'F' THEN 'gauss' ELSE 'baseline' END AS variant",
        "concat('arch', substring(o_orderpriority, 1, 1)) AS architecture",
        "cast(o_custkey % 3 as int) AS fold",
        "cast((o_orderkey div 40) % 50 as int) AS epoch",
        "o_orderkey AS step",
        "(cast(floor(o_totalprice) as bigint) % 1000) / 1000.0D AS f1",
        "(cast(floor(o_totalprice / 7) as bigint) % 1000) / 1000.0D AS auc",
    )


def samples(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "concat(cast(436640 + p_partkey % 25 as string), '_', cast(2018 + p_size % 4 as string), '_', substring(p_type, 1, 4), cast(p_partkey div 50 as string)) AS sample_id",
        "cast(436640 + p_partkey % 25 as string) AS mapsheet",
        "cast(2018 + p_size % 4 as int) AS year",
        "substring(p_type, 1, 4) AS campaign",
        "p_partkey % 3 <> 0 AS has_raw",
        "p_partkey % 4 <> 0 AS has_gauss",
        "p_partkey % 5 <> 0 AS has_baseline",
        "p_partkey % 7 <> 0 AS has_label",
        "p_partkey",
        "p_size",
    )


def files(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "concat('laz/', lower(substring(p_type, 1, 3)), '/', if(p_size % 9 = 0, 'copy', 'main'), cast(p_size % 6 as string)) AS folder",
        "concat(replace(p_name, ' ', '_'), '_', cast(p_partkey as string), if(p_partkey % 11 = 0, ' - Copy', ''), if(p_partkey % 13 = 0, '.txt', '.laz')) AS name",
        "cast(p_retailprice * 1000 as bigint) AS size_bytes",
        "cast(2018 + p_size % 4 as int) AS year",
    )


CTES = {
    "label_events": """label_events AS (SELECT event_id AS arrival,
  CAST(436 + user_id % 5 AS VARCHAR) || CAST(640 + (user_id // 5) % 6 AS VARCHAR) || '_' || CAST(2018 + 2 * (event_id % 4) AS VARCHAR) || '_' || CASE WHEN user_id % 2 = 0 THEN 'madal' ELSE 'tava' END || '_chm_max_hag_20cm.tif' AS raster,
  CAST(64 * ((event_id // 4) % 8) AS INTEGER) AS row_off, CAST(64 * ((event_id // 32) % 8) AS INTEGER) AS col_off, 128 AS chunk_size,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'cdw' WHEN event_type = 'error' THEN 'unknown' ELSE 'no_cdw' END AS label,
  CASE event_id % 10 WHEN 0 THEN 'manual' WHEN 1 THEN 'auto_reviewed' WHEN 2 THEN 'auto_skip' ELSE 'auto' END AS source,
  'user' || CAST(user_id % 7 AS VARCHAR) AS annotator, 'model' || CAST(event_id % 3 AS VARCHAR) AS model_name,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE (CAST(floor(value * 100) AS BIGINT) % 101) / 100.0::DOUBLE END AS model_prob,
  strftime(ts, '%Y-%m-%dT%H:%M') AS timestamp FROM events)""",
    "parsed": """parsed AS (SELECT *, substr(raster, 1, 6) AS tile, substr(raster, 8, 4) AS year, CASE WHEN contains(raster, 'madal') THEN 'madal' ELSE 'tava' END AS site,
  substr(raster, 1, 6) || '_' || CASE WHEN contains(raster, 'madal') THEN 'madal' ELSE 'tava' END AS place_key,
  CAST(substr(raster, 1, 3) AS INTEGER) AS grid_x, CAST(substr(raster, 4, 3) AS INTEGER) AS grid_y FROM label_events)""",
    "gated": """gated AS (SELECT *, CASE WHEN source LIKE '%manual%' OR source = 'auto_reviewed' THEN 'manual_or_reviewed' WHEN model_prob IS NULL THEN 'no_prob'
  WHEN (label = 'cdw' AND model_prob >= 0.95) OR (label = 'no_cdw' AND model_prob <= 0.05) THEN 'threshold_gate' ELSE 'below_threshold' END AS reason
  FROM parsed WHERE label IN ('cdw', 'no_cdw'))""",
    "curated": """curated AS (SELECT * EXCLUDE (rn) FROM (SELECT * REPLACE (CASE WHEN reason = 'threshold_gate' THEN 'auto_threshold_gate_v4' ELSE source END AS source),
  row_number() OVER (PARTITION BY raster, row_off, col_off ORDER BY CASE reason WHEN 'manual_or_reviewed' THEN 30 ELSE 20 END DESC, timestamp DESC, arrival DESC) AS rn
  FROM gated WHERE reason IN ('manual_or_reviewed', 'threshold_gate')) WHERE rn = 1)""",
    "latest": """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY raster, row_off, col_off ORDER BY arrival DESC) AS rn FROM parsed) WHERE rn = 1)""",
    "chips": """chips AS (SELECT raster, tile, year, site, place_key, grid_x, grid_y, row_off, col_off, chunk_size, label, source, model_prob, arrival FROM latest)""",
    "points": """points AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS point_id, '4366' || CAST(40 + l_suppkey % 2 AS VARCHAR) AS tile_id, CAST(year(l_shipdate) AS INTEGER) AS year,
  (l_partkey % 100) * 0.13::DOUBLE AS x, (l_suppkey % 100) * 0.13::DOUBLE AS y, l_extendedprice / 16384 AS z, l_quantity AS intensity, l_linenumber AS return_number,
  max(l_linenumber) OVER (PARTITION BY l_orderkey) AS number_of_returns, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 6 END AS classification,
  l_discount * 100 AS scan_angle, l_tax AS nir FROM lineitem)""",
    "tiles": """tiles AS (SELECT vec_id AS tile_id, label, list_transform(embedding, lambda v: CASE WHEN v < CAST(-0.2 AS DOUBLE) THEN NULL ELSE round((CAST(v AS DOUBLE) + 0.55::DOUBLE) * 1.5::DOUBLE, 4) END) AS band FROM embeddings)""",
    "pixels": """pixels AS (SELECT tile_id, label, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, band[i] AS value FROM (SELECT tile_id, label, band, unnest(range(1, 65)) AS i FROM tiles))""",
    "scores": """scores AS (SELECT l.doc_id AS key, m.model, CASE WHEN quality = 1 THEN (CAST('0x' || substr(md5(CAST(l.doc_id AS VARCHAR) || '|' || m.model), 1, 4) AS BIGINT) % 801 + 200) / 1000.0::DOUBLE
  ELSE (CAST('0x' || substr(md5(CAST(l.doc_id AS VARCHAR) || '|' || m.model), 1, 4) AS BIGINT) % 801) / 1000.0::DOUBLE END AS prob, quality AS y, d.lang, d.source AS place,
  CASE WHEN l.doc_id % 10 < 2 THEN 'manual' ELSE 'gate' END AS source, CAST(2018 + 2 * (l.doc_id % 4) AS INTEGER) AS year,
  CASE WHEN l.doc_id % 5 < 3 THEN 'train' WHEN l.doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (SELECT unnest(['alpha', 'beta', 'gamma']) AS model) m)""",
    "runs": """runs AS (SELECT CAST(o_orderkey % 40 AS INTEGER) AS run, CASE o_orderstatus WHEN 'P' THEN 'raw' WHEN 'F' THEN 'gauss' ELSE 'baseline' END AS variant, 'arch' || substr(o_orderpriority, 1, 1) AS architecture,
  CAST(o_custkey % 3 AS INTEGER) AS fold, CAST((o_orderkey // 40) % 50 AS INTEGER) AS epoch, o_orderkey AS step, (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0::DOUBLE AS f1, (CAST(floor(o_totalprice / 7) AS BIGINT) % 1000) / 1000.0::DOUBLE AS auc FROM orders)""",
    "samples": """samples AS (SELECT CAST(436640 + p_partkey % 25 AS VARCHAR) || '_' || CAST(2018 + p_size % 4 AS VARCHAR) || '_' || substr(p_type, 1, 4) || CAST(p_partkey // 50 AS VARCHAR) AS sample_id, CAST(436640 + p_partkey % 25 AS VARCHAR) AS mapsheet,
  CAST(2018 + p_size % 4 AS INTEGER) AS year, substr(p_type, 1, 4) AS campaign, p_partkey % 3 <> 0 AS has_raw, p_partkey % 4 <> 0 AS has_gauss, p_partkey % 5 <> 0 AS has_baseline, p_partkey % 7 <> 0 AS has_label, p_partkey, p_size FROM part)""",
    "files": """files AS (SELECT 'laz/' || lower(substr(p_type, 1, 3)) || '/' || CASE WHEN p_size % 9 = 0 THEN 'copy' ELSE 'main' END || CAST(p_size % 6 AS VARCHAR) AS folder,
  replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 11 = 0 THEN ' - Copy' ELSE '' END || CASE WHEN p_partkey % 13 = 0 THEN '.txt' ELSE '.laz' END AS name,
  CAST(trunc(p_retailprice * 1000) AS BIGINT) AS size_bytes, CAST(2018 + p_size % 4 AS INTEGER) AS year FROM part)""",
}
NEEDS = {"parsed": ["label_events"], "gated": ["parsed"], "curated": ["gated"], "latest": ["parsed"], "chips": ["latest"], "pixels": ["tiles"]}


def with_ctes(sql: str) -> str:
    """``sql`` (a SELECT, or WITH ...) with the definitions of the views it names put before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    sql = sql.strip()
    head = ",\n".join(CTES[x] for x in order)
    if not order:
        return sql
    start = "WITH RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", sql) else "WITH "
    rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", sql)
    return f"{start}{head}{', ' if rest != sql else ' '}{rest}"
