"""Readers and writers of the library's exchange formats: label CSV, JSON manifests and sessions, GeoJSON.

Folders must be ones that all executors share. Schemas are explicit, so nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.plans.lineage import scratch  # noqa: F401

LABEL_FIELDS = ["raster", "row_off", "col_off", "chunk_size", "label", "source", "annotator", "model_name", "model_prob", "timestamp"]
LABEL_SCHEMA = ", ".join(f"{c} string" for c in LABEL_FIELDS)


def write_labels(labels: DataFrame, folder: str, by: str = "raster", files: int = 1) -> str:
    """One directory of CSV per value of ``by``, sorted, in one file; with ``files`` up to so many, each sorted,
    so that a value with very many rows is not one task's."""
    rows = labels.select(*LABEL_FIELDS, *[c for c in [by] if c not in LABEL_FIELDS])
    salt = [F.pmod(F.xxhash64("row_off"), F.lit(files))] if files > 1 else []
    laid = rows.repartition(F.col(by), *salt).sortWithinPartitions(by, "row_off", "col_off")
    laid.withColumn("__part", F.col(by)).write.partitionBy("__part").option("header", True).csv(folder)
    return folder


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """All label files of a folder with safe casts and the file's tag; unlabelled rows and bad offsets go."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).schema(LABEL_SCHEMA).csv(folder)
    tag = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "__part=([^/]*)/", 1))
    rows = raw.select("*", tag.alias("file"))
    cast = {"row_off": "int", "col_off": "int", "chunk_size": "int", "model_prob": "double"}
    return rows.withColumns({c: F.expr(f"try_cast({c} AS {k})") for c, k in cast.items()}).filter("trim(label) IN ('cdw', 'no_cdw') AND row_off IS NOT NULL AND col_off IS NOT NULL")


def event_table(labels: DataFrame, order: list[str], file: str = "file") -> DataFrame:
    """Rows with provenance: line number in their file, global event index, raw row as JSON, addressable flag."""
    from canopyframe.plans.ranking import global_row_number

    numbered = global_row_number(labels, [F.col(file), *[F.col(c) for c in order]], name="event_index")
    first = numbered.groupBy(file).agg(F.min("event_index").alias("__first"))
    rows = numbered.join(first, file).withColumn("line", F.col("event_index") - F.col("__first") + 1).drop("__first")
    raw = F.to_json(F.struct(*sorted(c for c in labels.columns if c != file)))
    return rows.select("*", raw.alias("raw"), (F.col("row_off").isNotNull() & F.col("col_off").isNotNull()).alias("addressable"))


def write_json(df: DataFrame, folder: str) -> str:
    df.write.json(folder)
    return folder


MANIFEST_SCHEMA = "keys array<struct<raster:string,row_off:int,col_off:int>>, val_keys array<struct<raster:string,row_off:int,col_off:int>>, splits map<string,array<struct<raster:string,row_off:int,col_off:int>>>"


def split_manifest(roles: DataFrame, by: str = "place_key") -> DataFrame:
    """One manifest row per ``by``: its test keys and val keys. A table of manifests has no row that
    grows with the whole input."""
    key = F.struct("raster", "row_off", "col_off")
    pick = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, key)))
    return roles.groupBy(by).agg(pick("test").alias("keys"), pick("val").alias("val_keys"))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Test keys of manifests in either shape: ``keys`` or ``splits.test``."""
    raw = spark.read.schema(MANIFEST_SCHEMA).json(folder)
    return raw.select(F.explode(F.coalesce("keys", F.try_element_at("splits", F.lit("test")))).alias("k")).select("k.*")


def manifest_meta(roles: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("role") == r)
    return roles.agg(F.count("*").alias("total_rows"), n("test").alias("test_rows"), n("buffer").alias("buffer_rows"), n("train").alias("train_rows"), F.countDistinct("place_key").alias("places"))


COLOURS = {"test": "#d62728", "buffer": "#7f7f7f", "train": "#2ca02c", "val": "#1f77b4"}


def polygon(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    at = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(at(minx, miny), at(maxx, miny), at(maxx, maxy), at(minx, maxy), at(minx, miny))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def feature(geometry: Column, **properties: Column) -> Column:
    """GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties")))


SESSION_SCHEMA = "session string, " + ", ".join(f"{s} array<struct<raster:string,n:bigint>>" for s in ("tp", "fp", "fn", "tn"))


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session files with four optional sections, as rows (session, section, raster, n)."""
    raw = spark.read.schema(SESSION_SCHEMA).json(folder)
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("rows")) for s in ("tp", "fp", "fn", "tn")])
    rows = raw.select("session", F.explode(sections).alias("s")).select("session", "s.section", F.explode("s.rows").alias("r"))
    return rows.select("session", "section", "r.raster", "r.n")


ANNOTATION = "struct<id:bigint,annotations:array<struct<created:bigint,result:array<struct<label:string,text:string>>>>>"


def latest_annotations(tasks: DataFrame, column: str, label: str) -> DataFrame:
    """Results with a label in each task's last annotation."""
    t = tasks.select(F.from_json(column, ANNOTATION).alias("t")).select("t.id", F.try_element_at("t.annotations", F.lit(-1)).alias("a"))
    return t.select("id", F.explode(F.filter("a.result", lambda r: r["label"] == label)).alias("r")).select("id", "r.text")


LINK = r"""href="([^"]*)\""""


def page_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct link targets of each page with their last part."""
    links = pages.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)))).alias("href"))
    return links.select(id_col, "href", F.regexp_extract("href", "([^/]*)$", 1).alias("name"))


def backfill(labels: DataFrame, scores: DataFrame, key: list[str], column: str = "model_prob", default: float = 0.0) -> DataFrame:
    """``labels`` with ``column`` from scores where the column is missing or null."""
    s = scores.select(*key, F.col(column).alias("__s"))
    rows = labels if column in labels.columns else labels.withColumn(column, F.lit(None).cast("double"))
    return rows.join(s, key, "left").withColumn(column, F.coalesce(column, "__s", F.lit(default))).drop("__s")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union of tables whose columns differ, in first-seen order; missing values are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def image_name(url: Column) -> Column:
    """File name of an image reference: the query parameter d if there, else the path's last part."""
    d = F.try_parse_url(url, F.lit("QUERY"), F.lit("d"))
    path = F.regexp_replace(url, "[?#].*$", "")
    return F.regexp_extract(F.coalesce(d, path), "([^/]*)$", 1)
