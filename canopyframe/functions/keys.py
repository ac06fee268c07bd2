"""Column functions: parsing of names and keys, label and source maps, small scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"^([0-9]+)_([0-9]{4})_(.+?)_chm_max_hag_20cm$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stem(name: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def raster_identity(name: str | Column) -> Column:
    """``struct<stem, tile, year, site, place_key, grid_x, grid_y>`` of a raster name.

    A name of another form keeps its stem as place_key, with year and site ``unknown``.
    """
    s = stem(col(name))
    part = lambda i: F.regexp_extract(s, NAME, i)
    known = s.rlike(NAME)
    digits = lambda a: F.when(known & (F.length(part(1)) >= 6), F.substring(part(1), a, 3).cast("int"))
    return F.struct(
        s.alias("stem"),
        F.when(known, part(1)).alias("tile"),
        F.when(known, part(2)).otherwise("unknown").alias("year"),
        F.when(known, part(3)).otherwise("unknown").alias("site"),
        F.when(known, F.concat_ws("_", part(1), part(3))).otherwise(s).alias("place_key"),
        digits(1).alias("grid_x"),
        digits(4).alias("grid_y"),
    )


def with_identity(df: DataFrame, name: str = "raster") -> DataFrame:
    """``df`` with tile, year, site, place_key, grid_x and grid_y of its raster name."""
    fields = ["tile", "year", "site", "place_key", "grid_x", "grid_y"]
    return df.withColumn("__id", raster_identity(name)).select(*df.columns, *[F.col(f"__id.{f}").alias(f) for f in fields])


def identities(df: DataFrame, name: str = "raster") -> DataFrame:
    """``with_identity`` of each distinct name of ``df``: names are far fewer than rows, and parsing takes most of the time.

    Names are saved first, since the optimizer drops a ``distinct`` under another and moves conditions on what is parsed below it.
    """
    from canopyframe.plans.lineage import saved

    return with_identity(saved(df.select(name).distinct(), "names"), name)


def legacy_sample_id(name: str | Column) -> Column:
    """The name's stem without the product suffix, or null if it hasn't one."""
    found = F.regexp_extract(stem(col(name)), r"^(.+?)_chm_max_hag_20cm$", 1)
    return F.when(found != "", found)


def first_map_year(*texts: str | Column) -> Column:
    """``struct<mapsheet, year>`` of the first text that holds six digits, _ and four digits."""
    one = lambda t: F.when(col(t).rlike("[0-9]{6}_[0-9]{4}"), F.struct(F.regexp_extract(col(t), "([0-9]{6})_([0-9]{4})", 1).alias("mapsheet"), F.regexp_extract(col(t), "([0-9]{6})_([0-9]{4})", 2).cast("int").alias("year")))
    return F.coalesce(*[one(t) for t in texts])


def variant_key(name: str | Column) -> Column:
    """``grid_year`` if the first two parts of the name are numbers, else null."""
    parts = F.split(stem(col(name)), "_")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$"), F.concat_ws("_", a, b))


def name_part(name: str | Column, i: int) -> Column:
    return F.get(F.split(stem(col(name)), "_"), F.lit(i))


def infer_product(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.contains("_harmonized_dem_last_raw_chm"), "harmonized_raw").when(low.contains("_harmonized_dem_last_gauss_chm"), "harmonized_gauss").when(low.contains("_chm_max_hag"), "chm_max_hag")


def location_key(grid: Column, year: Column, source: Column, s: Column) -> Column:
    return F.coalesce(F.when((grid != "") & (year != "") & (source != ""), F.concat_ws("_", grid, year, source)), s)


def label_key(tile_id: Column, grid: Column, year: Column, source: Column, row: Column, column: Column, size: Column) -> Column:
    made = F.concat(F.concat_ws("_", grid, year, F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))), F.lit("__r"), row.cast("string"), F.lit("_c"), column.cast("string"), F.lit("_s"), size.cast("string"))
    return F.coalesce(F.when((grid != "") & (year != ""), made), tile_id)


def tile_id_fields(tile_id: str | Column) -> Column:
    """``sample:variant:row:col`` from the right; a sample may hold colons. Else null."""
    parts = F.split(col(tile_id), ":")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    good = (F.size(parts) >= 4) & at(-1).rlike("^[0-9]+$") & at(-2).rlike("^[0-9]+$")
    return F.when(good, F.struct(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 3, F.lit(0))), ":").alias("sample"), at(-3).alias("variant"), at(-2).cast("int").alias("row"), at(-1).cast("int").alias("col")))


def parent_offset(offset: str | Column, size: int) -> Column:
    return (F.floor(col(offset) / size) * size).cast("int")


def pick_score(*columns: str | Column) -> Column:
    """First value that is not null, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*[col(c) for c in columns])))


def filled(c: str | Column, default) -> Column:
    """``default`` where text is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def binary_label(c: str | Column) -> Column:
    t = F.lower(F.trim(col(c)))
    return F.when(t.isin("cdw", "1", "true", "yes"), 1.0).when(t.isin("no_cdw", "0", "false", "no"), 0.0)


def is_manual(c: str | Column = "source") -> Column:
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return t.contains("manual") | (t == "auto_reviewed")


def mapped(c: str | Column, values: dict, default) -> Column:
    """Literal map of a column's values."""
    return F.coalesce(reduce(lambda acc, kv: acc.when(col(c) == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(next(iter(values.values()))))), F.lit(default))


PRIORITY = {"manual_or_reviewed": 30, "threshold_gate": 20}
SOURCE_RANK = {"manual": 4, "auto_reviewed": 3, "auto": 2, "auto_skip": 1}
SOURCE_WEIGHT = {"manual": 1.0, "auto_reviewed": 0.85, "auto": 0.7, "auto_skip": 0.4}
SOURCE_CONFIDENCE = {"manual": 1.0, "auto_reviewed": 0.9, "auto": 0.75, "auto_skip": 0.2}


def source_rank(c: str | Column = "source") -> Column:
    return F.when(col(c).startswith("self_train"), 2).otherwise(mapped(c, SOURCE_RANK, 0))


def label_confidence(y: Column, prob: str = "model_prob", source: str = "source", default: float = 0.6) -> Column:
    """p or 1 - p within [0.05, 1]; the source's default where p is null."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prob)))
    own = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.when(y >= 0.5, p).otherwise(1 - p)))
    return F.when(F.col(prob).isNull(), mapped(source, SOURCE_CONFIDENCE, default)).otherwise(own)


def entropy(p: str | Column) -> Column:
    """Binary entropy in bits; p is kept 1e-9 away from 0 and 1."""
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), col(p)))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def gaussian_score(v: str | Column, centre: float, sigma: float) -> Column:
    return F.exp(-0.5 * F.pow((col(v) - centre) / sigma, F.lit(2.0)))


def confidence(p: str | Column) -> Column:
    return F.abs(col(p) - 0.5)


def certainty(h: str | Column, least: float = 0.2, gamma: float = 1.5) -> Column:
    return least + (1 - least) * F.pow(2 * F.abs(col(h) - 0.5), F.lit(gamma))


def size_bytes(text: str | Column) -> Column:
    """``1.5 MB`` to bytes, decimal units; null if it is no size."""
    number = F.regexp_extract(col(text), r"([0-9]+(?:[.,][0-9]+)?)\s*([KMG]?B)", 1)
    unit = F.upper(F.regexp_extract(col(text), r"([0-9]+(?:[.,][0-9]+)?)\s*([KMG]?B)", 2))
    factor = F.when(unit == "GB", 1e9).when(unit == "MB", 1e6).when(unit == "KB", 1e3).otherwise(1.0)
    return F.when(number != "", (F.replace(number, F.lit(","), F.lit(".")).cast("double") * factor).cast("long"))


def layer_name(year: Column, token: Column, tokens: dict[str, str]) -> Column:
    """Name of a campaign's orthophoto layer; an unknown token stands for itself."""
    return F.concat(F.lit("of"), year.cast("string"), F.coalesce(F.lit(None).cast("string") if not tokens else F.element_at(F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv]), F.lower(token)), F.lower(token)))


def tile_bounds(grid_x: Column, grid_y: Column, side: int = 1000, north: int = 6_000_000) -> Column:
    """Square kilometre of a map sheet: easting from grid_y, northing from grid_x."""
    e, n = grid_y * side, north + grid_x * side
    return F.struct(e.alias("minx"), n.alias("miny"), (e + side).alias("maxx"), (n + side).alias("maxy"))
