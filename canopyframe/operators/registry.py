"""Registry tables: samples, variants and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_inventory(files: DataFrame) -> DataFrame:
    laz, copy = F.col("name").endswith(".laz"), F.col("name").contains("Copy")
    g = files.groupBy("folder").agg(F.count_if(laz).alias("laz_files"), F.count_if(laz & ~copy).alias("primary_files"), F.count_if(laz & copy).alias("copy_files"))
    odd = F.col("folder").contains("copy")
    return g.withColumn("copy_folder", odd).withColumn("delete_candidate", (F.col("laz_files") == 0) | odd)


def sample_registry(samples: DataFrame, products: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """``samples`` with a has_ flag for each product table, and whether a sample can be trained on.

    Product keys are reduced to distinct ones first, so a join never multiplies samples.
    """
    out = samples
    for name, df in products.items():
        out = out.join(df.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    images = [F.col(f"has_{n}") for n in products if n != "label"]
    any_image = images[0]
    for c in images[1:]:
        any_image = any_image | c
    return out.withColumn("trainable", F.col("has_label") & any_image)


def variants(registry: DataFrame, names: list[str], key: str = "sample_id") -> DataFrame:
    """One row per sample and variant that exists."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"has_{n}").alias("tif_exists")) for n in names]))
    return registry.select(key, "has_label", pairs.alias("v")).select(key, "v.variant", "v.tif_exists", (F.col("v.tif_exists") & F.col("has_label")).alias("trainable"))


def merge_manifest(current: DataFrame, previous: DataFrame, carried: dict[str, Column], key: str = "filename", line: str = "line") -> DataFrame:
    """A manifest of ``current`` files that keeps what the one before knew of them, with a ``status``.

    ``carried`` names the fields that come from the previous manifest, each with what a file gets that has
    none there (from columns of ``current``). Where a file stands on several lines there, its last counts. Files
    are kept, new, or gone: those have only their key and carried fields. Rows without a key are left out.
    """
    told = F.struct(line, *carried)
    last = previous.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(told, line).alias("__old"))
    own = current.filter(F.col(key).isNotNull()).withColumn("__here", F.lit(True))
    rows = own.join(last, key, "full_outer")
    status = F.when(F.col("__here").isNull(), "gone").when(F.col("__old").isNull(), "new").otherwise("kept")
    fields = [F.coalesce(F.col("__old")[c], F.when(F.col("__here"), default)).alias(c) for c, default in carried.items()]
    rest = [c for c in current.columns if c != key and c not in carried]
    return rows.select(key, *fields, *rest, status.alias("status"))
