"""Shards that all hold the corpus's mixture of sources, by proportional stratified interleaving.

Rows of a source are shuffled by a seeded digest of their id and ranked; the row of rank r among n has
the fractional rank (r - 1/2) / n. Sorted by it, rows of all sources alternate in proportion, and the
order is cut into shards whose row counts are at most one apart. A stretch of the order holds of each
source its share of rows but for less than one at either end and what the cut is off, so a shard's count of
a source is within one row a source of what its size asks for.

Scale. Texts are read once and not moved: what is ranked are rows of id, source, size and checksum. Ranks
within a source and places in the order come from range partitions and partition offsets, so neither a hot
source nor an id that is repeated very often meets in one task. Writing shards moves the texts by shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.plans.lineage import cut
from canopyframe.plans.ranking import global_row_number

SHARDS, SEED = 40, 17
#: Bytes that a row counts beside its text.
ROW_BYTES = 16
#: Sources whose numbers of rows are broadcast.
FEW_SOURCES = 100_000


def shuffled(doc_id: Column, seed: int = SEED) -> Column:
    """The first 60 bits of a digest of seed and id; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``id_col, size, text_crc32, source, shard, slot``.

    ``size`` is the text's UTF-8 bytes and ``ROW_BYTES``; ``slot`` counts a shard's rows from 0 in the order.
    A null text has no bytes and the checksum of none. Rows without a source are a source of their own, as are those of an
    empty one. Repeated rows stay, each with a slot; equal texts are rows like any others. Ids may be of
    any orderable type, and null. With fewer rows than shards some shards are empty; an empty table gives an
    empty result. Other columns are not looked at.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("crc"), F.col(source_col).alias("source"))
    # the row's place in the scan lets repeated ids be dealt to several ranges
    rows = rows.withColumn("h", shuffled(F.col("id"), seed)).withColumn("place", F.monotonically_increasing_id())
    ranked = global_row_number(rows, [F.col("h"), F.col("id"), F.col("size"), F.col("crc"), F.col("place")], ["source"], "rank")
    of = cut(ranked.groupBy("source").agg(F.max("rank").alias("n")).select(F.col("source").alias("s"), "n"))
    sources, total = of.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    share = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("n")).cast("double")
    # beyond that many sources, the join is left to AQE, which splits a hot one
    ranked = ranked.join(F.broadcast(of) if sources <= FEW_SOURCES else of, F.col("source").eqNullSafe(F.col("s"))).withColumn("share", share)
    placed = global_row_number(ranked.select("id", "size", "crc", "source", "rank", "share"), [F.col("share"), F.col("source"), F.col("rank")], name="at")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # least place with shard * total <= place * shards
    out = placed.withColumn("shard", F.expr(f"(at - 1) * {shards} div {total}")).withColumn("slot", F.col("at") - 1 - first)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "source", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, files: int = 1, id_col: str = "doc_id", **columns) -> str:
    """Writes ``docs`` with its own columns as ``folder/shard=k``, rows by slot, ``files`` files a shard of successive slots.

    Ids must not repeat, since a row meets its shard by its id; that is checked first. Where the documents
    have a column ``shard``, the folders' name has as many underscores behind it as make it another.
    """
    plan = assign_shards(docs, shards, id_col, **columns).select(F.struct(F.col(id_col).alias("id"), "shard", "slot").alias("plan"))
    if docs.groupBy(id_col).count().filter("count > 1").limit(1).count():
        raise ValueError("ids repeat")
    name = "shard"
    while name in docs.columns:
        name += "_"
    # the document's columns ride in a struct, so that no name of theirs can clash
    row = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"))
    rows = row.join(plan, F.col("row")[id_col].eqNullSafe(F.col("plan.id")))
    dealt = rows.repartitionByRange(shards * files, "plan.shard", "plan.slot").sortWithinPartitions("plan.shard", "plan.slot")
    dealt.select("row.*", F.col("plan.shard").alias(name)).write.partitionBy(name).parquet(folder)
    return folder


SQL = rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 15) AS BIGINT) AS seeded FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seeded, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM b),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * rank - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source NULLS FIRST, rank) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * {SHARDS} // total AS shard FROM o)
SELECT doc_id, CAST(length(h) // 2 + {ROW_BYTES} AS BIGINT) AS size,
       CAST(xor(4294967295, list_reduce(range(0, length(h) // 2), lambda c, k: xor(c >> 8, t[(xor(c, CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)) & 255) + 1]), 4294967295)) AS BIGINT) AS text_crc32,
       'rows' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, tab
"""
