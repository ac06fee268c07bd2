"""Bitmaps of hashed digests: a broadcast of bounded size that tells which rows may be among given ones.

A row whose bit is not set is surely not among them and need not be shuffled to find out; the rest meet
the digests in an exact join. With more digests than the bits allow for, more rows go the second way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each digest in it, about, and the most bits of one (64 MB).
SPARE = 16
FILTER_BITS = 2**29
ROW_BITS = 32_768  # of one row of bitmap_construct_agg, held as ints


def _bit(digest: Column, rows: int) -> tuple[Column, Column]:
    """Row and place in it of a digest's bit in a filter of so many rows."""
    at = F.pmod(F.xxhash64(digest), F.lit(rows * ROW_BITS))
    return F.floor(at / ROW_BITS).cast("int"), (at % ROW_BITS).cast("int")


def digest_filter(digests: DataFrame, most: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """``(slot, bits)`` and the number of rows: a bitmap of the hashed ``digest`` column."""
    rows = max(1, min(most, digests.count() * SPARE) // ROW_BITS)
    slot, bit = _bit(F.col("digest"), rows)
    made = digests.select(slot.alias("slot"), bit.cast("long").alias("bit")).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # four bytes as a number, the first the highest; numbers from 2^31 on stand for negative ints
    number = lambda i: F.conv(F.hex(F.substring("bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    signed = lambda n: F.when(n >= 2**31, n - 2**32).otherwise(n).cast("int")
    return made.select("slot", F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 32 - 1)), lambda i: signed(number(i))).alias("bits")), rows


def in_filter(bits: Column, digest: Column, rows: int) -> Column:
    """Whether a digest's bit is set in its slot's ``bits``; a slot without a row has none."""
    bit = _bit(digest, rows)[1]
    within = (3 - F.floor(bit / 8).cast("int") % 4) * 8 + bit % 8
    return F.coalesce(F.getbit(F.get(bits, F.floor(bit / 32).cast("int")), within) == 1, F.lit(False))


def marked(rows: DataFrame, column: str, digests: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` with what the second value needs: whether a row's ``column`` may be a ``digest`` of ``digests``."""
    marks, n = digest_filter(digests)
    met = rows.withColumn("slot", _bit(F.col(column), n)[0]).join(F.broadcast(marks), "slot", "left")
    return met, in_filter(F.col("bits"), F.col(column), n)
