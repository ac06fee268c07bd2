"""Table functions for SQL callers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="row_off int")
class ChipOffsets:
    """``chip_offsets(size, chunk, stride)``: offsets along an axis, with the border chip where over a
    quarter chip is left uncovered."""

    def eval(self, size: int, chunk: int, stride: int):
        if size is None or size <= chunk:
            yield (0,)
            return
        last = 0
        for last in range(0, size - chunk + 1, stride):
            yield (last,)
        if size - (last + chunk) > chunk // 4:
            yield (size - chunk,)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chip_offsets", ChipOffsets)
