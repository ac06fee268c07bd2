from pyspark.sql import functions as F

from canopyframe.llm import bitmaps as M


def test_filter_holds_all_that_it_was_given(spark):
    digests = spark.range(20_000).selectExpr("sha2(cast(id AS string), 256) AS digest")
    for most in (M.FILTER_BITS, M.ROW_BITS):
        marks, rows = M.digest_filter(digests.filter("conv(substring(digest, 1, 2), 16, 10) < 128"), most)
        met = digests.withColumn("slot", M._bit(F.col("digest"), rows)[0]).join(marks, "slot", "left").select("digest", M.in_filter(F.col("bits"), F.col("digest"), rows).alias("may"))
        got = [(int(r.digest[:2], 16) < 128, r.may) for r in met.collect()]
        assert len(got) == 20_000 and all(may for given, may in got if given)
        share = sum(may for given, may in got if not given) / sum(not given for given, _ in got)
        assert share < (0.1 if most == M.FILTER_BITS else 0.5)
