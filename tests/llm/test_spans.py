import re

from pyspark.sql import functions as F

from canopyframe.llm import spans as S


def test_places_of_many_matches_across_blocks(spark):
    texts = [None, "", "none", *[" ".join(f"é{i} x" for i in range(n)) for n in (1, S.BLOCK - 1, S.BLOCK, S.BLOCK + 1, 5 * S.BLOCK + 3)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", S.matches(F.coalesce("t", F.lit("")), "é[0-9]+").alias("m")).collect():
        assert [(x.start, x.end, x.m) for x in r.m] == [(*m.span(), m.group()) for m in re.finditer("é[0-9]+", texts[r.id] or "")]
