"""Group folds with even shares of labels against a plain greedy dealing, and folds within classes."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from canopyframe.operators import folds as D
from canopyframe.operators import splits as S


def rows():
    rng = random.Random(4)
    out = []
    for g in range(90):
        n = rng.choice([1, 1, 2, 3, 3, 20, 70])
        out += [(len(out) + i, f"g{g}", "cdw" if rng.random() < (0.7 if g % 5 == 0 else 0.1) else rng.choice(["no_cdw", "no_cdw", "no_cdw", "unknown", None])) for i in range(n)]
    return out + [(9000 + i, None, "cdw") for i in range(6)]


def frame(spark):
    return spark.createDataFrame(rows(), "id long, place string, label string").repartition(5)


def plain(data, folds, seed):
    """Vector by vector and group by group, in exact fractions."""
    counts = defaultdict(lambda: [0, 0])
    for _, g, y in data:
        counts[g][0] += y == "cdw"
        counts[g][1] += y == "no_cdw"
    total = [max(1, sum(v[c] for v in counts.values())) for c in (0, 1)]
    alike = defaultdict(list)
    for g, v in counts.items():
        alike[tuple(v)].append((hashlib.md5(f"{seed}|{g or ''}".encode()).hexdigest(), g))
    held, fold = [[0, 0] for _ in range(folds)], {}
    for v in sorted(alike, key=lambda v: (-((v[0] - v[1]) ** 2), -v[0], -v[1])):
        own = [g for _, g in sorted(alike[v], key=lambda x: x[0])]
        take = [len(own) // folds] * folds
        for f in range(folds):
            held[f] = [h + take[f] * x for h, x in zip(held[f], v)]
        for _ in range(len(own) % folds):
            grown = [sum(Fraction((h + x) ** 2 - h * h, n * n) for h, x, n in zip(held[f], v, total)) for f in range(folds)]
            best = min(range(folds), key=lambda f: (grown[f], sum(held[f]), f))
            take[best] += 1
            held[best] = [h + x for h, x in zip(held[best], v)]
        for f, n in enumerate(take):
            fold |= dict.fromkeys(own[:n], f)
            own = own[n:]
    return fold


@pytest.mark.parametrize("folds", [2, 3, 7])
def test_group_folds_equal_plain_dealing(spark, folds):
    got = D.stratified_group_folds(frame(spark), "place", "label", ["cdw", "no_cdw"], folds, "9").collect()
    want = plain(rows(), folds, "9")
    assert len(got) == len(rows()) and all(r.fold == want[r.place] for r in got)


def test_shares_are_closer_than_hashed_folds(spark):
    def spread(df):
        per = df.groupBy("fold").agg(F.avg((F.col("label") == "cdw").cast("int")).alias("p"), F.count("*").alias("n"))
        return per.agg(F.stddev_pop("p").alias("p"), (F.stddev_pop("n") / F.avg("n")).alias("n")).first()

    df = frame(spark)
    even = spread(D.stratified_group_folds(df, "place", "label", ["cdw", "no_cdw"], 5, "9"))
    hashed = spread(S.grouped_folds(df, F.coalesce("place", F.lit("")), 5, "9"))
    assert even.p < hashed.p / 3 and even.n < hashed.n
    assert D.stratified_group_folds(df.limit(0), "place", "label", ["cdw", "no_cdw"], 5, "9").count() == 0
    one = D.stratified_group_folds(df.filter("place = 'g0'"), "place", "label", ["cdw", "no_cdw"], 5, "9")
    assert one.select("fold").distinct().count() == 1


def test_folds_within_each_class_differ_by_one_row(spark):
    got = D.stratified_folds(frame(spark), F.col("id"), "label", 4, "s").collect()
    assert len(got) == len(rows())
    n = Counter((r.label, r.fold) for r in got)
    for label in {r.label for r in got}:
        each = [n[label, f] for f in range(4)]
        assert max(each) - min(each) <= 1


def test_hashed_order_numbers_rows_as_the_ranged_one_does(spark, monkeypatch):
    from canopyframe.plans import ranking as P

    df = spark.createDataFrame([(i, [None, "a", "b", "b", "b"][i % 5], i // 3) for i in range(700)], "id long, label string, key long").repartition(7)
    for by in ([], ["label"]):
        want = P.global_row_number(df.withColumn("h", S.hashed("s", "key")), [F.col("h"), F.col("id")], by).drop("h").collect()
        for crowded in (P.CROWDED, 1):
            monkeypatch.setattr(P, "CROWDED", crowded)
            assert sorted(P.hashed_row_number(df, S.hashed("s", "key"), [F.col("id")], by).collect(), key=str) == sorted(want, key=str)
    one = df.withColumn("key", F.lit(1))  # a single digest: ranged after all
    ranged = []
    whole = P.global_row_number
    monkeypatch.setattr(P, "global_row_number", lambda *a: ranged.append(1) or whole(*a))
    numbers = P.hashed_row_number(one, S.hashed("s", "key"), [F.col("id")]).orderBy("id").collect()
    assert ranged and [r.rn for r in numbers] == list(range(1, 701))
    assert P.hashed_row_number(df.limit(0), S.hashed("s", "key"), [], ["label"]).count() == 0
