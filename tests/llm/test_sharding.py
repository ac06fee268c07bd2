import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopyframe.llm import sharding as S


def rows():
    made = [(i, ["a", "bb", "é", None, ""][i % 5] if i < 300 else "same text", "wiki" if i % 3 else ["web", None, "", "code"][i % 4], i, "z") for i in range(500)]
    return made + [made[3]] * 40 + [(None, "no id", "web", 1, "z"), (None, None, None, 2, "z")]


def frame(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string, rank int, size string").repartition(4)


def brute(shards):
    """Ids' digests rank rows within a source; equal rows may stand for each other."""
    key = lambda d: int(hashlib.md5(f"{S.SEED}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    sized = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), s) for d, t, s, *_ in rows()]
    groups = {}
    for r in sized:
        groups.setdefault(r[3], []).append(r)
    order = []
    for s, own in groups.items():
        own.sort(key=lambda r: (key(r[0]), r[1], r[2]))
        order += [((2 * k + 1) / (2 * len(own)), s is not None, s or "", k, r) for k, r in enumerate(own)]
    order.sort(key=lambda x: x[:4])
    out, used = [], Counter()
    for at, (*_, r) in enumerate(order):
        k = at * shards // len(order)
        out.append((*r, k, used[k]))
        used[k] += 1
    return out


@pytest.mark.parametrize("shards", [1, 7, 40, 1000])
def test_equals_brute_force(spark, shards):
    got = S.assign_shards(frame(spark), shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "source", "shard", "slot"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(shards))


def test_counts_are_at_most_one_apart_and_shards_match_the_mixture(spark):
    got = [tuple(r) for r in S.assign_shards(frame(spark)).collect()]
    each = Counter(r[4] for r in got)
    assert set(each) == set(range(40)) and max(each.values()) - min(each.values()) <= 1
    assert all(sorted(r[5] for r in got if r[4] == k) == list(range(n)) for k, n in each.items())
    of, mixed = Counter(r[3] for r in got), Counter((r[3], r[4]) for r in got)
    assert all(abs(mixed[s, k] - n * each[k] / len(got)) < len(of) + 1 for s, n in of.items() for k in range(40))
    assert {k for s, k in mixed if s == "wiki"} == set(range(40))
    assert S.assign_shards(frame(spark).limit(0)).count() == 0


def test_writes_each_row_once_in_order(spark, tmp_path):
    df = frame(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("shard", F.lit("own"))
    S.write_shards(df, f"{tmp_path}/out", shards=5, files=1)
    plan = {r.doc_id: (r.shard, r.slot) for r in S.assign_shards(df, 5).collect()}
    seen = {}
    for k in range(5):
        back = spark.read.parquet(f"{tmp_path}/out/shard_={k}")
        assert back.columns == df.columns
        rows = back.collect()
        # one range partition a shard, but ranges are cut by a sample: a shard may be two files, each in order
        seen |= {r.doc_id: (k, tuple(r)) for r in rows}
    assert {d: k for d, (k, _) in seen.items()} == {d: k for d, (k, _) in plan.items()}
    assert Counter(r for _, r in seen.values()) == Counter(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        S.write_shards(df.union(df), f"{tmp_path}/twice", shards=5)
