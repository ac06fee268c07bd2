"""Streams over several batches with a restart between them, and what their sinks leave behind."""

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from canopyframe.streaming import labels as ST


def batch(numbers, chips, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(n, start + timedelta(minutes=n), f"r{rng.choice(chips)}", 64 * rng.randint(0, 3), 0, rng.choice(["cdw", "no_cdw"]), "manual", "u", 0.5) for n in numbers]


def append(spark, folder, rows):
    spark.createDataFrame(rows, ST.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def plain(rows):
    best = {}
    for r in rows:
        best[r[2:5]] = max(best.get(r[2:5], r), r)
    return {k: (r[0], r[5], r[6]) for k, r in best.items()}


def state(df):
    return {(r.raster, r.row_off, r.col_off): (r.arrival, r.label, r.source) for r in df.collect()}


def sizes(out):
    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in Path(out).glob("data/version=*/bucket=*/*.parquet")}


def test_keyed_state_over_three_batches_rewrites_touched_buckets_only(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"
    parts = [batch(range(100), range(12), 1), batch(range(200, 203), [3], 2), batch(range(150, 154), [5], 3)]
    seen, before = [], {}
    for number, rows in enumerate(parts):
        append(spark, source, rows)
        seen += rows
        # a new query over the same checkpoint: a restart
        got = ST.drain(ST.keyed_latest_state(ST.ingest(spark, source)), folder, "update", ST.KEY, "arrival")
        assert state(got) == plain(seen)
        now = sizes(f"{folder}/out")
        if number:
            touched = {r.b for r in spark.createDataFrame(rows, ST.EVENT_SCHEMA).select(F.pmod(F.hash(*ST.KEY), F.lit(16)).alias("b")).distinct().collect()}
            fresh = {p for p in now if p not in before}
            assert fresh and {int(p.split("bucket=")[1].split("/")[0]) for p in fresh} <= touched and len(touched) < 16
            assert all(now[p] == before[p] for p in now if p in before)
        before = now
    # versions that neither of the last two manifests names have gone
    assert {p.name for p in Path(f"{folder}/out/manifest").iterdir() if p.is_dir()} == {"1", "2"}
    kept = {p.parent.relative_to(f"{folder}/out").as_posix() for p in Path(f"{folder}/out").glob("data/version=*/bucket=*/*.parquet")}
    named = {f"data/version={v}/bucket={b}" for n in (1, 2) for b, v in ST._versions(spark, f"{folder}/out", n).items()}
    assert kept == named


def test_a_chip_whose_state_has_expired_is_not_set_back_by_an_older_event(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"
    day = datetime(2024, 1, 1)
    event = lambda n, days, raster: (n, day + timedelta(days=days), raster, 0, 0, "cdw", "manual", "u", 0.5)
    seen, emitted = [], []
    for rows in ([event(50, 0, "a")], [event(60, 10, "b")], [event(61, 11, "b")], [event(40, 12, "a")]):
        append(spark, source, rows)
        seen += rows
        stream = ST.keyed_latest_state(ST.ingest(spark, source), keep_ms=86_400_000)
        got = ST.drain(stream, folder, "update", ST.KEY, "arrival")
        emitted.append(got.count())
        assert state(got) == plain(seen)
    # the chip's state had gone: the last batch wrote its bucket again, though the newer event stayed
    bucket = spark.createDataFrame([event(40, 12, "a")], ST.EVENT_SCHEMA).select(F.pmod(F.hash(*ST.KEY), F.lit(16))).first()[0]
    manifests = [int(p.name) for p in Path(f"{folder}/out/manifest").iterdir() if p.is_dir()]
    versions = ST._versions(spark, f"{folder}/out", max(manifests))
    assert emitted == [1, 2, 2, 2] and versions[bucket] > 0


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    sink = ST.bucket_sink(f"{tmp_path}/t", ["k"], buckets=4)
    frames = [spark.createDataFrame(rows, "k string, v long") for rows in ([("a", 1), (None, 2), ("c", 3)], [("a", 4), (None, 5)], [("d", 6)])]
    table = lambda: {r.k: r.v for r in ST.read_buckets(spark, f"{tmp_path}/t", frames[0].schema).collect()}
    assert table() == {}
    for number, rows in ((0, frames[0]), (1, frames[1]), (1, frames[1]), (2, frames[2]), (2, frames[2])):
        sink(rows, number)
    assert table() == {"a": 4, None: 5, "c": 3, "d": 6}
    sink(frames[0].limit(0), 3)
    assert table() == {"a": 4, None: 5, "c": 3, "d": 6}
