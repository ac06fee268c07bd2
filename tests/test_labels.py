from pyspark.sql import functions as F

from canopyframe.functions import keys as K
from canopyframe.operators import labels as L

SCHEMA = "arrival long, raster string, row_off int, col_off int, label string, source string, model_prob double, timestamp string"
R = "436646_2018_madal_chm_max_hag_20cm.tif"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_gate_reasons(spark):
    rows = [(1, R, 0, 0, "cdw", "auto", 0.95, "a"), (2, R, 0, 64, "cdw", "auto", 0.94, "a"), (3, R, 0, 128, "no_cdw", "auto", 0.05, "a"), (4, R, 0, 192, "no_cdw", "auto", None, "a"), (5, R, 0, 256, "cdw", "Manual_x", None, "a"), (6, R, 1, 0, "unknown", "manual", 1.0, "a"), (7, R, None, 0, "cdw", "manual", 1.0, "a"), (8, R, 2, 0, "cdw", None, None, None)]
    got = {r.arrival: r.reason for r in L.gate(frame(spark, rows)).collect()}
    assert got == {1: "threshold_gate", 2: "below_threshold", 3: "threshold_gate", 4: "no_prob", 5: "manual_or_reviewed", 8: "no_prob"}


def test_manual_beats_newer_auto_and_later_arrival_wins_ties(spark):
    rows = [(1, R, 0, 0, "cdw", "auto", 0.99, "2025"), (2, R, 0, 0, "no_cdw", "manual", None, "2020"), (3, R, 64, 0, "cdw", "auto", 0.99, "2024"), (4, R, 64, 0, "no_cdw", "auto", 0.01, "2024")]
    got = {(r.row_off): (r.label, r.source) for r in L.curate(frame(spark, rows)).collect()}
    assert got == {0: ("no_cdw", "manual"), 64: ("no_cdw", "auto_threshold_gate_v4")}
    assert L.curate(frame(spark, [])).count() == 0


def test_latest_by_window_and_by_aggregate_agree(spark):
    rows = [(i, R, 64 * (i % 3), 0, "cdw" if i % 2 else "no_cdw", "auto", i / 100, "t") for i in range(40)]
    df = frame(spark, rows)
    a = sorted(map(tuple, L.latest(df).select(*L.KEY, "arrival", "label").collect()))
    b = sorted(map(tuple, L.latest_struct(df, L.KEY).select(*L.KEY, "arrival", "label").collect()))
    assert a == b and len(a) == 3


def test_identity_of_odd_names(spark):
    df = spark.createDataFrame([(R,), ("dir/other.v2.tif",), ("123_2020_x_chm_max_hag_20cm.tif",), ("",), (None,)], "raster string")
    got = [tuple(r.i) for r in df.select(K.raster_identity("raster").alias("i")).collect()]
    assert got[0] == (R[:-4], "436646", "2018", "madal", "436646_madal", 436, 646)
    assert got[1] == ("other.v2", None, "unknown", "unknown", "other.v2", None, None)
    assert got[2][1:] == ("123", "2020", "x", "123_x", None, None)
    assert got[3][4] == ""


def test_sizes_tokens_and_scores(spark):
    row = spark.range(1).select(
        K.size_bytes(F.lit("1.5 MB")).alias("a"),
        K.size_bytes(F.lit("none")).alias("b"),
        K.pick_score(F.lit(None).cast("double"), F.lit(1.7)).alias("c"),
        K.tile_id_fields(F.lit("a:b:gauss:3:4")).alias("d"),
        K.tile_id_fields(F.lit("a:b")).alias("e"),
        K.source_rank(F.lit("self_train_2")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, tuple(row.d), row.e, row.f) == (1_500_000, None, 1.0, ("a:b", "gauss", 3, 4), None, 2)


def test_review_queue_keeps_the_first_check(spark):
    df = frame(spark, [(1, R, 0, 0, "cdw", "auto", 0.1, "a"), (2, R, 64, 0, "cdw", "auto", 0.5, "a")])
    got = {(r.row_off): r.check for r in L.review_queue([("x", 2, df), ("y", 1, df.filter("row_off = 0"))]).collect()}
    assert got == {0: "y", 64: "x"}


def test_stream_in_update_mode_merges_batches_by_key(spark, tmp_path):
    """Three batches: a key of an earlier batch stays, a later event of a key replaces it."""
    from canopyframe.plans.lineage import scratch
    from canopyframe.streaming import labels as ST

    def event(arrival, row, label):
        return (arrival, None, "r", row, None if row == 9 else 0, label, "manual", "u", 0.5)

    folder = f"{tmp_path}/in"
    for batch in ([event(1, 0, "cdw"), event(2, 64, "cdw")], [event(3, 64, "no_cdw"), event(4, 9, "cdw")], [event(5, 9, "unknown")]):
        spark.createDataFrame(batch, ST.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    out = ST.drain(ST.latest_state(ST.ingest(spark, folder, files_per_trigger=1)), scratch(spark, "update"), "update", ST.KEY)
    assert sorted((r.row_off, r.arrival, r.label) for r in out.collect()) == [(0, 1, "cdw"), (9, 5, "unknown"), (64, 3, "no_cdw")]


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    import pytest
    from types import SimpleNamespace

    from canopyframe.plans.lineage import ensure_checkpoint_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_each_name_is_parsed_once(spark):
    """One row a name; what is parsed is read from the saved names."""
    from canopyframe.functions import keys as K

    names = ["436640_2018_madal_chm_max_hag_20cm.tif", "437641_2020_tava_chm_max_hag_20cm.tif", "other.tif"]
    df = spark.createDataFrame([(i, names[i % 3]) for i in range(30)], "arrival long, raster string")
    got = K.identities(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.with_identity(df).drop("arrival").distinct().collect()))
    assert "Aggregate" not in got.select("tile")._jdf.queryExecution().optimizedPlan().toString()
