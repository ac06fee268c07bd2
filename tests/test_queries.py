"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from canopyframe import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or more of each family; all of them are compared by the driver.
SOME = """curated_class_balance prj01_raster_identity prj14_label_confidence flt01_confidence_gate flt14_self_training win02_priority_dedup win05_latest_event
agg02_balance_per_year agg04_sheet_year_cube agg07_data_quality agg12_label_counts_rollup agg21_gini agg25_variant_by_architecture top02_queue_page top05_stratified_sample top10_ratio_split
set03_split_coverage set06_column_union join02_labels_by_variant join06_window_labels join09_overlap_pairs join13_chip_buffer join14_rectangle_anti_join join16_visible_instances join22_temporal_views
pc05_local_fallback pc09_feature_bands pc13_consensus_class ras01_chip_offsets ras04_feature_bank ras14_otsu ras17_border_uncertainty met02_threshold_sweep met04_roc_auc met07_breakdown stat03_bootstrap
spl01_block_split spl02_pseudo_blocks spl04_lloyd_regions spl05_raster_chip_split spl06_year_invariant spl07_stride spl08_zone_split spl10_bisection_split leak02_overlap_pairs leak03_remediation win09_review_queue src01_label_csv_scan src10_session_scan src11_annotation_export src12_manifest_reader snk04_place_geojson
snk03_split_manifest ens06_suppression str02_latest_state str03_throughput str04_annotator_sessions str05_review_queue x14_diverse_top x19_image_names udtf01_chip_offsets""".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def test_oracles_bind(duck):
    for sql in registry.ORACLE_SQL.values():
        duck.execute(f"EXPLAIN {sql}")
