"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = (
    "segments_valid", "dual_edges", "angular_state_edges", "segment_components", "reach_r", "node_betweenness_r", "segment_betweenness_r", "sdna_betweenness_r", "pst_gravity_r",
    "pst_mean_angular_distance_r", "dijkstra_from_node", "bfs_from_node", "canonicalize_segments", "canonicalize_metadata", "unlink_mask_skips", "mif_parse", "geojson_roundtrip", "compare_columns",
    "flatgeobuf_roundtrip", "feature_folder_roundtrip", "segment_csv_network", "columnar_init", "feature_parts", "mif_features", "mif_unlink_masks", "canonicalize_bent", "canonicalize_bent_metadata", "path_from_node",
    "on_demand_primal", "row_hash", "extent",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables are not there")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def tables():
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    import __spark_entry__ as e

    df, sql = e.queries()[name](spark, SF), tables.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    order = [sql.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in sql.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
