import json
import math

import pytest
from networks import chain, right_angle

from roadloom.operators.canonicalize import Options, canonicalize
from roadloom.operators.routes import shortest_route
from roadloom.plans import catalog, cli, validation
from roadloom.plans.network import NetworkError
from roadloom.plans.rowhash import fold, row_hash
from roadloom.plans.session import RoadNetworkSession
from roadloom.schema import FEATURES, MASKS
from roadloom.sources import flatgeobuf, geojson, mapinfo
from roadloom.streaming.requests import route_stream


def features(spark, *lines):
    """(parts, length) rows."""
    return spark.createDataFrame([(i, str(i + 1), parts, {"length_m": str(length)}) for i, (parts, length) in enumerate(lines)], FEATURES)


def rows(network):
    return network.segments.orderBy("segment_index").collect()


CROSS = (([[(0.0, 0.0), (10.0, 0.0)]], 10), ([[(5.0, -5.0), (5.0, 5.0)]], 10))


def test_crossing_lines_are_noded(spark):
    made = canonicalize(features(spark, *CROSS), Options(preserve_source_ids=True))
    assert [r.length_m for r in rows(made.network)] == [5.0] * 4
    assert [r.original_feature_id for r in rows(made.network)] == ["1", "1", "2", "2"]
    assert (made.metadata["node_count"], made.metadata["intersections_split"]) == (5, 1)
    assert [(r.source, r.target) for r in rows(made.network)] == [(0, 1), (1, 2), (3, 1), (1, 4)]


def test_masks_keep_lines_whole(spark):
    masks = spark.createDataFrame([(5.0, 0.0, 0.5)], MASKS)
    made = canonicalize(features(spark, *CROSS), Options(unlink_masks=masks))
    assert (made.metadata["output_segment_count"], made.metadata["intersections_split"], made.metadata["intersections_skipped_by_unlink"]) == (2, 0, 1)


def test_parts_share_the_length(spark):
    made = canonicalize(features(spark, ([[(0.0, 0.0), (10.0, 0.0)], [(20.0, 0.0), (30.0, 0.0)]], 20)))
    assert [r.length_m for r in rows(made.network)] == [10.0, 10.0]
    found = row_hash(made.network)
    assert len(found) == 16 and found != fold([(r.segment_id, r.source, r.target, r.length_m) for r in rows(made.network)][::-1])


def test_bent_line_keeps_vertices(spark):
    made = canonicalize(features(spark, ([[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]], 20), ([[(5.0, 5.0), (15.0, 5.0)]], 10)))
    assert made.metadata["intersections_split"] == 1
    first = rows(made.network)[0]
    assert [(p.x, p.y) for p in first.geometry] == [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)] and first.length_m == 15.0


def test_end_stubs(spark):
    made = canonicalize(features(spark, ([[(0.0, 0.0), (10.0, 0.0)]], 10), ([[(1.0, -1.0), (1.0, 1.0)]], 2)), Options(end_stub_min_ratio=0.2))
    assert (made.metadata["discarded_end_stubs"], made.metadata["output_segment_count"]) == (1, 3)


def test_bad_lines(spark):
    with pytest.raises(NetworkError, match="No valid"):
        canonicalize(features(spark, ([[(0.0, 0.0), (math.nan, 1.0)]], 1)))
    kept = canonicalize(features(spark, ([[(0.0, 0.0), (math.inf, 1.0), (4.0, 0.0)]], -1)))
    assert [r.length_m for r in rows(kept.network)] == [4.0]


def test_geojson_round_trip(spark, tmp_path):
    network = chain(spark, 2)
    text = geojson.to_geojson(network)
    assert "metadata" not in json.loads(text)
    path = tmp_path / "g.json"
    path.write_text(text)
    again = geojson.read_network(spark, str(path))
    assert [(r.source, r.target, r.length_m, r.x0, r.geometry) for r in rows(again)] == [(r.source, r.target, r.length_m, r.x0, r.geometry) for r in rows(network)]
    network.metadata["source_dataset"] = "x"
    path.write_text(geojson.to_geojson(network))
    assert geojson.read_network(spark, str(path)).metadata == {"source_dataset": "x"}
    geojson.write_features(network, str(tmp_path / "lines"))
    assert [r.length_m for r in rows(geojson.read_feature_lines(spark, str(tmp_path / "lines")))] == [10.0, 10.0]
    path.write_text('{"type": "Feature"}')
    with pytest.raises(NetworkError):
        geojson.read_network(spark, str(path))


def test_flatgeobuf_round_trip(spark, tmp_path):
    path = tmp_path / "g.FGB"
    path.write_bytes(flatgeobuf.to_flatgeobuf(chain(spark, 2)))
    again = geojson.read_network(spark, str(path))
    assert [(r.source, r.target, r.length_m) for r in rows(again)] == [(0, 1, 10.0), (1, 2, 10.0)]
    assert [(p.x, p.y) for p in rows(again)[1].geometry] == [(10.0, 0.0), (20.0, 0.0)]
    with pytest.raises(NetworkError):
        flatgeobuf.decode(b"not a file at all")


def texts(spark, *lines):
    return spark.createDataFrame([("\n".join(lines),)], "value string")


def test_mapinfo(spark):
    mif = texts(spark, "Version 300", "Columns 2", "  Name Char(10)", "  length_m Float", "Data", "Line 0 0 10 0", "PLINE 2", "1 1", "2 2", "LINE 5 -5 5 5")
    mid = texts(spark, '"A, b",10', "", '"C",10')
    found = mapinfo.parse_mif(mif, mid).orderBy("row").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in found] == [(0, 0, 10, 0), (5, -5, 5, 5)]
    assert [r.properties for r in found] == [{"Name": "A, b", "length_m": "10"}, {"Name": "C", "length_m": "10"}]
    assert canonicalize(mapinfo.features_of(mapinfo.parse_mif(mif, mid))).metadata["output_segment_count"] == 4
    assert mapinfo.parse_mif(mif).first().properties == {"Name": None, "length_m": None}


def test_normalizer_and_masks(spark):
    f = features(spark, ([[(0.0, 0.0), (10.0, 0.0)]], 1), ([[(0.0, 10.0), (10.0, 10.0)]], 1))
    n = mapinfo.LocalNormalizer.of(f)
    assert n.scale == 0.1
    moved = n.apply(f).orderBy("feature_index").collect()
    assert tuple(moved[0].parts[0][0]) == (-0.5, -0.5) and tuple(moved[1].parts[0][1]) == (0.5, 0.5)
    mask = mapinfo.unlink_masks(spark.createDataFrame([(4.5, 0.0, 5.5, 0.0)], "x0 double, y0 double, x1 double, y1 double"), 0.25).first()
    assert (mask.cx, mask.cy, mask.radius) == (5.0, 0.0, 0.75)


def test_column_grammar(spark):
    assert catalog.parse_column("dmx_angular_choice_r800") == catalog.AnalysisColumn("dmx_angular", "choice", 800)
    assert catalog.parse_column("angular_nach_r2000").method == "angular"
    for bad in ("dmx_nain_r400", "cityseer_choice_r400", "dmx_choice_r123", "dmx_choice", "dmx_choice_r400x"):
        assert catalog.parse_column(bad) is None
    assert len(catalog.allowed_columns()) == 90 == catalog.method_catalog(spark).count()
    assert catalog.display_name("dmx", "choice", 400) == "DepthmapX-style metric - Metric choice R400"


def test_columns_of_one_pass_equal_single_columns(spark):
    network = right_angle(spark)
    names = [c for c in catalog.allowed_columns() if c.endswith("_r400")]
    wide = {r.segment_index: r for r in catalog.compute_columns(network, names).collect()}
    for name in names:
        for r in catalog.compute_column_by_name(network, name).values.collect():
            assert r.value == wide[r.segment_index][name] or (math.isnan(r.value) and math.isnan(wide[r.segment_index][name]))


def test_session(spark):
    session, seen = RoadNetworkSession(spark), []
    assert session.handle({"type": "route"})["type"] == "error"
    ready = session.handle({"type": "init", "source": [0, 1, 2], "target": [1, 2, 3], "length": [10.0] * 3, "x0": [0.0, 10.0, 20.0], "y0": [0.0] * 3, "x1": [10.0, 20.0, 30.0], "y1": [0.0] * 3})
    assert ready["type"] == "ready" and ready["row_hash"] == row_hash(chain(spark, 3))
    full = session.handle({"type": "fullmap", "method": "dmx", "measure": "choice", "radius": 400}, seen.append)
    assert full["values"] == [2.0, 3.0, 2.0]
    assert [p["phase"] for p in seen] == ["started", "running", "running", "completed"]
    assert session.handle({"type": "ondemand", "method": "dmx", "measure": "integration", "radius": 400, "segment_index": 1})["value"] == pytest.approx(0.1)
    route = session.handle({"type": "route", "mode": "metric", "from_segment": 0, "to_segment": 2})
    assert route["segment_indexes"] == [0, 1, 2] and route["distance_m"] == 20.0
    assert session.handle({"type": "route", "mode": "angular", "from_segment": 0, "to_segment": 99}) == {"type": "error", "id": None, "message": "No route found."}
    assert session.handle({"type": "fullmap", "method": "dmx", "measure": "nain", "radius": 400})["type"] == "error"
    session.register_views("t")
    assert spark.sql("SELECT count(*) AS n FROM t_dual_edges").first().n == 4


def test_routes(spark):
    three = chain(spark, 3)
    assert shortest_route(three, "metric", 0, 2) | {"angular_cost": None, "vector_cost": None} == {"segment_indexes": [0, 1, 2], "distance_m": 20.0, "angular_cost": None, "vector_cost": None}
    assert shortest_route(three, "angular", 0, 2)["angular_cost"] == 0.0
    assert shortest_route(three, "vectorMetric", 0, 2)["vector_cost"] == 0.0
    assert shortest_route(three, "vectorAngle", 2, 0)["segment_indexes"] == [2, 1, 0]
    assert shortest_route(three, "metric", 1, 1)["distance_m"] == 0.0
    assert shortest_route(three, "metric", 0, 7) is None
    with pytest.raises(NetworkError):
        shortest_route(three, "topological", 0, 1)


def test_route_requests_as_a_stream(spark, tmp_path):
    spark.createDataFrame([(0, 2, "metric"), (2, 0, "angular")], "from_segment bigint, to_segment bigint, mode string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("from_segment bigint, to_segment bigint, mode string").parquet(str(tmp_path / "in"))
    query = route_stream(chain(spark, 3), stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert sorted(r.segment_indexes for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [[0, 1, 2], [2, 1, 0]]


METRIC = "Ref,x1,y1,x2,y2,Metric Choice,Metric Mean Depth,Segment Length\n0,0,0,10,0,2,15,10\n1,10,0,20,0,3,10,10\n2,20,0,30,0,2,15,10\n"
BINNED = "Ref,x1,y1,x2,y2,T1024 Choice,T1024 Integration,T1024 Node Count,T1024 Total Depth,Segment Length\n0,0,0,10,0,0,4,2,1,10\n1,10,0,10,10,0,4,2,1,10\n"


def test_reports(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(METRIC)
    report = validation.validate_metric_csv(spark, str(path))
    assert report["status"] == "pass" and report["comparisons"]["metric_choice"]["exact_matches"] == 3
    assert report["comparisons"]["metric_mean_depth"]["pearson"] == pytest.approx(1)
    assert validation.validate_metric_csv(spark, str(path), 20.0)["status"] == "review"
    path.write_text(BINNED)
    assert validation.validate_angular_csv(spark, str(path))["status"] == "pass"
    found = validation.validate_diamond(spark)
    assert found["status"] == "pass" and all(c["node_difference"] < 1e-9 for c in found["comparisons"])


def test_command_line(spark, tmp_path, capsys):
    source, out = tmp_path / "in.json", tmp_path / "out.json"
    line = lambda i, a, b: {"type": "Feature", "id": i, "geometry": {"type": "LineString", "coordinates": [a, b]}, "properties": {"length_m": 10}}
    source.write_text(json.dumps({"type": "FeatureCollection", "features": [line(1, [0, 0], [10, 0]), line(2, [10, 0], [20, 0])]}))
    assert cli.main(["canonicalize", "--input", str(source), "--output", str(out)], spark) == 0
    metadata = json.loads((tmp_path / "out.json.metadata.json").read_text())
    assert (metadata["output_segment_count"], metadata["node_count"]) == (2, 3)
    assert cli.main(["analyze", "--input", str(out), "--column", "dmx_integration_r400"], spark) == 0
    assert json.loads(capsys.readouterr().out)["values"] == [0.10000000149011612] * 2
    assert cli.main(["analyze", "--input", str(out), "--column", "nothing"], spark) == 1
    assert cli.main(["frobnicate"], spark) == 1
    assert cli.main([], spark) == 1
    assert cli.main(["help"], spark) == 0
    assert cli.main(["methods", "--output", str(tmp_path / "c.json")], spark) == 0
    assert len(json.loads((tmp_path / "c.json").read_text())["methods"]) == 90
