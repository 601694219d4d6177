import math

import pytest
from networks import chain, cross, disconnected, make, right_angle, square, values
from pyspark.sql import functions as F

from roadloom.operators import kernels as k
from roadloom.operators import measures as m
from roadloom.operators import paths, topology
from roadloom.plans.network import NetworkError, RoadNetwork
from roadloom.schema import SEGMENTS


def close(a, b, tolerance=1e-12):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (math.isnan(x) and math.isnan(y)) or abs(x - y) <= tolerance, (a, b)


def weights(spark, *w):
    return spark.createDataFrame(list(enumerate(map(float, w))), "segment_index bigint, weight double")


def test_paths_and_degrees(spark):
    two = chain(spark, 2)
    tree = paths.dijkstra(two, 0)
    assert [(r.node, r.distance) for r in tree.orderBy("node").collect()] == [(0, 0.0), (1, 10.0), (2, 20.0)]
    assert paths.reconstruct_path(tree, 2) == [0, 1, 2]
    assert paths.reconstruct_path(tree, 9) == []
    assert [r.distance for r in paths.breadth_first(two, 0).orderBy("node").collect()] == [0.0, 1.0, 2.0]
    assert [r.distance for r in paths.breadth_first(two, 0, 0.5).orderBy("node").collect()] == [0.0, 1.0]
    assert paths.dijkstra(two, 99).count() == 0
    assert [r.distance for r in paths.dijkstra(two, 0, weight=F.col("length_m") * 2).orderBy("node").collect()] == [0.0, 20.0, 40.0]
    with pytest.raises(NetworkError):
        paths.dijkstra(two, 0, weight=-F.col("length_m"))
    assert values(topology.node_degree(cross(spark))) == [1, 4, 1, 1, 1]
    assert values(topology.segment_degree(cross(spark))) == [3, 3, 3, 3]
    apart = disconnected(spark)
    assert values(paths.node_components(apart)) == [0, 0, 0, 1, 1]
    assert values(paths.segment_components(apart)) == [0, 0, 1]


def test_distance_folds(spark):
    two = chain(spark, 2)
    got = m.distance_folds(two).orderBy("node").collect()
    assert [(r.reach, r.farness, r.mean_depth) for r in got] == [(2, 30.0, 15.0), (2, 20.0, 10.0), (2, 30.0, 15.0)]
    close([r.harmonic for r in got], [0.15, 0.2, 0.15])
    assert values(m.reach_count(two, 10.0)) == [1, 2, 1]
    assert values(m.farness(two, 10.0)) == [10.0, 20.0, 10.0]


def test_betweenness(spark):
    assert values(m.node_betweenness(chain(spark, 2), mode="topological")) == [0.0, 1.0, 0.0]
    assert values(m.node_betweenness(cross(spark), mode="topological")) == [0.0, 6.0, 0.0, 0.0, 0.0]
    assert values(m.segment_betweenness(chain(spark, 2), mode="topological")) == [2.0, 2.0]
    assert values(m.primal_choice(chain(spark, 2), 100.0)) == [4.0, 4.0]
    assert values(m.primal_choice(chain(spark, 3), 100.0)) == [6.0, 8.0, 6.0]


def test_parallel_segments_are_two_paths(spark):
    net = make(spark, [(0, 1, 5.0, 0.0, 0.0, 5.0, 0.0), (0, 1, 5.0, 0.0, 0.0, 5.0, 0.0), (1, 2, 5.0, 5.0, 0.0, 10.0, 0.0)])
    assert values(m.segment_betweenness(net)) == [1.0, 1.0, 2.0]
    assert values(topology.node_degree(net)) == [2, 3, 1]
    assert values(topology.segment_degree(net)) == [2, 2, 2]


def test_metric_bucket_measures(spark):
    close(values(m.dmx_integration(chain(spark, 2), 100.0)), [0.1, 0.1])
    close(values(m.dmx_integration(chain(spark, 3), 100.0)), [2 / 30, 2 / 20, 2 / 30])
    assert values(m.dmx_choice(chain(spark, 2), 100.0)) == [1.0, 1.0]
    assert values(m.dmx_choice(chain(spark, 3), 100.0)) == [2.0, 3.0, 2.0]
    # a segment just outside the radius is credited, but not counted
    tight = m.bucket_analysis(chain(spark, 2), 12.0).orderBy("segment_index").collect()
    assert [(r.n, r.choice) for r in tight] == [(1.0, 1.0), (1.0, 1.0)]


def test_primal_and_routes_of_least_angle(spark):
    two = chain(spark, 2)
    close(values(m.primal_integration(two, 100.0)), [0.175, 0.175])
    close(values(m.primal_integration(two, 10.0)), [0.15, 0.15])
    assert m.on_demand_primal_integration(two, 100.0, 1) == pytest.approx(0.175)
    close(values(m.cityseer_harmonic(chain(spark, 3), 400.0)), [2, 2, 2], 2e-7)
    close(values(m.cityseer_harmonic(right_angle(spark), 400.0)), [2 / 3, 2 / 3], 3e-8)
    close(values(m.cityseer_harmonic(right_angle(spark), 400.0, 90.0)), [0.5, 0.5], 3e-8)
    assert values(m.cityseer_harmonic(right_angle(spark), 5.0)) == [0.0, 0.0]
    assert values(m.cityseer_betweenness(chain(spark, 3), 400.0)) == [0.0, 1.0, 0.0]


def bent(spark):
    rows = [(0, 0, 0, 1, 20.0, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], None, None, None, None, None, None, None, None)]
    return RoadNetwork(spark.createDataFrame(rows, SEGMENTS))


def test_segment_centre_measures(spark):
    three, right = chain(spark, 3), right_angle(spark)
    assert values(m.sdna_mean_distance(three, 400.0)) == [15.0, 10.0, 15.0]
    assert values(m.sdna_betweenness(three, 400.0)) == [0.0, 1.0, 0.0]
    assert values(m.sdna_betweenness(three, 15.0)) == [0.0, 0.0, 0.0]
    assert values(m.sdna_links(three, 15.0)) == [2.0, 3.0, 2.0]
    assert values(m.sdna_length(three, 15.0)) == [20.0, 30.0, 20.0]
    assert values(m.sdna_weight(three, 15.0, weights(spark, 2, 3, 5))) == [5.0, 10.0, 8.0]
    close(values(m.sdna_angular_mean_distance(right, 180.0)), [45.0, 45.0])
    close(values(m.sdna_angular_mean_distance(right, 45.0)), [0.0, 0.0])
    close(values(m.sdna_angular_mean_distance(three, 180.0)), [0.0, 0.0, 0.0])
    close(values(m.sdna_angular_betweenness(right, 180.0)), [4 / 3, 4 / 3])
    assert values(topology.line_curvature(bent(spark))) == [90.0]
    close(values(m.sdna_angular_mean_distance(bent(spark), 180.0)), [30.0])
    close(values(m.sdna_angular_betweenness(bent(spark), 180.0)), [1 / 3])


def test_place_accessibility(spark):
    three, right = chain(spark, 3), right_angle(spark)
    one = weights(spark, 0, 10, 0)
    assert values(m.pst_reach(three, 400.0, one)) == [10.0, 10.0, 10.0]
    assert values(m.pst_gravity(three, 400.0, one)) == [1.0, 10.0, 1.0]
    assert values(m.pst_mean_distance(three, 400.0, one)) == [10.0, 0.0, 10.0]
    assert values(m.pst_reach(three, 15.0, weights(spark, 2, 3, 5))) == [5.0, 10.0, 8.0]
    far = weights(spark, 0, 10)
    assert values(m.pst_reach(right, 180.0, far, angular=True)) == [10.0, 10.0]
    close(values(m.pst_gravity(right, 180.0, far, angular=True)), [10 / 90, 10.0])
    close(values(m.pst_mean_distance(right, 180.0, far, angular=True)), [90.0, 0.0])
    with pytest.raises(NetworkError):
        m.pst_gravity(three, 400.0, beta=-1)
    with pytest.raises(NetworkError):
        m.pst_reach(three, 400.0, weights(spark, 1, 2))


def test_discretised_angular_traversal(spark):
    five, four = chain(spark, 5, 3.0), square(spark)
    assert values(m.pst_angular(five, "node_count")) == [5.0] * 5
    assert values(m.pst_angular(five, "total_depth")) == [0.0] * 5
    assert values(m.pst_angular(five, "integration")) == [4.0] * 5
    close(values(m.pst_angular(five, "syntax_integration")), [5**1.2] * 5)
    assert values(m.pst_angular(five, "hillier_integration")) == [25.0] * 5
    assert values(m.pst_angular(five, "choice")) == [0.0, 6.0, 8.0, 6.0, 0.0]
    close(values(m.pst_angular(five, "choice", by_length=True)), [36, 90, 108, 90, 36])
    assert values(m.pst_angular(four, "node_count")) == [4.0] * 4
    close(values(m.pst_angular(four, "total_depth")), [4.0] * 4)
    close(values(m.pst_angular(four, "integration")), [3 / 5] * 4)
    close(values(m.pst_angular(four, "syntax_integration")), [4**1.2 / 5] * 4)
    for degrees, count, depth in ((80.0, 1.0, 0.0), (100.0, 3.0, 2.0)):
        assert values(m.pst_angular(four, "node_count", k.PstRadii(angular=degrees))) == [count] * 4
        close(values(m.pst_angular(four, "total_depth", k.PstRadii(angular=degrees))), [depth] * 4)
    close(values(m.pst_angular(four, "choice")), [1.0] * 4)
    close(values(m.pst_angular(four, "choice", by_length=True)), [36.0] * 4)
    close(values(m.pst_angular(four, "choice_normalized")), [1 / 6] * 4)
    close(values(m.pst_angular(four, "choice_syntax_normalized")), [math.log10(2) / math.log10(6)] * 4)
    assert values(m.pst_angular(five, "node_count", k.PstRadii(steps=1))) == [2.0, 3.0, 3.0, 3.0, 2.0]
    assert values(m.pst_angular(five, "node_count", k.PstRadii(straight=3.0))) == [2.0, 3.0, 3.0, 3.0, 2.0]
    assert m.pst_method("pst_angular_choice", k.PstRadii(walking=400)) == "pst_angular_choice_w400"
    assert m.pst_method("pst_angular_choice") == "pst_angular_choice_rn"


def test_directed_states(spark):
    right, three = right_angle(spark), chain(spark, 3)
    for found in (m.angular_integration(right, 100.0), m.angular_nain(right, 100.0), m.angular_nach(right, 100.0)):
        a, b = values(found)
        assert math.isfinite(a) and a == b
    assert values(m.angular_choice(right, 100.0)) == [0.0, 0.0]
    assert values(m.angular_choice(three, 100.0)) == [0.0, 1.0, 0.0]
    assert all(map(math.isnan, values(m.angular_integration(chain(spark, 2), 100.0))))
    assert all(map(math.isfinite, values(m.angular_integration(chain(spark, 2), 100.0, 1.0))))
    assert values(m.angular_integration(right)) == [4.0, 4.0]
    assert values(m.angular_trail_choice(right)) == [0.0, 0.0]
    assert values(m.angular_integration(three, 5.0, 1.0, [1]))[1] != 0


def test_distances_by_joins_equal_those_by_searches(spark):
    for net in (cross(spark), square(spark), disconnected(spark)):
        for radius in (15.0, math.inf):
            a = {(r.root, r.node): r.distance for r in paths.node_distances(net, radius).collect()}
            b = {(r.root, r.node): r.distance for r in paths.relaxed_node_distances(net, radius).collect()}
            assert a == b
        a = {(r.root, r.segment_index): r.distance for r in paths.centre_distances(net, 25.0).collect()}
        b = {(r.root, r.segment_index): r.distance for r in paths.relaxed_centre_distances(net, 25.0).collect()}
        assert a == b


def test_tiles_equal_the_whole_graph(spark, monkeypatch):
    segments = []
    for i in range(8):
        for j in range(8):
            n = 8 * i + j
            if j < 7:
                segments.append((n, n + 1, 100.0 + (7 * n) % 13, 100.0 * j, 100.0 * i, 100.0 * (j + 1), 100.0 * i))
            if i < 7 and n % 5:
                segments.append((n, n + 8, 100.0 + (5 * n) % 17, 100.0 * j, 100.0 * i, 100.0 * j, 100.0 * (i + 1)))
    whole = {name: values(f(make(spark, segments))) for name, f in FAMILIES.items()}
    monkeypatch.setattr(paths, "BROADCAST_SEGMENTS", 10)
    for name, f in FAMILIES.items():
        close(values(f(make(spark, segments))), whole[name], 1e-9)
    with pytest.raises(NetworkError):
        paths.centre_distances(make(spark, segments), math.inf)


FAMILIES = {
    "reach": lambda n: m.reach_count(n, 250.0),
    "between": lambda n: m.segment_betweenness(n, 250.0),
    "dmx": lambda n: m.dmx_choice(n, 250.0),
    "angular": lambda n: m.angular_trail_choice(n, 250.0),
    "pst": lambda n: m.pst_angular(n, "choice", k.PstRadii(walking=250.0)),
    "simplest": lambda n: m.cityseer_betweenness(n, 250.0),
    "sdna": lambda n: m.sdna_betweenness(n, 250.0),
}


def test_validation_names_the_first_error(spark):
    bad = from_rows(spark, [(0, 1, 1, 2, 5.0), (1, 2, 3, 3, 5.0)])
    with pytest.raises(NetworkError, match="source and target must differ"):
        bad.validate()
    with pytest.raises(NetworkError, match="Duplicate segment_id 1"):
        from_rows(spark, [(0, 1, 1, 2, 5.0), (1, 1, 2, 3, 5.0)]).validate()
    with pytest.raises(NetworkError, match="length_m"):
        from_rows(spark, [(0, 1, 1, 2, math.nan)]).validate()


def from_rows(spark, rows):
    line = [(0.0, 0.0), (1.0, 0.0)]
    return RoadNetwork(spark.createDataFrame([(i, s, a, b, length, line, *[None] * 8) for i, s, a, b, length in rows], SEGMENTS))


def skewed_grid(spark, side=6):
    """Straight streets, some of them broken, with crossings at right angles and a few diagonals."""
    rows = []
    for i in range(side):
        for j in range(side):
            n = side * i + j
            if j < side - 1:
                rows.append((n, n + 1, 100.0 + (7 * n) % 13, 100.0 * j, 100.0 * i, 100.0 * (j + 1), 100.0 * i))
            if i < side - 1 and n % 5:
                rows.append((n, n + side, 100.0 + (5 * n) % 17, 100.0 * j, 100.0 * i, 100.0 * j, 100.0 * (i + 1)))
            if i < side - 1 and j < side - 1 and n % 7 == 3:
                rows.append((n, n + side + 1, 150.0, 100.0 * j, 100.0 * i, 100.0 * (j + 1), 100.0 * (i + 1)))
    return make(spark, rows)


def test_angular_folds_make_no_table_of_pairs(spark, monkeypatch):
    net = skewed_grid(spark)
    n = net.segments.count()
    w = [float(i % 4) for i in range(n)]
    held = weights(spark, *w)
    for kind in ("turn", "bend"):
        far = {}
        for r in paths.centre_distances(net, 100.0, kind).collect():
            far.setdefault(r.root, []).append((w[r.segment_index], r.distance))
        with monkeypatch.context() as patch:
            patch.setattr(m, "centre_distances", None)
            if kind == "bend":
                close(values(m.sdna_angular_mean_distance(net, 100.0, held)), [sum(a * d for a, d in far[s]) / sum(a for a, _ in far[s]) for s in range(n)], 1e-9)
                continue
            close(values(m.pst_reach(net, 100.0, held, angular=True)), [sum(a for a, _ in far[s]) for s in range(n)])
            close(values(m.pst_mean_distance(net, 100.0, held, angular=True)), [sum(a * d for a, d in far[s]) / sum(a for a, _ in far[s]) for s in range(n)], 1e-9)
            close(values(m.pst_gravity(net, 100.0, held, 1.5, 2.0, angular=True)), [sum(a / (d or 2.0) ** 1.5 for a, d in far[s]) for s in range(n)], 1e-9)
            close(values(m.pst_reach(net, 100.0, angular=True)), [float(len(far[s])) for s in range(n)])
