"""Searches on the JVM against their twins in Python."""

import math
import random

import pytest
from networks import disconnected, make
from test_measures import close, skewed_grid, values, weights

from roadloom.operators import kernels as k
from roadloom.operators import measures as m
from roadloom.operators import searches
from roadloom.operators.routes import routes
from roadloom.plans.network import build_graph

MODES = ("angular", "metric", "vectorAngle", "vectorMetric")
BOUNDED = ("metric", "vectorAngle", "vectorMetric")


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9)))


@pytest.mark.parametrize("mode", MODES)
def test_routes_equal_those_of_the_kernels_and_are_dealt_out(spark, mode):
    for net in (skewed_grid(spark), disconnected(spark)):
        graph = build_graph(net.graph.value)
        n = len(graph)
        asked = [(a, (a * 7 + b) % (n + 1)) for a in range(n) for b in (0, 3, 5)] + [(1, 1), (None, 1)]
        found = routes(net, spark.createDataFrame(asked, "from_segment bigint, to_segment bigint").coalesce(1), mode)
        assert found.rdd.getNumPartitions() > 1
        got = {(r.from_segment, r.to_segment): r for r in found.collect()}
        assert len(got) == len(set(asked))
        for a, b in asked:
            known = a is not None and b < n
            want = known and (k.angular_route(graph, a, b) if mode == "angular" else k.node_route(graph, mode, a, b))
            r = got[a, b]
            assert (r.mode, r.found) == (mode, bool(want))
            if want:
                assert [*r.segment_indexes] == want[0]
                assert all(same(x, y) for x, y in zip((r.distance_m, r.angular_cost, r.vector_cost), want[1:], strict=True)), (a, b, r, want)


def town(rng, side, wild, first=0, east=0.0):
    """Rows of streets on a grid, some missing, some twice, some blind; the crossings of a wild one stand where they like."""
    at = [(east + 100.0 * (i % side) + wild * rng.uniform(-30, 30), 100.0 * (i // side) + wild * rng.uniform(-30, 30)) for i in range(side * side)]
    ways = [(i, i + 1) for i in range(side * side) if i % side < side - 1] + [(i + side, i) for i in range(side * side - side)]
    ways = [w for w in ways if rng.random() > 0.12]
    ways += rng.sample(ways, 3)
    return [(first + a, first + b, float(rng.choice((100, 100, 110, 130))), *at[a], *at[b]) for a, b in ways]


@pytest.mark.parametrize("mode", MODES[1:])
@pytest.mark.parametrize("wild", (0, 1))
def test_bounded_searches_find_the_routes_of_searches_of_everything(spark, mode, wild):
    rng = random.Random(11)
    net = make(spark, town(rng, 9, wild) + town(rng, 4, wild, 1000, 3000.0) + town(rng, 2, wild, 2000, 5000.0))
    graph = build_graph(net.graph.value)
    asked = {(rng.randrange(len(graph)), rng.randrange(0, len(graph), 3)) for _ in range(400)}
    got = {(r.from_segment, r.to_segment): r for r in routes(net, spark.createDataFrame(sorted(asked), "from_segment bigint, to_segment bigint"), mode).collect()}
    assert len(got) == len(asked)
    for a, b in asked:
        want, r = k.node_route(graph, mode, a, b), got[a, b]
        assert r.found == bool(want)
        if want:
            assert [*r.segment_indexes] == want[0]
            assert all(same(x, y) for x, y in zip((r.distance_m, r.angular_cost, r.vector_cost), want[1:], strict=True)), (a, b, r, want)


@pytest.mark.parametrize("mode", BOUNDED)
def test_a_route_settles_a_small_part_of_the_nodes(spark, mode):
    rng = random.Random(5)
    net = make(spark, town(rng, 50, 0))
    n = net.size[0]
    asked = [[rng.randrange(n) for _ in range(100)] for _ in range(2)]
    searches._registered(spark, searches.ROUTES)
    search = searches._compiled[spark.sparkContext.applicationId]
    before = search.settled()
    found = search.call(mode, bytes(searches.packed(net).first()["graph"]), *(spark._jvm.PythonUtils.toSeq(x) for x in asked), None)
    assert sum(row.get(3) for row in found) > 90
    assert 0 < search.settled() - before < 100 * 2500 / 2


def maze(side, rows):
    """Streets on a lattice in strips of so many rows, joined at alternate ends only."""
    at = lambda i: (100.0 * (i % side), 100.0 * (i // side))
    ways = [(i, i + 1) for i in range(side * side) if i % side < side - 1]
    ways += [(i, i + side) for i in range(side * side - side) if (i // side + 1) % rows or i % side == (0 if i // side // rows % 2 else side - 1)]
    return [(a, b, float(100 + a % 3 * 10), *at(a), *at(b)) for a, b in ways]


@pytest.mark.parametrize("mode", MODES[2:])
def test_routes_to_one_goal_share_a_search_where_much_of_a_lattice_is_missing(spark, mode):
    rng = random.Random(3)
    net = make(spark, maze(30, 3))
    graph = build_graph(net.graph.value)
    asked = [[rng.randrange(len(graph)) for _ in range(150)], [len(graph) - 1] * 150]
    searches._registered(spark, searches.ROUTES)
    search = searches._compiled[spark.sparkContext.applicationId]
    before = search.settled()
    found = search.call(mode, bytes(searches.packed(net).first()["graph"]), *(spark._jvm.PythonUtils.toSeq(x) for x in asked), None)
    settled = search.settled() - before
    for row, a, b in zip(found, *asked, strict=True):
        want = k.node_route(graph, mode, a, b)
        assert row.get(3) == bool(want)
        if want:
            assert [*row.get(4)] == want[0]
            assert all(same(row.get(5 + i), x) for i, x in enumerate(want[1:]))
    assert 0 < settled < 100_000


def test_credits_of_first_paths_equal_those_of_the_kernels(spark, monkeypatch):
    net = skewed_grid(spark)
    graph = build_graph(net.graph.value)
    monkeypatch.setattr(m, "run", None)  # no row for each pair of root and segment
    for radius in (100.0, 200.0, math.inf):
        for own, to in ((None, None), ([i % 3 for i in range(len(graph))], [i % 5 for i in range(len(graph))])):
            want = [0.0] * len(graph)
            for root in range(len(graph)):
                found = k.centre_search(graph.centres("bend"), root, radius)
                for s, credit in k.first_path_credits(found, root, to or [1.0] * len(graph), 1.0 if own is None else own[root]).items():
                    want[s] += credit
            held = [w and weights(spark, *w) for w in (own, to)]
            close(values(m.sdna_angular_betweenness(net, radius, *held)), want, 1e-9)
