"""Centrality measures, each a table keyed by ``node`` or ``segment_index`` with a column ``value``.

What is a fold over distances is an aggregation of a distance table. What depends on the order of a
search comes from a kernel that returns one row of totals for each root and credits for other rows,
which are then summed. All quantities of a family and radius come from one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators import kernels as k
from roadloom.operators import searches
from roadloom.operators.paths import all_nodes, all_segments, centre_distances, node_distances, run
from roadloom.plans.network import NetworkError, RoadNetwork
from roadloom.schema import ANGULAR_DEPTH_SCALE

INF = math.inf


def radius_label(radius: float) -> str:
    return "n" if math.isinf(radius) else f"{radius:g}"


# Folds over node distances


def distance_folds(network: RoadNetwork, radius: float = INF, mode: str = "metric") -> DataFrame:
    """(node, reach, farness, harmonic, mean_depth) of every node, from the other nodes within the radius."""
    d = node_distances(network, radius, mode).where("distance > 0").groupBy(F.col("root").alias("node"))
    folded = d.agg(F.count(F.lit(1)).alias("reach"), F.sum("distance").alias("farness"), F.sum(1 / F.col("distance")).alias("harmonic"), F.avg("distance").alias("mean_depth"))
    nodes = all_nodes(network).withColumnRenamed("root", "node")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return nodes.join(folded, "node", "left").select("node", F.coalesce("reach", F.lit(0)).alias("reach"), zero("farness"), zero("harmonic"), zero("mean_depth"))


def reach_count(network: RoadNetwork, radius: float = INF, mode: str = "metric") -> DataFrame:
    return distance_folds(network, radius, mode).select("node", F.col("reach").alias("value"))


def farness(network: RoadNetwork, radius: float = INF, mode: str = "metric") -> DataFrame:
    return distance_folds(network, radius, mode).select("node", F.col("farness").alias("value"))


def harmonic_closeness(network: RoadNetwork, radius: float = INF, mode: str = "metric") -> DataFrame:
    return distance_folds(network, radius, mode).select("node", F.col("harmonic").alias("value"))


def mean_depth(network: RoadNetwork, radius: float = INF, mode: str = "metric") -> DataFrame:
    return distance_folds(network, radius, mode).select("node", F.col("mean_depth").alias("value"))


def primal_integration(network: RoadNetwork, radius: float = INF) -> DataFrame:
    """Mean of the harmonic closeness of a segment's two ends."""
    h = harmonic_closeness(network, radius)
    s = network.segments.select("segment_index", "source", "target")
    at = lambda c: h.select(F.col("node").alias(c), F.col("value").alias(f"{c}_value"))
    return s.join(at("source"), "source").join(at("target"), "target").select("segment_index", ((F.col("source_value") + F.col("target_value")) / 2).alias("value"))


def on_demand_primal_integration(network: RoadNetwork, radius: float, segment: int) -> float:
    """The value of one segment, from searches of its two ends only."""
    ends = network.segments.where(F.col("segment_index") == segment).select(F.explode(F.array("source", "target")).alias("root"))
    total = node_distances(network, radius, roots=ends.distinct()).where("distance > 0").agg(F.sum(1 / F.col("distance"))).first()[0]
    return (total or 0.0) / 2


# Sums of path credits

_CREDITS = "kind bigint, at bigint, credit double"


def _summed(found: DataFrame, keys: DataFrame, name: str, factor: float = 1.0) -> DataFrame:
    total = found.groupBy(F.col("at").alias(name)).agg(F.sum("credit").alias("credit"))
    return keys.withColumnRenamed("root", name).join(total, name, "left").select(name, (F.coalesce("credit", F.lit(0.0)) * factor).alias("value"))


def _path_credits(network: RoadNetwork, radius: float, mode: str) -> DataFrame:
    hops = mode == "topological"

    def kernel(graph: k.StreetGraph, root: int):
        on_node, on_segment = k.path_credits(graph, root, radius, hops)
        for node, credit in on_node.items():
            if credit:
                yield 0, node, credit
        for s, credit in on_segment.items():
            yield 1, graph.index[s], credit

    return run(network, all_nodes(network), kernel, _CREDITS, radius * network.size[1] if hops else radius, by_node=True)


def node_betweenness(network: RoadNetwork, radius: float = INF, mode: str = "metric") -> DataFrame:
    """Shares of shortest paths between other nodes through each node, each unordered pair once."""
    return _summed(_path_credits(network, radius, mode).where("kind = 0"), all_nodes(network), "node", 0.5)


def segment_betweenness(network: RoadNetwork, radius: float = INF, mode: str = "metric") -> DataFrame:
    """Shares of shortest paths between nodes along each segment, each unordered pair once."""
    return _summed(_path_credits(network, radius, mode).where("kind = 1"), all_segments(network), "segment_index", 0.5)


def primal_choice(network: RoadNetwork, radius: float = INF) -> DataFrame:
    """Segment betweenness over ordered pairs: not halved."""
    return _summed(_path_credits(network, radius, "metric").where("kind = 1"), all_segments(network), "segment_index")


# Folds over distances between segment centres


def weights_or_ones(network: RoadNetwork, weights: DataFrame | None) -> DataFrame:
    """(segment_index, weight): ones, or the given table, which must cover every segment with finite weights >= 0."""
    segments = network.segments.select("segment_index")
    if weights is None:
        return segments.withColumn("weight", F.lit(1.0))
    joined = segments.join(weights.select("segment_index", F.col("weight").cast("double")), "segment_index", "left")
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == INF)
    if joined.where(bad).limit(1).count():
        raise NetworkError("Weights must be aligned to segments, finite and non-negative.")
    return joined


def _centre_fold(network: RoadNetwork, radius: float, kind: str, value: Column, weights: DataFrame | None = None, where: str = "true") -> DataFrame:
    """One aggregate for each root over (distance, weight, length_m, self) of the segments within the radius."""
    extra = weights_or_ones(network, weights).join(network.ends.select("segment_index", "length_m", "curvature"), "segment_index")
    d = centre_distances(network, radius, kind).join(extra, "segment_index").withColumn("self", F.col("root") == F.col("segment_index")).where(where)
    found = d.groupBy(F.col("root").alias("segment_index")).agg(value.alias("value"))
    return network.segments.select("segment_index").join(found, "segment_index", "left").select("segment_index", F.coalesce("value", F.lit(0.0)).alias("value"))


def _angular_fold(network: RoadNetwork, radius: float, kind: str, value: Column, weights: DataFrame | None = None, beta: float = 1.0, self_distance: float = 1.0) -> DataFrame:
    """One value for each root from its sums (reach, turned, gravity, own), made within the search.

    An angular radius doesn't bound what is reached: a table of distances would have a row for almost every
    pair of segments. Streets stand for their segments, with the sum of their weights.
    """
    held = None
    if weights is not None:
        _ = network.graph  # raises for a graph too large to hold
        held = network.spark.sparkContext.broadcast(weights_or_ones(network, weights).toArrow())

    def of_streets(graph: k.StreetGraph) -> tuple[list[float], list[float], dict]:
        made = graph.folds.get(kind)
        if made is None or made[0] is not (held and held.value):
            street, near = graph.streets(kind)
            own = [1.0] * len(graph) if held is None else [0.0] * len(graph)
            if held is not None:
                for i, w in zip(held.value["segment_index"].to_pylist(), held.value["weight"].to_pylist(), strict=True):
                    own[graph.position[i]] += w
            total = [0.0] * len(near)
            for s, w in enumerate(own):
                total[street[s]] += w
            made = graph.folds[kind] = held and held.value, own, total, {}
        return made[1:]

    def kernel(graph: k.StreetGraph, root: int):
        street, near = graph.streets(kind)
        own, total, seen = of_streets(graph)
        key = street[root], radius, beta, self_distance
        if key not in seen:
            reach = turned = gravity = 0.0
            for s, d in k.street_distances(near, street[root], radius).items():
                reach += total[s]
                turned += total[s] * d
                gravity += total[s] / (self_distance if d == 0 else d) ** beta
            seen[key] = reach, turned, gravity
        yield graph.index[root], *seen[key], own[root], graph.curvature[root]

    found = run(network, all_segments(network), kernel, "segment_index bigint, reach double, turned double, gravity double, own double, curvature double")
    return found.select("segment_index", F.coalesce(value, F.lit(0.0)).alias("value"))


def _mean(distance: Column, weight: Column) -> Column:
    return F.sum(distance * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def sdna_mean_distance(network: RoadNetwork, radius: float, weights: DataFrame | None = None) -> DataFrame:
    return _centre_fold(network, radius, "metric", _mean(F.col("distance"), F.col("weight")), weights, "not self")


def sdna_angular_mean_distance(network: RoadNetwork, radius: float, weights: DataFrame | None = None) -> DataFrame:
    """Mean of angular distances in degrees; the root itself counts with a third of its own curvature."""
    return _angular_fold(network, radius, "bend", (F.col("turned") + F.col("own") * F.col("curvature") / 3) / F.nullif("reach", F.lit(0.0)), weights)


def sdna_links(network: RoadNetwork, radius: float) -> DataFrame:
    return _centre_fold(network, radius, "metric", F.count(F.lit(1)).cast("double"))


def sdna_length(network: RoadNetwork, radius: float) -> DataFrame:
    return _centre_fold(network, radius, "metric", F.sum("length_m"))


def sdna_weight(network: RoadNetwork, radius: float, weights: DataFrame | None = None) -> DataFrame:
    return _centre_fold(network, radius, "metric", F.sum("weight"), weights)


def pst_reach(network: RoadNetwork, radius: float, weights: DataFrame | None = None, angular: bool = False) -> DataFrame:
    """Sum of weights within a metric radius, or an angular one in degrees."""
    if angular:
        return _angular_fold(network, radius, "turn", F.col("reach"), weights)
    return _centre_fold(network, radius, "metric", F.sum("weight"), weights)


def pst_gravity(network: RoadNetwork, radius: float, weights: DataFrame | None = None, beta: float = 1.0, self_distance: float = 1.0, angular: bool = False) -> DataFrame:
    """Sum of weight / distance ** beta; distance 0 counts as ``self_distance``."""
    if not (math.isfinite(beta) and beta >= 0):
        raise NetworkError("beta must be finite and non-negative.")
    if not (math.isfinite(self_distance) and self_distance > 0):
        raise NetworkError("self_distance must be finite and positive.")
    if angular:
        return _angular_fold(network, radius, "turn", F.col("gravity"), weights, float(beta), float(self_distance))
    distance = F.when(F.col("distance") == 0, F.lit(float(self_distance))).otherwise(F.col("distance"))
    return _centre_fold(network, radius, "metric", F.sum(F.col("weight") / F.power(distance, F.lit(float(beta)))), weights)


def pst_mean_distance(network: RoadNetwork, radius: float, weights: DataFrame | None = None, angular: bool = False) -> DataFrame:
    if angular:
        return _angular_fold(network, radius, "turn", F.col("turned") / F.nullif("reach", F.lit(0.0)), weights)
    return _centre_fold(network, radius, "metric", _mean(F.col("distance"), F.col("weight")), weights)


def _weight_list(network: RoadNetwork, weights: DataFrame | None):
    """Weights by segment index for kernels: None for ones; a broadcast mapping for a graph that is itself broadcast."""
    if weights is None:
        return None
    _ = network.graph  # raises for a graph too large to hold
    checked = weights_or_ones(network, weights).toArrow()
    return network.spark.sparkContext.broadcast(dict(zip(checked["segment_index"].to_pylist(), checked["weight"].to_pylist(), strict=True)))


def _weights_in(graph: k.StreetGraph, held) -> list[float]:
    return [1.0] * len(graph) if held is None else [held.value[i] for i in graph.index]


def _weighted_paths(network: RoadNetwork, radius: float, kind: str, origins: DataFrame | None, destinations: DataFrame | None, credits, factor: float) -> DataFrame:
    own, to = _weight_list(network, origins), _weight_list(network, destinations)

    def kernel(graph: k.StreetGraph, root: int):
        weight = _weights_in(graph, to)
        start = 1.0 if own is None else own.value[graph.index[root]]
        for s, credit in credits(k.centre_search(graph.centres(kind), root, radius), root, weight, start).items():
            yield 0, graph.index[s], credit

    return _summed(run(network, all_segments(network), kernel, _CREDITS, radius if kind == "metric" else INF), all_segments(network), "segment_index", factor)


def sdna_betweenness(network: RoadNetwork, radius: float, origins: DataFrame | None = None, destinations: DataFrame | None = None) -> DataFrame:
    """Weighted shares of shortest paths between other segments through each, halved."""
    return _weighted_paths(network, radius, "metric", origins, destinations, k.centre_credits, 0.5)


def sdna_angular_betweenness(network: RoadNetwork, radius: float, origins: DataFrame | None = None, destinations: DataFrame | None = None) -> DataFrame:
    """Weighted credits along one path of least angle for each ordered pair."""
    own, to = _weight_list(network, origins), _weight_list(network, destinations)
    order = network.graph.value["segment_index"].to_pylist()
    listed = [None if w is None else [w.value[i] for i in order] for w in (own, to)]
    return _summed(searches.credits(network, all_segments(network), radius, *listed), all_segments(network), "segment_index")


# Families with a kernel of their own

_TOTALS = "kind bigint, at bigint, n double, a double, b double, c double"


def _totals_and_credits(found: DataFrame, network: RoadNetwork, columns: dict[str, str], usable: bool) -> DataFrame:
    """Join the row of totals of each segment with the sum of its credits, to one row per segment."""
    totals = found.where("kind = 0").select(F.col("at").alias("segment_index"), *(F.col(c).alias(name) for c, name in columns.items()))
    credits = found.where("kind > 0").groupBy(F.col("at").alias("segment_index")).agg(F.sum("a").alias("choice"), F.sum("b").alias("trail"))
    out = network.segments.select("segment_index").join(totals, "segment_index", "left").join(credits, "segment_index", "left")
    there = F.col(next(iter(columns.values()))).isNotNull() if usable else F.lit(True)
    none = F.when(there, 0.0).otherwise(float("nan"))
    return out.withColumn("choice", F.coalesce("choice", none)).withColumn("trail", F.coalesce("trail", none))


def _only(network: RoadNetwork, segments: Iterable[int] | None) -> DataFrame:
    """Roots: all, or some. The filter stands before the kernel, since nothing can be pushed through it."""
    roots = all_segments(network)
    return roots if segments is None else roots.where(F.col("root").isin([int(s) for s in segments]))


def bucket_analysis(network: RoadNetwork, radius: float = INF, segments: Iterable[int] | None = None) -> DataFrame:
    """(segment_index, n, depth, choice, trail) of the metric bucket traversal."""

    def kernel(graph: k.StreetGraph, root: int):
        credits: dict[int, float] = {}
        count, total = k.bucket_search(graph, root, radius, credits)
        yield 0, graph.index[root], float(count), total, 0.0, 0.0
        for s, credit in credits.items():
            yield 1, graph.index[s], 0.0, credit, 0.0, 0.0

    found = run(network, _only(network, segments), kernel, _TOTALS, 2 * radius if radius > 0 else INF)
    return _totals_and_credits(found, network, {"n": "n", "a": "depth"}, usable=False)


def _nan(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(float("nan"))


def dmx_integration(network: RoadNetwork, radius: float = INF, segments: Iterable[int] | None = None) -> DataFrame:
    found = bucket_analysis(network, radius, segments)
    return found.select("segment_index", _nan((F.col("n") > 1) & (F.col("depth") > 0), (F.col("n") - 1) / F.nullif("depth", F.lit(0.0))).alias("value"))


def dmx_choice(network: RoadNetwork, radius: float = INF) -> DataFrame:
    return bucket_analysis(network, radius).select("segment_index", F.col("choice").alias("value"))


def angular_analysis(network: RoadNetwork, radius: float = INF, segments: Iterable[int] | None = None) -> DataFrame:
    """(segment_index, n, depth, choice, trail) over directed states; null totals and NaN credits where a segment has no usable ends."""

    def kernel(graph: k.StreetGraph, root: int):
        if not graph.usable(root):
            return
        found = k.angular_search(graph, root, radius)
        yield 0, graph.index[root], float(len(found.reached)), found.depth / ANGULAR_DEPTH_SCALE, 0.0, 0.0
        between: dict[int, float] = {}
        trail: dict[int, float] = {}
        k.between_credits(graph, found, root, between)
        k.trail_credits(found, root, trail)
        for s in between.keys() | trail.keys():
            yield 1, graph.index[s], 0.0, between.get(s, 0.0), trail.get(s, 0.0), 0.0

    found = run(network, _only(network, segments), kernel, _TOTALS, radius if radius > 0 else INF)
    return _totals_and_credits(found, network, {"n": "n", "a": "depth"}, usable=True)


def angular_integration(network: RoadNetwork, radius: float = INF, offset: float = 0.0, segments: Iterable[int] | None = None) -> DataFrame:
    """n ** 2 / (depth + offset); NaN for a lone segment, or without offset where the depth is 0."""
    found = angular_analysis(network, radius, segments)
    there = F.col("n") > 1
    if offset == 0:
        there &= F.col("depth") > 1e-9
    return found.select("segment_index", _nan(there, F.col("n") * F.col("n") / F.nullif(F.col("depth") + offset, F.lit(0.0))).alias("value"))


def angular_nain(network: RoadNetwork, radius: float = INF, segments: Iterable[int] | None = None) -> DataFrame:
    found = angular_analysis(network, radius, segments)
    return found.select("segment_index", _nan(F.col("n") > 1, F.power("n", F.lit(1.2)) / (F.col("depth") + 2)).alias("value"))


def angular_choice(network: RoadNetwork, radius: float = INF) -> DataFrame:
    """Segments strictly between, one path for each unordered pair."""
    return angular_analysis(network, radius).select("segment_index", F.col("choice").alias("value"))


def angular_trail_choice(network: RoadNetwork, radius: float = INF) -> DataFrame:
    """Choice by the back-paths of the leaves of each search, summed over both directions."""
    return angular_analysis(network, radius).select("segment_index", F.col("trail").alias("value"))


def angular_nach(network: RoadNetwork, radius: float = INF) -> DataFrame:
    found = angular_analysis(network, radius)
    return found.select("segment_index", _nan(F.col("n").isNotNull(), F.log(F.col("choice") + 1) / F.log(F.col("depth") + 3)).alias("value"))


def pst_analysis(network: RoadNetwork, radii: k.PstRadii | None = None, by_length: bool = False, threshold: float = 0.0, precision: float = 1.0) -> DataFrame:
    """(segment_index, n, depth, weight, weighted_depth, choice): depths in right angles."""
    if not precision > 0:
        raise NetworkError("anglePrecision must be positive.")
    bounds = radii or k.PstRadii()

    def kernel(graph: k.StreetGraph, root: int):
        count, depth, weight, weighted, credits = k.pst_search(graph, root, bounds, by_length, threshold, precision)
        yield 0, graph.index[root], float(count), depth / 90, weight, weighted / 90
        for s, credit in credits.items():
            yield 1, graph.index[s], 0.0, credit, 0.0, 0.0

    found = run(network, all_segments(network), kernel, _TOTALS, bounds.walking)
    return _totals_and_credits(found, network, {"n": "n", "a": "depth", "b": "weight", "c": "weighted_depth"}, usable=False).drop("trail")


_PST = {
    "node_count": "n",
    "total_depth": "depth",
    "integration": "(n - 1) / (depth + 1)",
    "syntax_integration": "power(n, 1.2D) / (depth + 1)",
    "hillier_integration": "n * n / (depth + 1)",
    "choice": "choice",
    "choice_normalized": "case when n > 2 then choice / ((n - 1) * (n - 2)) else choice end",
    "choice_syntax_normalized": "log10(choice + 1) / log10(depth + 2)",
}


def pst_angular(network: RoadNetwork, measure: str, radii: k.PstRadii | None = None, **options) -> DataFrame:
    """One of node_count, total_depth, integration, syntax_integration, hillier_integration, choice, choice_normalized, choice_syntax_normalized."""
    if measure not in _PST:
        raise NetworkError(f"Unknown measure: {measure}")
    return pst_analysis(network, radii, **options).select("segment_index", F.expr(_PST[measure]).alias("value"))


def pst_method(base: str, radii: k.PstRadii | None = None) -> str:
    labels = [f"{name}{radius_label(r)}" for name, r in zip(("s", "w", "a", "st"), (radii.straight, radii.walking, radii.angular, radii.steps), strict=True) if not math.isinf(r)] if radii else []
    return f"{base}_{'_'.join(labels) or 'rn'}"


def simplest_analysis(network: RoadNetwork, radius: float, tolerance: float = 0.0, unit: float = 180.0) -> DataFrame:
    """(segment_index, harmonic, choice): closeness and betweenness over routes of least angular cost within a metric radius."""
    if not (math.isfinite(unit) and unit > 0):
        raise NetworkError("angularScalingUnit must be positive.")

    def kernel(graph: k.StreetGraph, root: int):
        harmonic, credits = k.simplest_search(graph, root, radius, tolerance, unit)
        yield 0, graph.index[root], harmonic, 0.0, 0.0, 0.0
        for s, credit in credits.items():
            yield 1, graph.index[s], 0.0, credit, 0.0, 0.0

    found = run(network, all_segments(network), kernel, _TOTALS, radius)
    return _totals_and_credits(found, network, {"n": "harmonic"}, usable=False).drop("trail")


def cityseer_harmonic(network: RoadNetwork, radius: float, unit: float = 180.0, tolerance: float = 0.0) -> DataFrame:
    return simplest_analysis(network, radius, tolerance, unit).select("segment_index", F.col("harmonic").alias("value"))


def cityseer_betweenness(network: RoadNetwork, radius: float, tolerance: float = 0.0) -> DataFrame:
    return simplest_analysis(network, radius, tolerance).select("segment_index", F.col("choice").alias("value"))
