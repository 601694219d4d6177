"""Distances from many roots, as long tables; unreachable is absent."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators import kernels as k
from roadloom.operators.topology import centre_edges, primal_edges
from roadloom.plans.network import NetworkError, RoadNetwork, build_graph
from roadloom.plans.scratch import cut
from roadloom.schema import BROADCAST_SEGMENTS

_built: list[tuple[pa.Table, k.StreetGraph]] = []


def _graph_of(held) -> k.StreetGraph:
    """The graph of a broadcast table; a worker builds it once."""
    table = held.value
    if not _built or _built[0][0] is not table:
        _built[:] = [(table, build_graph(table))]
    return _built[0][1]


Kernel = Callable[[k.StreetGraph, int], Iterable[tuple]]


def run(network: RoadNetwork, roots: DataFrame, kernel: Kernel, schema: str, radius: float = math.inf, by_node: bool = False) -> DataFrame:
    """Rows of ``kernel(graph, root)`` for every root in the column ``root``.

    Roots are segment indexes (the kernel gets positions and gives positions back through
    ``graph.index``), or nodes. A graph of up to BROADCAST_SEGMENTS segments is broadcast whole and
    the roots are dealt to all cores. A larger one is cut into square tiles: each task gets the
    segments of a tile and, around it, as far as a way within the finite metric ``radius`` can lead.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.float64() if c.split()[1] == "double" else pa.int64() for c in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def rows_of(graph: k.StreetGraph, wanted: list[int]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for root in wanted:
            at = root if by_node else graph.position.get(root)
            if at is not None:
                out.extend(kernel(graph, at))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    count, longest, ratio = network.size
    if count <= BROADCAST_SEGMENTS:
        held = network.graph

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = _graph_of(held)
            for batch in batches:
                yield from rows_of(graph, batch.column(0).to_pylist())

        spread = max(1, min(count // 32, 4 * network.spark.sparkContext.defaultParallelism))
        return roots.select(F.col("root").cast("bigint")).repartition(spread, "root").mapInArrow(scan, schema)
    if not math.isfinite(radius) or radius <= 0:
        raise NetworkError(f"Over {BROADCAST_SEGMENTS} segments need a finite radius.")
    return _tiled(network, roots, rows_of, schema, radius * max(1.0, ratio) + 2 * longest * max(1.0, ratio), longest, by_node)


def _tiled(network: RoadNetwork, roots: DataFrame, rows_of, schema: str, halo: float, longest: float, by_node: bool) -> DataFrame:
    side = 2 * halo
    ends = network.ends
    x, y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    tile = lambda v: F.floor(v / side)
    spread = ends.withColumn("tx", F.explode(F.sequence(tile(x - halo), tile(x + halo)))).withColumn("ty", F.explode(F.sequence(tile(y - halo), tile(y + halo))))
    if by_node:
        home = ends.select(F.explode(F.array(F.struct(F.col("source").alias("root"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("target").alias("root"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("e.*")
        home = home.groupBy("root").agg(F.min(F.struct("x", "y")).alias("p")).select("root", tile(F.col("p.x")).alias("tx"), tile(F.col("p.y")).alias("ty"))
    else:
        home = ends.select(F.col("segment_index").alias("root"), tile(x).alias("tx"), tile(y).alias("ty"))
    home = home.join(roots.select(F.col("root").cast("bigint")), "root")

    def scan(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        graph = build_graph(left.sort_by("segment_index"), longest)
        return pa.Table.from_batches(rows_of(graph, sorted(right.column("root").to_pylist())))

    return spread.groupBy("tx", "ty").cogroup(home.groupBy("tx", "ty")).applyInArrow(scan, schema)


def all_nodes(network: RoadNetwork) -> DataFrame:
    return network.segments.select(F.explode(F.array("source", "target")).alias("root")).distinct()


def all_segments(network: RoadNetwork) -> DataFrame:
    return network.segments.select(F.col("segment_index").alias("root"))


def node_distances(network: RoadNetwork, radius: float = math.inf, mode: str = "metric", roots: DataFrame | None = None) -> DataFrame:
    """(root, node, distance) of every node within the radius (inclusive); topological distances are numbers of segments and round the radius up."""
    hops = mode == "topological"
    bound = math.ceil(radius) if hops and math.isfinite(radius) else radius
    longest = network.size[1]

    def kernel(graph: k.StreetGraph, root: int):
        for node, d in k.node_distances(graph, root, bound, hops).items():
            yield root, node, d

    return run(network, roots if roots is not None else all_nodes(network), kernel, "root bigint, node bigint, distance double", bound * longest if hops else bound, by_node=True)


def centre_distances(network: RoadNetwork, radius: float = math.inf, kind: str = "metric", roots: DataFrame | None = None) -> DataFrame:
    """(root, segment_index, distance) from segment centre to centre within the radius (inclusive), the root itself at 0."""

    def kernel(graph: k.StreetGraph, root: int):
        found = k.centre_search(graph.centres(kind), root, radius)
        for s in found.order:
            yield graph.index[root], graph.index[s], found.distance[s]

    return run(network, roots if roots is not None else all_segments(network), kernel, "root bigint, segment_index bigint, distance double", radius if kind == "metric" else math.inf)


def dijkstra(network: RoadNetwork, source: int, radius: float = math.inf, weight: Column | None = None) -> DataFrame:
    """(node, distance, predecessor) from one node, by length or another column of the segments; an unknown node reaches nothing. Negative weights are refused."""
    if weight is not None:
        network = RoadNetwork(network.segments.withColumn("length_m", weight.cast("double")))
    if network.segments.where("length_m is null or length_m < 0 or isnan(length_m)").limit(1).count():
        raise NetworkError("Edge weights must be non-negative and finite.")
    known = all_nodes(network).where(F.col("root") == source)

    def kernel(graph: k.StreetGraph, root: int):
        yield from k.node_tree(graph, root, radius)

    return run(network, known, kernel, "node bigint, distance double, predecessor bigint", radius, by_node=True)


def breadth_first(network: RoadNetwork, source: int, radius: float = math.inf) -> DataFrame:
    """(node, distance) in segments from one node; a fractional radius reaches its ceiling."""
    return node_distances(network, radius, "topological", all_nodes(network).where(F.col("root") == source)).select("node", "distance")


def reconstruct_path(tree: DataFrame, target: int) -> list[int]:
    """Nodes from the source to ``target`` by the predecessors of ``dijkstra``; empty if unreachable. Only the path's own rows leave the cluster, a step each."""
    held = tree.select("node", "predecessor").cache()
    path, at = [], target
    while at is not None:
        row = held.where(F.col("node") == at).first()
        if row is None:
            return []
        path.append(at)
        at = row["predecessor"]
    return path[::-1]


def relaxed_distances(edges: DataFrame, roots: DataFrame, radius: float = math.inf, max_rounds: int = 10_000) -> DataFrame:
    """(root, node, distance) by rounds of joins over (from_node, to_node, weight): for graphs that fit no executor.

    The rows improved in a round are the frontier of the next; no row is visited by a driver loop.
    """
    best = cut(roots.select("root", F.col("root").alias("node"), F.lit(0.0).alias("distance")))
    frontier = best
    for _ in range(max_rounds):
        reach = frontier.join(edges, frontier["node"] == edges["from_node"]).select("root", F.col("to_node").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        reach = reach.where(F.col("distance") <= radius).groupBy("root", "node").agg(F.min("distance").alias("distance"))
        old = best.withColumnRenamed("distance", "old")
        frontier = cut(reach.join(old, ["root", "node"], "left").where("old is null or distance < old").select("root", "node", "distance"))
        if not frontier.limit(1).count():
            return best
        best = cut(best.unionByName(frontier).groupBy("root", "node").agg(F.min("distance").alias("distance")))
    raise NetworkError("The search did not end.")


def relaxed_node_distances(network: RoadNetwork, radius: float = math.inf, roots: DataFrame | None = None) -> DataFrame:
    return relaxed_distances(primal_edges(network).select("from_node", "to_node", "weight"), roots if roots is not None else all_nodes(network), radius)


def relaxed_centre_distances(network: RoadNetwork, radius: float = math.inf, kind: str = "metric") -> DataFrame:
    edges = centre_edges(network, kind).select(F.col("from_segment").alias("from_node"), F.col("to_segment").alias("to_node"), "weight")
    return relaxed_distances(edges, all_segments(network), radius).withColumnRenamed("node", "segment_index")


def node_components(network: RoadNetwork) -> DataFrame:
    """(node, value) connected components, numbered from 0 in order of their smallest node: smallest labels spread with pointer jumping."""
    edges = primal_edges(network).select("from_node", "to_node").distinct()
    labels = cut(all_nodes(network).select(F.col("root").alias("node"), F.col("root").alias("label")))
    while True:
        near = edges.join(labels, edges["to_node"] == labels["node"]).groupBy("from_node").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["from_node"], "left").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = cut(low.join(up, "low", "left").select("node", F.least("low", "jump").alias("new"), "label"))
        moved = new.where("new != label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            break
    order = labels.select("label").distinct()
    from roadloom.plans.network import with_index

    return labels.join(with_index(order, "label", name="value"), "label").select("node", "value")


def segment_components(network: RoadNetwork) -> DataFrame:
    """(segment_index, value) the component of each segment's source."""
    nodes = node_components(network)
    return network.segments.join(nodes, network.segments["source"] == nodes["node"]).select("segment_index", "value")
