"""Edges between nodes and between segments: projections of one self-join of incidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.plans.network import RoadNetwork


def node_ids(network: RoadNetwork) -> DataFrame:
    """(node) every end of a segment, once."""
    return network.segments.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct()


def node_index(network: RoadNetwork) -> DataFrame:
    """(node, node_index) nodes numbered from 0 by id."""
    from roadloom.plans.network import with_index

    return with_index(node_ids(network), "node", name="node_index")


def primal_edges(network: RoadNetwork) -> DataFrame:
    """(from_node, to_node, segment_index, segment_id, weight) both ways, weighted by length."""
    s = network.segments
    there = s.select(F.col("source").alias("from_node"), F.col("target").alias("to_node"), "segment_index", "segment_id", F.col("length_m").alias("weight"))
    back = s.select(F.col("target").alias("from_node"), F.col("source").alias("to_node"), "segment_index", "segment_id", F.col("length_m").alias("weight"))
    return there.unionAll(back)


def incidences(network: RoadNetwork) -> DataFrame:
    """(node, segment_index, end, ...) with end 0 at the source; the point here and the far point of the segment."""
    e = network.ends
    first = e.select(F.col("source").alias("node"), "segment_index", F.lit(0).alias("end"), "length_m", "curvature", F.col("ax").alias("hx"), F.col("ay").alias("hy"), F.col("bx").alias("fx"), F.col("by").alias("fy"))
    last = e.select(F.col("target").alias("node"), "segment_index", F.lit(1).alias("end"), "length_m", "curvature", F.col("bx").alias("hx"), F.col("by").alias("hy"), F.col("ax").alias("fx"), F.col("ay").alias("fy"))
    return first.unionAll(last)


def pairs(network: RoadNetwork) -> DataFrame:
    """Every ordered pair of different segments at a node: structs a and b of incidences."""
    i = incidences(network)
    fields = F.struct(*i.columns[1:])
    a, b = i.select("node", fields.alias("a")), i.select("node", fields.alias("b"))
    return a.join(b, "node").where(F.col("a.segment_index") != F.col("b.segment_index"))


def turn_of_pair() -> Column:
    return g.turn("a.fx", "a.fy", "a.hx", "a.hy", "b.fx", "b.fy")


def _edges(network: RoadNetwork, weight: Column) -> DataFrame:
    return pairs(network).select(F.col("a.segment_index").alias("from_segment"), F.col("b.segment_index").alias("to_segment"), F.col("node").alias("via_node"), weight.alias("weight"))


def dual_edges(network: RoadNetwork) -> DataFrame:
    """Segments that share a node, weighted by the length of the second; once for each shared node."""
    return _edges(network, F.col("b.length_m"))


def centre_edges(network: RoadNetwork, kind: str = "metric") -> DataFrame:
    """Segments that share a node, weighted from centre to centre: metric, turn, or bend (turn with half of both curvatures)."""
    if kind == "metric":
        return _edges(network, (F.col("a.length_m") + F.col("b.length_m")) / 2)
    if kind == "turn":
        return _edges(network, turn_of_pair())
    return _edges(network, F.col("a.curvature") / 2 + turn_of_pair() + F.col("b.curvature") / 2)


def state_edges(network: RoadNetwork) -> DataFrame:
    """(from_state, to_state, turn_degrees, step_length): directed states 2 s (source to target) and 2 s + 1."""
    arriving = g.bearing("a.fx", "a.fy", "a.hx", "a.hy")
    leaving = g.bearing("b.hx", "b.hy", "b.fx", "b.fy")
    # A sum is finite only if all its terms are.
    usable = g.finite(sum((F.col(f"{side}.{c}") for side in "ab" for c in ("hx", "hy", "fx", "fy")), F.lit(0.0)))
    return (
        pairs(network)
        .where(usable & (F.col("a.length_m") > 0) & (F.col("b.length_m") > 0))
        .select(
            (2 * F.col("a.segment_index") + 1 - F.col("a.end")).alias("from_state"),
            (2 * F.col("b.segment_index") + F.col("b.end")).alias("to_state"),
            g.angle_between(arriving, leaving).alias("turn_degrees"),
            (F.col("a.length_m") / 2 + F.col("b.length_m") / 2).alias("step_length"),
        )
    )


def node_degree(network: RoadNetwork) -> DataFrame:
    """(node, value) ends of segments at each node."""
    ends = network.segments.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("value"))


def segment_degree(network: RoadNetwork) -> DataFrame:
    """(segment_index, value) different segments that touch each segment."""
    found = dual_edges(network).groupBy(F.col("from_segment").alias("segment_index")).agg(F.countDistinct("to_segment").alias("value"))
    return network.segments.select("segment_index").join(found, "segment_index", "left").select("segment_index", F.coalesce("value", F.lit(0)).alias("value"))


def line_curvature(network: RoadNetwork) -> DataFrame:
    """(segment_index, value) deflection within each line in degrees."""
    return network.ends.select("segment_index", F.col("curvature").alias("value"))
