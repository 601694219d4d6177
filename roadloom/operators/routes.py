"""Shortest routes between segments, for tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadloom.operators import searches
from roadloom.plans.network import NetworkError, RoadNetwork

MODES = ("metric", "angular", "vectorAngle", "vectorMetric")


def routes(network: RoadNetwork, requests: DataFrame, mode: str | None = None) -> DataFrame:
    """One row for each request (from_segment, to_segment[, mode]): the route's segments in order and its three costs.

    A cost that the mode doesn't have is NaN. Where there is no route, or an end is out of range or has
    no usable geometry, ``found`` is false and the rest null.
    """
    if mode is not None and mode not in MODES:
        raise NetworkError(f"Unknown route mode: {mode}")
    wanted = requests.selectExpr("cast(from_segment as bigint)", "cast(to_segment as bigint)", *(["mode"] if mode is None else []))
    return searches.routes(network, wanted, mode)


def shortest_route(network: RoadNetwork, mode: str, start: int, goal: int) -> dict | None:
    """One route, or None."""
    request = network.spark.createDataFrame([(start, goal)], "from_segment bigint, to_segment bigint")
    row = routes(network, request, mode).collect()[0]
    return {name: row[name] for name in ("segment_indexes", "distance_m", "angular_cost", "vector_cost")} if row["found"] else None
