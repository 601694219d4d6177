"""Route requests as a stream: each micro-batch is answered over the held network."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadloom.operators.routes import routes
from roadloom.plans.network import RoadNetwork


def route_stream(network: RoadNetwork, requests: DataFrame, path: str, checkpoint: str):
    """Start a query that appends the routes of a stream of (from_segment, to_segment, mode) to a Parquet folder, exactly once."""
    return routes(network, requests).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
