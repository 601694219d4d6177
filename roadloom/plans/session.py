"""A session that holds one network and answers requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roadloom.operators.routes import shortest_route
from roadloom.plans.catalog import column_name, compute_column, on_demand_value
from roadloom.plans.network import NetworkError, RoadNetwork, from_columns
from roadloom.plans.rowhash import row_hash


class RoadNetworkSession:
    """Requests are dictionaries with ``type``: init, fullmap, ondemand or route; replies too. Whatever fails is a reply of type error."""

    def __init__(self, spark: SparkSession, network: RoadNetwork | None = None):
        self.spark, self.network = spark, network

    def handle(self, request: dict, progress: Callable[[dict], None] | None = None) -> dict:
        try:
            kind = request.get("type")
            if kind == "init":
                return self._init(request)
            if kind not in ("fullmap", "ondemand", "route"):
                raise NetworkError(f"Unknown message type: {kind}")
            if self.network is None:
                raise NetworkError("The engine has not been initialized.")
            return getattr(self, f"_{kind}")(request, progress or (lambda _: None))
        except Exception as error:  # noqa: BLE001  the boundary of the session
            return {"type": "error", "id": request.get("id"), "message": str(error).splitlines()[0] if str(error) else repr(error)}

    def _init(self, request: dict) -> dict:
        if "network" in request:
            self.network = request["network"]
        else:
            self.network = from_columns(self.spark, *(request[c] for c in ("source", "target", "length")), *(request.get(c) for c in ("x0", "y0", "x1", "y1")))
        return {"type": "ready", "id": request.get("id"), "row_hash": row_hash(self.network), "feature_count": self.network.size[0]}

    def _fullmap(self, request: dict, progress: Callable[[dict], None]) -> dict:
        """Progress is started, running after each tenth of the partitions of the result, completed."""
        method, measure, radius = request["method"], request["measure"], request.get("radius")
        total = self.network.size[0]
        step = {"type": "progress", "id": request.get("id"), "column": column_name(method, measure, radius), "total": total}
        progress(step | {"phase": "started", "done": 0})
        result = compute_column(self.network, method, measure, radius)
        values, tick = [], max(1, total // 10)
        for row in result.values.orderBy("segment_index").toLocalIterator():
            values.append(row["value"])
            if len(values) % tick == 0 and len(values) < total:
                progress(step | {"phase": "running", "done": len(values)})
        if len(values) != total:
            raise NetworkError(f"{len(values)} values for {total} segments.")
        progress(step | {"phase": "completed", "done": total})
        return {"type": "fullmap", "id": request.get("id"), "column": result.column, "values": values, "row_hash": result.row_hash, "feature_count": result.feature_count, "status": result.status}

    def _ondemand(self, request: dict, progress: Callable[[dict], None]) -> dict:
        value = on_demand_value(self.network, request["method"], request["measure"], request["segment_index"], request.get("radius"))
        return {"type": "ondemand", "id": request.get("id"), "segment_index": request["segment_index"], "column": column_name(request["method"], request["measure"], request.get("radius")), "value": value}

    def _route(self, request: dict, progress: Callable[[dict], None]) -> dict:
        found = shortest_route(self.network, request["mode"], request["from_segment"], request["to_segment"])
        if found is None:
            raise NetworkError("No route found.")
        return {"type": "route", "id": request.get("id"), "mode": request["mode"], **found}

    def register_views(self, prefix: str = "road") -> None:
        """SQL on top: the segments and both edge tables as temporary views."""
        from roadloom.operators.topology import dual_edges, primal_edges

        if self.network is None:
            raise NetworkError("The engine has not been initialized.")
        for name, df in (("segments", self.network.segments), ("primal_edges", primal_edges(self.network)), ("dual_edges", dual_edges(self.network))):
            df.select(*(F.col(c) for c in df.columns)).createOrReplaceTempView(f"{prefix}_{name}")
