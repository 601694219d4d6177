"""The grammar of column names, ``<method>_<measure>_r<radius>``, and the catalog of what it can name."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import kernels as k
from roadloom.operators import measures as m
from roadloom.plans.network import NetworkError, RoadNetwork
from roadloom.plans.rowhash import row_hash
from roadloom.schema import RADII

# Fixed values of the column grammar.
FAMILIES = {"dmx": "DepthmapX-style metric", "dmx_angular": "DepthmapX-style angular", "pst_angular": "PST-style angular", "angular": "Canonical engine angular"}
LABELS = {
    ("dmx", "integration"): "Metric integration",
    ("dmx", "choice"): "Metric choice",
    ("dmx_angular", "integration"): "Angular integration",
    ("dmx_angular", "choice"): "Angular choice",
    ("pst_angular", "integration"): "AngularIntegration",
    ("pst_angular", "choice"): "AngularChoice",
    ("angular", "integration"): "Angular integration",
    ("angular", "nain"): "NAIN",
    ("angular", "choice"): "Canonical angular choice",
    ("angular", "nach"): "NACH",
}
ON_DEMAND = {("dmx", "integration"), ("dmx_angular", "integration"), ("angular", "integration"), ("angular", "nain")}

_COLUMN = re.compile(rf"({'|'.join(sorted(FAMILIES, key=len, reverse=True))})_(integration|nain|choice|nach)_r(\d+)")


@dataclass(frozen=True)
class AnalysisColumn:
    method: str
    measure: str
    radius: int

    @property
    def name(self) -> str:
        return column_name(self.method, self.measure, self.radius)


def column_name(method: str, measure: str, radius: float | None = None) -> str:
    return f"{method}_{measure}" if radius is None else f"{method}_{measure}_r{radius:g}"


def supports(method: str, measure: str, radius: float | None = None) -> bool:
    return (method, measure) in LABELS and (radius is None or radius in RADII)


def supports_on_demand(method: str, measure: str) -> bool:
    return (method, measure) in ON_DEMAND


def parse_column(name: str) -> AnalysisColumn | None:
    found = _COLUMN.fullmatch(name)
    if not found or not supports(found[1], found[2], int(found[3])):
        return None
    return AnalysisColumn(found[1], found[2], int(found[3]))


def allowed_columns() -> list[str]:
    return [column_name(method, measure, r) for r in RADII for method, measure in LABELS]


def display_name(method: str, measure: str, radius: float | None = None) -> str:
    text = f"{FAMILIES.get(method, method)} - {LABELS.get((method, measure), measure.replace('_', ' '))}"
    return text if radius is None else f"{text} R{radius:g}"


def method_catalog(spark: SparkSession, radii: tuple[int, ...] = RADII) -> DataFrame:
    """One row per column: method, measure, radius, column, family_label, measure_label, display_name, status, scope, on_demand."""
    kinds = [(method, measure, FAMILIES[method], label, "compatible", "segment", (method, measure) in ON_DEMAND) for (method, measure), label in LABELS.items()]
    kinds = spark.createDataFrame(kinds, "method string, measure string, family_label string, measure_label string, status string, scope string, on_demand boolean")
    steps = spark.createDataFrame([(int(r),) for r in radii], "radius bigint")
    radius = F.col("radius").cast("string")
    # Ten methods by a list of radii: both are small constants.
    return kinds.join(F.broadcast(steps)).select(
        "method", "measure", "radius", F.concat("method", F.lit("_"), "measure", F.lit("_r"), radius).alias("column"), "family_label", "measure_label",
        F.concat("family_label", F.lit(" - "), "measure_label", F.lit(" R"), radius).alias("display_name"), "status", "scope", "on_demand",
    )


@dataclass
class ColumnResult:
    column: str
    values: DataFrame  # segment_index, value float
    row_hash: str
    feature_count: int
    method: str
    status: str = "compatible"


def _values(network: RoadNetwork, method: str, measure: str, radius: float) -> DataFrame:
    if method == "dmx":
        return m.dmx_choice(network, radius) if measure == "choice" else m.dmx_integration(network, radius)
    if method == "dmx_angular":
        return m.angular_trail_choice(network, radius) if measure == "choice" else m.angular_integration(network, radius, 0)
    if method == "pst_angular":  # the radius bounds the walk; angles stay unbounded
        return m.pst_angular(network, measure, k.PstRadii(walking=radius))
    return {"integration": lambda: m.angular_integration(network, radius, 1), "nain": lambda: m.angular_nain(network, radius), "choice": lambda: m.angular_choice(network, radius), "nach": lambda: m.angular_nach(network, radius)}[measure]()


def compute_column(network: RoadNetwork, method: str, measure: str, radius: float | None = None) -> ColumnResult:
    """One analysis column in single precision, aligned to the segments."""
    if radius is None or not supports(method, measure, radius):
        raise NetworkError(f"Unsupported analysis column: {column_name(method, measure, radius)}")
    values = _values(network, method, measure, float(radius)).select("segment_index", F.col("value").cast("float").alias("value"))
    return ColumnResult(column_name(method, measure, radius), values, row_hash(network), network.size[0], column_name(method, measure, radius))


def compute_column_by_name(network: RoadNetwork, name: str) -> ColumnResult:
    parsed = parse_column(name)
    if parsed is None:
        raise NetworkError(f"Unsupported analysis column: {name}")
    return compute_column(network, parsed.method, parsed.measure, parsed.radius)


def compute_columns(network: RoadNetwork, names: list[str]) -> DataFrame:
    """Several columns side by side; those of one family and radius share a pass of its kernel."""
    out = network.segments.select("segment_index")
    passes: dict[tuple, list[AnalysisColumn]] = {}
    for name in names:
        parsed = parse_column(name)
        if parsed is None:
            raise NetworkError(f"Unsupported analysis column: {name}")
        passes.setdefault(("angular" if "angular" in parsed.method and parsed.method != "pst_angular" else parsed.method, parsed.radius), []).append(parsed)
    n, depth = F.col("n"), F.col("depth")
    nan = float("nan")
    formulas = {
        ("dmx", "integration"): F.when((n > 1) & (depth > 0), (n - 1) / F.nullif("depth", F.lit(0.0))).otherwise(nan),
        ("dmx", "choice"): F.col("choice"),
        ("dmx_angular", "integration"): F.when((n > 1) & (depth > 1e-9), n * n / F.nullif("depth", F.lit(0.0))).otherwise(nan),
        ("dmx_angular", "choice"): F.col("trail"),
        ("angular", "integration"): F.when(n > 1, n * n / (depth + 1)).otherwise(nan),
        ("angular", "nain"): F.when(n > 1, F.power(n, F.lit(1.2)) / (depth + 2)).otherwise(nan),
        ("angular", "choice"): F.col("choice"),
        ("angular", "nach"): F.when(n.isNotNull(), F.log(F.col("choice") + 1) / F.log(depth + 3)).otherwise(nan),
        ("pst_angular", "integration"): (n - 1) / (depth + 1),
        ("pst_angular", "choice"): F.col("choice"),
    }
    for (family, radius), wanted in passes.items():
        found = {"dmx": m.bucket_analysis, "angular": m.angular_analysis}[family](network, float(radius)) if family != "pst_angular" else m.pst_analysis(network, k.PstRadii(walking=float(radius)))
        out = out.join(found.select("segment_index", *(formulas[c.method, c.measure].cast("float").alias(c.name) for c in wanted)), "segment_index")
    return out


def on_demand_value(network: RoadNetwork, method: str, measure: str, segment: int, radius: float | None = None) -> float:
    """The value of one segment in double precision, by one search."""
    if not supports_on_demand(method, measure):
        raise NetworkError(f"Unsupported on-demand analysis: {column_name(method, measure, radius)}")
    if radius is None:
        raise NetworkError("On-demand analysis requires a radius.")
    if method == "dmx":
        found = m.dmx_integration(network, radius, [segment])
    elif measure == "nain":
        found = m.angular_nain(network, radius, [segment])
    else:
        found = m.angular_integration(network, radius, 1.0 if method == "angular" else 0.0, [segment])
    row = found.where(F.col("segment_index") == segment).first()
    return math.nan if row is None else row["value"]
