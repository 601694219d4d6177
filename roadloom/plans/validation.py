"""Reports that compare computed columns with those of other programs."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.geometry import finite
from roadloom.operators import measures as m
from roadloom.plans.network import NetworkError, RoadNetwork, from_columns
from roadloom.sources import segment_csv


def pearson(a: str, b: str):
    """Correlation; NaN where a side doesn't vary."""
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.coalesce(F.covar_pop(a, b) / spread, F.lit(float("nan")))


def compare_columns(pairs: DataFrame) -> DataFrame:
    """One row of statistics over (row, reference, engine), where both are finite.

    count, pearson, spearman (ties share the mean of their ranks), mean, median and max absolute
    difference, exact matches, and the overlap of the top tenths (ties by row).
    """
    p = pairs.where(finite("reference") & finite("engine"))
    # Ranks need the whole order: counts of distinct values are summed over it, ties then share (first + last) / 2.
    ranked = p
    for c in ("reference", "engine"):
        sizes = p.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        through = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranks = sizes.select(F.col("v").alias(c), (through - (F.col("n") - 1) / 2).alias(f"{c}_rank"))
        ranked = ranked.join(ranks, c)
        ranked = ranked.withColumn(f"{c}_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c), "row")))
    total = p.agg(F.count(F.lit(1)).alias("total"))
    top = F.greatest(F.lit(1), F.ceil(F.col("total") * 0.1))
    ranked = ranked.join(F.broadcast(total)).withColumn("top", top)
    difference = F.abs(F.col("reference") - F.col("engine"))
    both = ((F.col("reference_place") <= F.col("top")) & (F.col("engine_place") <= F.col("top"))).cast("int")
    return ranked.agg(
        F.count(F.lit(1)).alias("count"),
        pearson("reference", "engine").alias("pearson"),
        pearson("reference_rank", "engine_rank").alias("spearman"),
        F.avg(difference).alias("mean_absolute_difference"),
        F.percentile(difference, 0.5).alias("median_absolute_difference"),
        F.max(difference).alias("max_absolute_difference"),
        F.sum((difference == 0).cast("int")).cast("bigint").alias("exact_matches"),
        (F.sum(both) / F.max("top")).alias("top_decile_overlap"),
    )


def _compared(rows: DataFrame, column: str, engine: DataFrame) -> dict:
    reference = rows.select(F.col("segment_index").alias("row"), F.expr(f"try_cast(`{column}` as double)").alias("reference"))
    if reference.where(~finite("reference")).limit(1).count():
        raise NetworkError(f"Invalid numeric value in column {column}")
    found = compare_columns(reference.join(engine.select(F.col("segment_index").alias("row"), F.col("value").alias("engine")), "row")).first().asDict()
    if not found["count"]:
        raise NetworkError(f"No comparable finite values for {column}.")
    return {"reference_column": column} | {key: math.nan if value is None else value for key, value in found.items()}


def _radius_of(*columns: str) -> float | str:
    found = {float(r[1]) if (r := re.search(r" R(\d+(?:\.\d+)?) metric(?:$| )", c)) else "n" for c in columns}
    return found.pop() if len(found) == 1 else "unknown"


def _same(reference: float | str, radius: float) -> bool:
    if reference == "unknown":
        return True
    return math.isinf(radius) if reference == "n" else math.isfinite(radius) and abs(reference - radius) < 1e-9


def _report(network: RoadNetwork, radius: float, reference: float | str, comparisons: dict, notes: list[str]) -> dict:
    if not _same(reference, radius):
        notes.append(f"The reference columns are for radius {reference}, the comparison for {m.radius_label(radius)}.")
    nodes = network.segments.select(F.explode(F.array("source", "target"))).distinct().count()
    fixture = {"feature_count": network.size[0], "node_count": nodes, "engine_radius": radius if math.isfinite(radius) else "n", "reference_radius": reference}
    return {"fixture": fixture, "comparisons": comparisons, "status": "review" if notes else "pass", "notes": notes}


def _find(rows: DataFrame, pattern: str, needed: bool = True) -> str | None:
    found = next((c for c in rows.columns if re.match(pattern, c)), None)
    if found is None and needed:
        raise NetworkError(f"Missing column matching {pattern}.")
    return found


def validate_metric_csv(spark: SparkSession, path: str, radius: float = math.inf, mean_depth_column: str | None = None, choice_column: str | None = None) -> dict:
    """Compare metric mean depth (the reciprocal of integration) and choice with a segment export; passes without notes."""
    rows = segment_csv.read_rows(spark, path).cache()
    network = segment_csv.network_of(rows)
    depth_column = mean_depth_column or _find(rows, r"Metric Mean Depth(?: |$)")
    choice_column = choice_column or _find(rows, r"Metric Choice(?: |$)")
    found = m.bucket_analysis(network, radius).cache()
    n, depth = F.col("n"), F.col("depth")
    mean_depth = found.select("segment_index", F.when((n > 1) & (depth > 0), depth / (n - 1)).otherwise(float("nan")).alias("value"))
    comparisons = {"metric_mean_depth": _compared(rows, depth_column, mean_depth), "metric_choice": _compared(rows, choice_column, found.select("segment_index", F.col("choice").alias("value")))}
    notes = []
    if comparisons["metric_mean_depth"]["pearson"] < 0.999 or comparisons["metric_choice"]["pearson"] < 0.99:
        notes.append("Correlation is below the compatibility threshold.")
    if comparisons["metric_choice"]["max_absolute_difference"] > 0:
        notes.append("Choice does not match row by row.")
    return _report(network, radius, _radius_of(depth_column, choice_column), comparisons, notes)


def validate_angular_csv(spark: SparkSession, path: str, radius: float = math.inf, mean_depth_column: str | None = None, integration_column: str | None = None, choice_column: str | None = None) -> dict:
    """Compare angular mean depth, binned integration and binned choice with those of a segment export that are there."""
    rows = segment_csv.read_rows(spark, path).cache()
    network = segment_csv.network_of(rows)
    depth_column = mean_depth_column or _find(rows, r"Angular Mean Depth(?: |$)", False)
    integration_column = integration_column or _find(rows, r"T\d+ Integration(?: |$)", False)
    choice_column = choice_column or _find(rows, r"T\d+ Choice(?: |$)", False)
    wanted = [c for c in (depth_column, integration_column, choice_column) if c]
    if not wanted:
        raise NetworkError("The CSV must have angular mean depth, or binned integration or choice.")
    found = m.angular_analysis(network, radius).cache()
    n, depth, size = F.col("n"), F.col("depth"), network.size[0]
    integration = F.when((n > 1) & (depth > 1e-9), n * n / F.nullif("depth", F.lit(0.0)))
    comparisons = {}
    if depth_column:
        mean_depth = float(size * size) / integration / max(1, size - 1)
        comparisons["angular_mean_depth"] = _compared(rows, depth_column, found.select("segment_index", mean_depth.alias("value")))
    if integration_column:
        comparisons["binned_integration"] = _compared(rows, integration_column, found.select("segment_index", integration.alias("value")))
    if choice_column:
        comparisons["binned_choice"] = _compared(rows, choice_column, found.select("segment_index", F.col("trail").alias("value")))
    notes = []
    for name, c in comparisons.items():
        if c["exact_matches"] != c["count"] and not (c["pearson"] >= 0.99 and c["spearman"] >= 0.99):
            notes.append(f"{name}: correlation is below the compatibility threshold.")
    if choice_column and comparisons["binned_choice"]["exact_matches"] != comparisons["binned_choice"]["count"]:
        notes.append("Binned choice does not match row by row.")
    return _report(network, radius, _radius_of(*wanted), comparisons, notes)


# Fixed values of a published fixture: a rhombus of four nodes and node harmonic closeness at three radii.
DIAMOND_NODES = ((0.0, -86.60254), (-50.0, 0.0), (50.0, 0.0), (0.0, 86.60254))
DIAMOND_EDGES = ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3))
DIAMOND_HARMONIC = {50: (0.0, 0.0, 0.0, 0.0), 150: (0.02, 0.03, 0.03, 0.02), 250: (0.025, 0.03, 0.03, 0.025)}


def diamond_network(spark: SparkSession) -> RoadNetwork:
    ends = [(DIAMOND_NODES[a], DIAMOND_NODES[b]) for a, b in DIAMOND_EDGES]
    return from_columns(
        spark, [a for a, _ in DIAMOND_EDGES], [b for _, b in DIAMOND_EDGES], [math.dist(a, b) for a, b in ends], [a[0] for a, _ in ends], [a[1] for a, _ in ends], [b[0] for _, b in ends], [b[1] for _, b in ends]
    )


def validate_diamond(spark: SparkSession, tolerance: float = 1e-7) -> dict:
    """Node harmonic closeness and its mean over segment ends against the fixture."""
    network, comparisons = diamond_network(spark), []
    for radius, expected in DIAMOND_HARMONIC.items():
        nodes = [r["value"] for r in m.harmonic_closeness(network, radius).orderBy("node").collect()]
        segments = [r["value"] for r in m.primal_integration(network, radius).orderBy("segment_index").collect()]
        projected = [(expected[a] + expected[b]) / 2 for a, b in DIAMOND_EDGES]
        comparisons.append({"radius": radius, "nodes": nodes, "segments": segments, "node_difference": max(abs(x - y) for x, y in zip(nodes, expected, strict=True)), "segment_difference": max(abs(x - y) for x, y in zip(segments, projected, strict=True))})
    good = all(max(c["node_difference"], c["segment_difference"]) <= tolerance for c in comparisons)
    return {"fixture": "diamond", "comparisons": comparisons, "status": "pass" if good else "review"}
