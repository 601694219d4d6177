"""Segment tables in CSV as axial analysis programs export them: ends, lengths and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.plans.network import RoadNetwork, with_index
from roadloom.schema import SEGMENTS


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with trimmed names, numbered in the order of the file."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    filled = F.concat_ws("", *(F.trim(f"`{c}`") for c in rows.columns)) != ""
    return with_index(rows.where(filled).withColumn("_order", F.monotonically_increasing_id()), "_order").drop("_order")


def network_of(rows: DataFrame) -> RoadNetwork:
    """The network of rows with x1, y1, x2, y2 and ``Segment Length``; ends with the same numbers are one node."""
    n = rows.select("segment_index", *(F.expr(f"try_cast(`{c}` as double)").alias(a) for c, a in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by"), ("Segment Length", "length_m"))))
    ends = n.select(F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), (2 * F.col("segment_index")).alias("seen")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), (2 * F.col("segment_index") + 1).alias("seen")))).alias("e")).select("e.*")
    nodes = with_index(ends.groupBy("x", "y").agg(F.min("seen").alias("seen")), "seen", name="node").select("x", "y", "node")
    for side, name in (("a", "source"), ("b", "target")):
        n = n.join(nodes.select(F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"), F.col("node").alias(name)), [f"{side}x", f"{side}y"])
    point = lambda s: F.struct(F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y"))
    n = n.select(
        "segment_index", F.col("segment_index").alias("segment_id"), "source", "target", "length_m", F.array(point("a"), point("b")).alias("geometry"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1"),
        *(F.lit(None).cast("string").alias(c) for c in ("source_dataset", "cleaning_profile", "original_feature_id")), F.lit(None).cast("bigint").alias("component_id"),
    )
    return RoadNetwork(n.select(*SEGMENTS.names))
