"""Networks: validated segment tables, and the graph that kernels run on."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators.kernels import StreetGraph
from roadloom.plans.scratch import cut
from roadloom.schema import BROADCAST_SEGMENTS, SEGMENTS


class NetworkError(ValueError):
    """A network or a request that can't be computed."""


def from_columns(spark: SparkSession, source, target, length, x0=None, y0=None, x1=None, y1=None) -> RoadNetwork:
    """A network of aligned columns. Ends count only where all four ordinates are finite; else a line along the x axis stands in."""
    if len(target) != len(source) or len(length) != len(source):
        raise NetworkError("source, target and length must have equal lengths.")
    rows = []
    for i, (s, t, m) in enumerate(zip(source, target, length, strict=True)):
        ends = [float(c[i]) if c is not None and i < len(c) and c[i] is not None else math.nan for c in (x0, y0, x1, y1)]
        there = all(map(math.isfinite, ends))
        line = [(ends[0], ends[1]), (ends[2], ends[3])] if there else [(0.0, float(i)), (float(m), float(i))]
        rows.append((i, i, int(s), int(t), float(m), line, *(ends if there else [None] * 4), None, None, None, None))
    return RoadNetwork(spark.createDataFrame(rows, SEGMENTS))


def with_index(df: DataFrame, *order: str, name: str = "segment_index") -> DataFrame:
    """Number rows from 0 in the given order without gathering them in one task: sort by range, count each partition, add offsets.

    The sorted rows are checkpointed with the partition that they stand in: partitions of a second
    execution need not be the same.
    """
    ordered = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = sizes.selectExpr("_part", "_first", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0L) as _offset")
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_offset")).drop("_part", "_at", "_first", "_offset")


@dataclass
class RoadNetwork:
    """A segment table (``schema.SEGMENTS``, in any column order, further columns allowed) with optional metadata."""

    segments: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.segments.sparkSession

    def errors(self) -> DataFrame:
        """(segment_index, error) of every segment that breaks a rule."""
        pts = F.col("geometry")
        bad_point = F.exists(pts, lambda p: ~g.finite(p["x"]) | ~g.finite(p["y"]))
        name = F.concat(F.lit("Segment "), F.coalesce(F.col("segment_id").cast("string"), F.lit("?")))
        rules = (
            (F.col("segment_id").isNull() | (F.col("segment_id") < 0), ": segment_id must be a non-negative integer."),
            (F.col("source").isNull() | F.col("target").isNull(), ": source and target must be integers."),
            (F.col("source") == F.col("target"), ": source and target must differ."),
            (~g.finite("length_m") | (F.col("length_m") <= 0), ": length_m must be positive and finite."),
            (F.coalesce(F.size(pts), F.lit(-1)) < 2, ": geometry must have at least two points."),
            (bad_point, ": geometry must have finite coordinates."),
        )
        message = F.coalesce(*(F.when(rule, F.concat(name, F.lit(text))) for rule, text in rules))
        single = self.segments.select("segment_index", message.alias("error")).where("error is not null")
        twice = self.segments.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.max("segment_index").alias("segment_index")).where("n > 1 and segment_id is not null")
        return single.unionByName(twice.select("segment_index", F.concat(F.lit("Duplicate segment_id "), F.col("segment_id").cast("string"), F.lit(".")).alias("error")))

    def validate(self) -> RoadNetwork:
        """Raise the error of the first segment that has one."""
        first = self.errors().orderBy("segment_index").limit(1).collect()
        if first:
            raise NetworkError(first[0]["error"])
        return self

    @cached_property
    def ends(self) -> DataFrame:
        """The slim table that every graph is built from: explicit ends where finite, else those of the line; curvature of the line."""
        pts = F.col("geometry")
        first, last = F.try_element_at(pts, F.lit(1)), F.try_element_at(pts, F.lit(-1))
        has_first, has_last = g.finite("x0") & g.finite("y0"), g.finite("x1") & g.finite("y1")
        return self.segments.select(
            "segment_index",
            "source",
            "target",
            "length_m",
            F.when(has_first, F.col("x0")).otherwise(first["x"]).alias("ax"),
            F.when(has_first, F.col("y0")).otherwise(first["y"]).alias("ay"),
            F.when(has_last, F.col("x1")).otherwise(last["x"]).alias("bx"),
            F.when(has_last, F.col("y1")).otherwise(last["y"]).alias("by"),
            F.coalesce(g.curvature("geometry"), F.lit(0.0)).alias("curvature"),
        )

    @cached_property
    def size(self) -> tuple[int, float, float]:
        """(segments, longest segment, greatest ratio of the straight line between the ends to the length)."""
        chord = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
        row = self.ends.agg(F.count(F.lit(1)).alias("n"), F.max("length_m").alias("longest"), F.max(chord / F.col("length_m")).alias("ratio")).first()
        return row["n"], row["longest"] or 0.0, row["ratio"] or 1.0

    @cached_property
    def graph(self):
        """The graph as a broadcast variable; only for at most ``BROADCAST_SEGMENTS`` segments."""
        table = self.ends.limit(BROADCAST_SEGMENTS + 1).toArrow()
        if table.num_rows > BROADCAST_SEGMENTS:
            raise NetworkError(f"The graph has over {BROADCAST_SEGMENTS} segments; a finite metric radius is needed, so that it can be cut into tiles.")
        return self.spark.sparkContext.broadcast(table.sort_by("segment_index"))


def build_graph(table: pa.Table, longest: float | None = None) -> StreetGraph:
    """A graph from rows of ``RoadNetwork.ends`` in order of segment_index."""
    nan = math.nan
    c = {name: table.column(name).to_pylist() for name in table.column_names}
    number = lambda x: nan if x is None else x
    return StreetGraph(
        c["segment_index"],
        c["source"],
        c["target"],
        [number(x) for x in c["length_m"]],
        [(number(x), number(y)) for x, y in zip(c["ax"], c["ay"], strict=True)],
        [(number(x), number(y)) for x, y in zip(c["bx"], c["by"], strict=True)],
        c["curvature"],
        longest if longest is not None else max((x for x in c["length_m"] if x is not None), default=0.0),
    )


# The derived network of the synthetic tables: a grid over suppliers.
GRID_SQL = """
WITH n AS (
  SELECT s_suppkey AS node, CAST(floor(abs(s_acctbal)) AS BIGINT) % 60 AS jitter FROM supplier),
c AS (SELECT count(*) AS total, CAST(ceil(sqrt(count(*))) AS BIGINT) AS width FROM n),
e AS (
  SELECT a.node AS source, b.node AS target, 0 AS way, 60 + a.jitter + b.jitter AS length_m, c.width
  FROM n a JOIN n b ON b.node = a.node + 1 CROSS JOIN c WHERE a.node % c.width <> c.width - 1
  UNION ALL
  SELECT a.node, b.node, 1, 60 + a.jitter + b.jitter, c.width
  FROM n a CROSS JOIN c JOIN n b ON b.node = a.node + c.width WHERE (a.node * 7) % 10 <> 3),
seg AS (
  SELECT row_number() OVER (ORDER BY source, way) - 1 AS segment_index, source, target, CAST(length_m AS DOUBLE) AS length_m,
         CAST(100 * (source % width) AS DOUBLE) AS x0, CAST(100 * ((source - source % width) / width) AS DOUBLE) AS y0,
         CAST(100 * (target % width) AS DOUBLE) AS x1, CAST(100 * ((target - target % width) / width) AS DOUBLE) AS y1
  FROM e)
"""


def grid_network(spark: SparkSession, sf_dir: str) -> RoadNetwork:
    """The derived network: nodes are suppliers on a grid, lengths whole numbers from their balances."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("node"), (F.floor(F.abs("s_acctbal")) % 60).alias("jitter"))
    width = supplier.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("bigint").alias("width"))
    near = supplier.select(F.col("node").alias("target"), F.col("jitter").alias("other"))
    base = supplier.join(F.broadcast(width)).select(F.col("node").alias("source"), "jitter", "width")
    across = base.where("source % width <> width - 1").withColumn("target", F.col("source") + 1).withColumn("way", F.lit(0))
    down = base.where("(source * 7) % 10 <> 3").withColumn("target", F.col("source") + F.col("width")).withColumn("way", F.lit(1))
    edges = across.unionByName(down).join(near, "target")
    numbered = with_index(edges, "source", "way")
    x = lambda c: (100 * (F.col(c) % F.col("width"))).cast("double")
    y = lambda c: (100 * F.floor(F.col(c) / F.col("width"))).cast("double")
    point = lambda c: F.struct(x(c).alias("x"), y(c).alias("y"))
    return RoadNetwork(
        numbered.select(
            "segment_index",
            F.col("segment_index").alias("segment_id"),
            "source",
            "target",
            (60 + F.col("jitter") + F.col("other")).cast("double").alias("length_m"),
            F.array(point("source"), point("target")).alias("geometry"),
            x("source").alias("x0"),
            y("source").alias("y0"),
            x("target").alias("x1"),
            y("target").alias("y1"),
            *(F.lit(None).cast("string").alias(c) for c in ("source_dataset", "cleaning_profile", "original_feature_id")),
            F.lit(None).cast("bigint").alias("component_id"),
        )
    )
