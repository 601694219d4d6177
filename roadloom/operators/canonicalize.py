"""Line networks to noded segment graphs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.plans.network import NetworkError, RoadNetwork, with_index
from roadloom.plans.scratch import cut
from roadloom.schema import EPSILON, LENGTH_KEYS


@dataclass
class Options:
    split_intersections: bool = True
    preserve_source_ids: bool = False
    cleaning_profile: str | None = None
    source_dataset: str | None = None
    input_crs: str | None = None
    output_crs: str | None = None
    length_keys: tuple[str, ...] = LENGTH_KEYS
    node_tolerance: float | None = None
    end_stub_min_ratio: float = 0.0
    unlink_masks: DataFrame | None = None
    labels: dict = field(default_factory=dict)


def prepared_lines(features: DataFrame, options: Options) -> DataFrame:
    """(line, original_id, points, run, size, reported): parts with at least two finite points and a positive length, numbered in order."""
    parts = features.select("feature_index", "id", "properties", F.posexplode("parts").alias("part", "raw"))
    parts = parts.withColumn("points", g.clean_points("raw")).where(F.size("points") >= 2).withColumn("size", g.line_length("points"))
    total = F.sum("size").over(Window.partitionBy("feature_index"))
    numbers = [F.expr(f"try_cast(trim(properties['{key}']) as double)") for key in options.length_keys]
    given = F.coalesce(*(F.when(g.finite(n) & (n > 0), n) for n in numbers))
    parts = parts.withColumn("total", total).where("size > 0")
    reported = F.when(given.isNull() | (F.col("total") <= 0), F.col("size")).otherwise(given * (F.col("size") / F.nullif("total", F.lit(0.0))))
    parts = parts.select(
        "feature_index", "part", F.coalesce("id", F.col("properties")["id"], F.col("feature_index").cast("string")).alias("original_id"), "points", g.cumulative("points").alias("run"), "size", reported.alias("reported")
    )
    return with_index(parts, "feature_index", "part", name="line").drop("feature_index", "part")


def line_edges(lines: DataFrame) -> DataFrame:
    """(edge, line, ax, ay, bx, by, base, len): the pieces between neighbouring vertices."""
    p, d = F.col("points"), F.col("run")
    pieces = lines.select("line", "points", "run", F.explode(F.sequence(F.lit(1), F.size("points") - 1)).alias("i"))
    a, b = F.element_at(p, F.col("i")), F.element_at(p, F.col("i") + 1)
    return pieces.select(
        "line", "i", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.element_at(d, F.col("i")).alias("base"), (F.element_at(d, F.col("i") + 1) - F.element_at(d, F.col("i"))).alias("len")
    )


def intersections(edges: DataFrame) -> DataFrame:
    """(line_a, at_a, line_b, at_b, x, y): crossings of edges of different lines, once for each pair of edges.

    Edges meet in square cells of about their own size, found from the extent and the mean length; a
    pair is compared only in the first cell that both touch, so that no duplicates are made.
    """
    low = lambda p, q: F.least(p, q)
    boxed = edges.withColumns({"x0": low("ax", "bx") - EPSILON, "x1": F.greatest("ax", "bx") + EPSILON, "y0": low("ay", "by") - EPSILON, "y1": F.greatest("ay", "by") + EPSILON})
    s = boxed.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("span")).first()
    if not s["n"]:
        cell = 1.0
    else:
        cell = max(EPSILON, s["span"] / math.sqrt(s["n"]), s["mean"])
    tile = lambda c: F.floor(F.col(c) / cell)
    dealt = boxed.withColumn("cx", F.explode(F.sequence(tile("x0"), tile("x1")))).withColumn("cy", F.explode(F.sequence(tile("y0"), tile("y1"))))
    a, b = dealt.alias("a"), dealt.alias("b")
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.line") < F.col("b.line"))
    overlap = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    first = (F.col("a.cx") == F.greatest(F.floor(F.col("a.x0") / cell), F.floor(F.col("b.x0") / cell))) & (F.col("a.cy") == F.greatest(F.floor(F.col("a.y0") / cell), F.floor(F.col("b.y0") / cell)))
    met = a.join(b, same & overlap & first)
    rx, ry = F.col("a.bx") - F.col("a.ax"), F.col("a.by") - F.col("a.ay")
    qx, qy = F.col("b.bx") - F.col("b.ax"), F.col("b.by") - F.col("b.ay")
    wx, wy = F.col("b.ax") - F.col("a.ax"), F.col("b.ay") - F.col("a.ay")
    cross = rx * qy - ry * qx
    usable = F.nullif(F.when(F.abs(cross) < EPSILON, 0.0).otherwise(cross), F.lit(0.0))
    t, u = (wx * qy - wy * qx) / usable, (wx * ry - wy * rx) / usable
    met = met.withColumns({"t": t, "u": u}).where((F.col("t") >= -EPSILON) & (F.col("t") <= 1 + EPSILON) & (F.col("u") >= -EPSILON) & (F.col("u") <= 1 + EPSILON))
    bound = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    return met.select(
        F.col("a.line").alias("line_a"),
        (F.col("a.base") + F.col("a.len") * bound("t")).alias("at_a"),
        F.col("b.line").alias("line_b"),
        (F.col("b.base") + F.col("b.len") * bound("u")).alias("at_b"),
        (F.col("a.ax") + rx * bound("t")).alias("x"),
        (F.col("a.ay") + ry * bound("t")).alias("y"),
    )


def masked(hits: DataFrame, masks: DataFrame | None) -> DataFrame:
    """``hits`` with ``skipped``: within the radius of a mask, inclusive. Masks are few (drawn by hand); they are broadcast."""
    if masks is None:
        return hits.withColumn("skipped", F.lit(False))
    inside = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("radius")
    numbered = hits.withColumn("_hit", F.struct("line_a", "at_a", "line_b", "at_b"))
    held = numbered.join(F.broadcast(masks), inside, "left_semi").withColumn("skipped", F.lit(True))
    free = numbered.join(F.broadcast(masks), inside, "left_anti").withColumn("skipped", F.lit(False))
    return held.unionByName(free).drop("_hit")


def kept_splits(size: Column, splits: Column, tolerance: Column) -> Column:
    """Both ends and the splits between, in order, each farther than the tolerance from the last one kept."""
    every = F.array_sort(F.concat(F.array(F.lit(0.0), size), F.transform(splits, lambda d: F.greatest(F.lit(0.0), F.least(size, d)))))
    inner = F.filter(every, lambda d: (d > tolerance) & (size - d > tolerance))
    kept = F.aggregate(inner, F.array(F.lit(0.0)), lambda run, d: F.when(d - F.element_at(run, -1) > tolerance, F.concat(run, F.array(d))).otherwise(run))
    return F.concat(kept, F.array(size))


@dataclass
class Canonical:
    network: RoadNetwork
    metadata: dict


def canonicalize(features: DataFrame, options: Options | None = None) -> Canonical:
    """Node a table of line features (``schema.FEATURES``) into a segment graph with metadata.

    Lines of different features are split where they cross or touch; collinear overlaps, duplicates
    and crossings of a line with itself are left as they are. Ends that round to the same cell of the
    node tolerance are one node; nodes are numbered as they are first met. Lengths are the reported
    length of the line, by share.
    """
    o = options or Options()
    lines = cut(prepared_lines(features, o))
    extent = lines.select(F.explode("points").alias("p")).agg(*(f(F.col(f"p.{c}")).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max)))).first()
    if extent["min_x"] is None:
        raise NetworkError("No valid line features.")
    span = max(extent["max_x"] - extent["min_x"], extent["max_y"] - extent["min_y"])
    tolerance = F.greatest(F.col("size") * 1e-9, F.lit(1e-12))
    counts = {"intersections_split": 0, "intersections_skipped_by_unlink": 0}
    if o.split_intersections:
        hits = cut(masked(intersections(line_edges(lines)), o.unlink_masks))
        for row in hits.groupBy("skipped").count().collect():
            counts["intersections_skipped_by_unlink" if row["skipped"] else "intersections_split"] = row["count"]
        hits = hits.where("not skipped")
        splits = hits.select(F.col("line_a").alias("line"), F.col("at_a").alias("at")).unionAll(hits.select("line_b", "at_b"))
        lines = lines.join(splits.groupBy("line").agg(F.collect_set("at").alias("splits")), "line", "left")
        lines = lines.withColumn("splits", F.coalesce("splits", F.array().cast("array<double>")))
    else:
        lines = lines.withColumn("splits", F.array().cast("array<double>"))
    lines = lines.withColumn("cuts", kept_splits(F.col("size"), F.col("splits"), tolerance))
    last = F.size("cuts") - 1
    pieces = lines.select("*", last.alias("last"), F.explode(F.sequence(F.lit(1), last)).alias("piece"))
    pieces = pieces.withColumns({"start": F.element_at("cuts", F.col("piece")), "end": F.element_at("cuts", F.col("piece") + 1)})
    length = F.col("end") - F.col("start")
    stub = (F.lit(float(o.end_stub_min_ratio)) > 0) & ((F.col("piece") == 1) | (F.col("piece") == F.col("last"))) & (length / F.col("size") < o.end_stub_min_ratio)
    status = F.when(~(length > tolerance), "zero").when(stub, "stub").otherwise("piece")
    pieces = pieces.select(
        "line", "piece", "original_id", status.alias("status"), (F.col("reported") * (length / F.col("size"))).alias("length_m"), g.sub_line(F.col("points"), F.col("run"), F.col("start"), F.col("end")).alias("geometry")
    )
    pieces = cut(pieces)
    node_tolerance = o.node_tolerance if o.node_tolerance is not None else max(span * 1e-9, 1e-10)
    cell = lambda c: F.floor(c / node_tolerance + 0.5)
    first, final = F.element_at("geometry", 1), F.element_at("geometry", -1)
    good = pieces.where("status = 'piece'").select("line", "piece", "original_id", "length_m", "geometry", first["x"].alias("x0"), first["y"].alias("y0"), final["x"].alias("x1"), final["y"].alias("y1"))
    good = good.withColumns({"a": F.struct(cell(F.col("x0")).alias("x"), cell(F.col("y0")).alias("y")), "b": F.struct(cell(F.col("x1")).alias("x"), cell(F.col("y1")).alias("y"))})
    ends = good.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.struct("line", "piece", F.lit(0).alias("end")).alias("seen")), F.struct(F.col("b").alias("key"), F.struct("line", "piece", F.lit(1).alias("end")).alias("seen")))).alias("e"))
    firsts = ends.groupBy("e.key").agg(F.min("e.seen").alias("seen")).select("key", "seen.line", "seen.piece", "seen.end")
    nodes = cut(with_index(firsts, "line", "piece", "end", name="node").select("key", "node"))
    joined = good.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("source")), "a").join(nodes.select(F.col("key").alias("b"), F.col("node").alias("target")), "b")
    joined = cut(joined.drop("a", "b"))
    segments = with_index(joined.where("source != target"), "line", "piece")
    label = lambda v: F.lit(v).cast("string")
    segments = cut(
        segments.select(
            "segment_index", F.col("segment_index").alias("segment_id"), "source", "target", "length_m", "geometry", "x0", "y0", "x1", "y1",
            label(o.source_dataset).alias("source_dataset"), label(o.cleaning_profile).alias("cleaning_profile"),
            (F.col("original_id") if o.preserve_source_ids else label(None)).alias("original_feature_id"), F.lit(None).cast("bigint").alias("component_id"),
        )
    )
    by_status = {r["status"]: r["count"] for r in pieces.groupBy("status").count().collect()}
    made = segments.agg(F.count(F.lit(1)).alias("n"), F.sum("length_m").alias("total")).first()
    if not made["n"]:
        raise NetworkError("No output segments produced.")
    metadata = {
        "input_feature_count": features.count(),
        "input_line_count": lines.count(),
        **counts,
        "zero_length_discarded": by_status.get("zero", 0) + joined.where("source = target").count(),
        "discarded_end_stubs": by_status.get("stub", 0),
        "output_segment_count": made["n"],
        "node_count": nodes.count(),
        "feature_count": made["n"],
        "total_length_m": made["total"],
        "source_dataset": o.source_dataset,
        "cleaning_profile": o.cleaning_profile,
        "input_crs": o.input_crs,
        "output_crs": o.output_crs,
        "node_tolerance": node_tolerance,
    }
    network = RoadNetwork(segments, {key: value for key, value in metadata.items() if value is not None}).validate()
    return Canonical(network, network.metadata)


def crossing_features(spark, sf_dir: str) -> DataFrame:
    """Features of the synthetic tables: a long horizontal line for each region, a vertical one for each nation."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    key, n = F.col("r_regionkey"), F.col("n_nationkey")
    properties = lambda v: F.create_map(F.lit("length_m"), v.cast("string"))
    across = region.select(key.cast("bigint").alias("feature_index"), F.concat(F.lit("r"), key.cast("string")).alias("id"), F.array(F.array(point(F.lit(0), 10 * key + 5), point(F.lit(100), 10 * key + 5))).alias("parts"), properties(F.lit(200)).alias("properties"))
    down = nation.select((100 + n).cast("bigint").alias("feature_index"), F.concat(F.lit("n"), n.cast("string")).alias("id"), F.array(F.array(point(4 * n + 2, F.lit(0)), point(4 * n + 2, F.lit(60)))).alias("parts"), properties(F.lit(60)).alias("properties"))
    return across.unionByName(down)
