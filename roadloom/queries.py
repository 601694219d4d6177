"""Registered queries over the synthetic tables, with the SQL that gives the same rows.

Networks are derived from ``supplier`` (``GRID_SQL``); lengths are whole numbers, so that sums are
exact in any order. Values that aren't whole are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import canonicalize as can
from roadloom.operators import kernels as k
from roadloom.operators import measures as m
from roadloom.operators import paths, topology
from roadloom.operators.routes import routes
from roadloom.plans import catalog, validation
from roadloom.plans.network import GRID_SQL, RoadNetwork, from_columns, grid_network
from roadloom.plans.rowhash import row_hash_frame
from roadloom.plans.scratch import scratch_path
from roadloom.sources import flatgeobuf, geojson, mapinfo, segment_csv

RADIUS, HOPS, DEGREES = 400.0, 3.0, 90.0

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def on_grid(measure: Callable[[RoadNetwork], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(measure(grid_network(spark, sf_dir)))


def weights(network: RoadNetwork, sf_dir: str) -> DataFrame:
    """Quantities that the supplier at a segment's source has delivered."""
    lines = network.spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").cast("bigint").alias("source")).agg(F.sum(F.col("l_quantity").cast("double")).alias("weight"))
    return network.segments.select("segment_index", "source").join(lines, "source", "left").select("segment_index", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def weighted(measure: Callable[[RoadNetwork, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        network = grid_network(spark, sf_dir)
        return rounded(measure(network, weights(network, sf_dir)))

    return query


def trips(network: RoadNetwork, sf_dir: str) -> DataFrame:
    """Requests between segments that users' numbers fall to."""
    n = network.size[0]
    users = network.spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("bigint").alias("u")).distinct()
    return users.select((F.col("u") % n).alias("from_segment"), ((F.col("u") * 7 + 3) % n).alias("to_segment")).distinct()


def route_query(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        network = grid_network(spark, sf_dir)
        found = routes(network, trips(network, sf_dir), mode)
        return rounded(found.select("from_segment", "to_segment", "found", F.array_join(F.col("segment_indexes").cast("array<string>"), ",").alias("segments"), "distance_m", "angular_cost", "vector_cost"))

    return query


def crossing(spark: SparkSession, sf_dir: str) -> can.Canonical:
    return can.canonicalize(can.crossing_features(spark, sf_dir), can.Options(preserve_source_ids=True))


def canonicalize_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = crossing(spark, sf_dir).network.segments
    return rounded(s.select("segment_index", "source", "target", "length_m", "x0", "y0", "x1", "y1", "original_feature_id"))


def canonicalize_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crossing(spark, sf_dir).metadata
    names = ("input_feature_count", "input_line_count", "intersections_split", "intersections_skipped_by_unlink", "zero_length_discarded", "discarded_end_stubs", "output_segment_count", "node_count")
    return spark.createDataFrame([tuple(found[n] for n in names) + (found["total_length_m"],)], ", ".join(f"{n} bigint" for n in names) + ", total_length_m double")


def canonicalize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = can.prepared_lines(can.crossing_features(spark, sf_dir), can.Options())
    return rounded(can.line_edges(lines).select("line", "ax", "ay", "bx", "by", "base", "len"))


def canonicalize_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = can.prepared_lines(can.crossing_features(spark, sf_dir), can.Options())
    return rounded(can.intersections(can.line_edges(lines)))


def unlink_mask_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = can.prepared_lines(can.crossing_features(spark, sf_dir), can.Options())
    masks = spark.read.parquet(f"{sf_dir}/region.parquet").select((10 * F.col("r_regionkey")).cast("double").alias("cx"), (10 * F.col("r_regionkey") + 5).cast("double").alias("cy"), F.lit(4.5).alias("radius"))
    return can.masked(can.intersections(can.line_edges(lines)), masks).select("line_a", "line_b", "skipped")


def normalize_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = can.crossing_features(spark, sf_dir)
    moved = mapinfo.LocalNormalizer.of(features).apply(features)
    return rounded(moved.select("id", F.posexplode(F.flatten("parts")).alias("n", "p")).select("id", F.col("n").cast("bigint").alias("n"), F.col("p.x").alias("x"), F.col("p.y").alias("y")))


def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapinfo.extent(can.crossing_features(spark, sf_dir))


def _text_of(lines: DataFrame, head: list[str] | None = None) -> DataFrame:
    """One text of a table (segment_index, line), to read again."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit("".join(f"{h}\n" for h in head or [])), text).alias("value"))


def _mif(network: RoadNetwork) -> tuple[DataFrame, DataFrame]:
    s = network.segments
    lines = s.select("segment_index", F.concat_ws(" ", F.lit("Line"), *(F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1"))).alias("line"))
    cells = s.select("segment_index", F.concat(F.lit('"Road, no. '), F.col("segment_index").cast("string"), F.lit('",'), F.col("length_m").cast("string")).alias("line"))
    return _text_of(lines, ["Version 300", "Columns 2", "  Name Char(20)", "  length_m Float", "Data"]), _text_of(cells)


def mif_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapinfo.parse_mif(*_mif(grid_network(spark, sf_dir)))
    return found.select("row", "x0", "y0", "x1", "y1", F.col("properties")["Name"].alias("name"), F.col("properties")["length_m"].cast("double").alias("length_m"))


def mid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapinfo.parse_mid(_mif(grid_network(spark, sf_dir))[1])
    return found.select("row", F.get("cells", F.lit(0)).alias("name"), F.get("numbers", F.lit(1)).alias("length_m"))


def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = grid_network(spark, sf_dir)
    text = _text_of(geojson.feature_lines(network).withColumnRenamed("feature", "line")).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.replace("value", F.lit("\n"), F.lit(",\n")), F.lit("]}")).alias("value"))
    return geojson.network_of(text).segments.select("segment_index", "segment_id", "source", "target", "length_m", "x0", "y0", "x1", "y1")


def flatgeobuf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = spark.createDataFrame([(bytearray(flatgeobuf.to_flatgeobuf(grid_network(spark, sf_dir))),)], "content binary")
    return flatgeobuf.network_of(contents).segments.select("segment_index", "segment_id", "source", "target", "length_m", "x0", "y0", "x1", "y1")


def feature_folder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features")
    geojson.write_features(grid_network(spark, sf_dir), path)
    return geojson.read_feature_lines(spark, path).segments.select("segment_index", "segment_id", "source", "target", "length_m", "x0", "y0", "x1", "y1")


def segment_csv_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "segments-csv")
    names = {"segment_index": "Ref", "x0": " x1", "y0": " y1", "x1": "x2", "y1": "y2", "length_m": "Segment Length"}
    rows = grid_network(spark, sf_dir).segments.orderBy("segment_index").select(*(F.col(c).alias(n) for c, n in names.items()))
    rows.coalesce(1).write.option("header", True).csv(path)  # an export is one file
    return segment_csv.network_of(segment_csv.read_rows(spark, path)).segments.select("segment_index", "source", "target", "length_m", "x0", "y0", "x1", "y1")


def columnar_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of columns in memory, as a client sends them; every third line has no ends."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    ends = [None if r.n_nationkey % 3 == 0 else float(r.n_nationkey) for r in rows]
    made = from_columns(spark, [r.n_nationkey for r in rows], [100 + r.n_regionkey for r in rows], [r.n_nationkey + 1.5 for r in rows], ends, ends, [r.n_regionkey for r in rows], [r.n_regionkey for r in rows])
    first, last = F.element_at("geometry", 1), F.element_at("geometry", -1)
    return made.segments.select("segment_index", "source", "target", "length_m", "x0", "y0", "x1", "y1", first["x"].alias("ax"), first["y"].alias("ay"), last["x"].alias("bx"), last["y"].alias("by"))


def feature_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with as many parts as the region has nations, for each region, from the text of a collection."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pair = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    parts = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(pair(n, r), pair(n, r + 1), pair(n + 2, r + 1)).alias("p")))), lambda x: x["p"]).alias("parts"))
    kinds = F.when(r % 2 == 0, F.struct(F.lit("MultiLineString").alias("type"), F.to_json("parts").alias("coordinates"))).otherwise(F.struct(F.lit("LineString").alias("type"), F.to_json(F.col("parts")[0]).alias("coordinates")))
    named = parts.select(r.alias("segment_index"), kinds.alias("k"))
    line = F.concat(F.lit('{"type":"Feature","id":"r'), F.col("segment_index").cast("string"), F.lit('","geometry":{"type":"'), F.col("k.type"), F.lit('","coordinates":'), F.col("k.coordinates"), F.lit('},"properties":{"kind":"'), F.col("segment_index").cast("string"), F.lit('"}}'))
    text = _text_of(named.select("segment_index", line.alias("line"))).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.replace("value", F.lit("\n"), F.lit(",\n")), F.lit("]}")).alias("value"))
    flat = geojson.flattened(geojson.features_of(text))
    last = F.element_at("points", -1)
    return flat.select("feature_index", F.col("part").cast("bigint").alias("part"), "id", F.size("points").cast("bigint").alias("points"), last["x"].alias("x"), last["y"].alias("y"), F.col("properties")["kind"].alias("kind"))


def mif_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapinfo.features_of(mapinfo.parse_mif(*_mif(grid_network(spark, sf_dir))))
    return found.select("feature_index", "id", F.col("parts")[0][0]["x"].alias("x0"), F.col("parts")[0][0]["y"].alias("y0"), F.col("parts")[0][1]["x"].alias("x1"), F.col("parts")[0][1]["y"].alias("y1"), F.col("properties")["Name"].alias("name"))


def mif_unlink_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mapinfo.unlink_masks(mapinfo.parse_mif(*_mif(grid_network(spark, sf_dir)))))


def bent_lines(spark: SparkSession, sf_dir: str) -> can.Canonical:
    """A long line with a part of no length for each region, a line with a bend for each nation, one that ends on another; one crossing is masked, short ends are dropped."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    r, n = F.col("r_regionkey").cast("bigint"), F.col("n_nationkey").cast("bigint")
    none = F.lit(None).cast("map<string,string>")
    across = region.select(r.alias("feature_index"), F.concat(F.lit("r"), r.cast("string")).alias("id"), F.array(F.array(point(-1, 10 * r + 5), point(101, 10 * r + 5)), F.array(point(7, r), point(7, r))).alias("parts"), F.create_map(F.lit("length_m"), F.lit("204")).alias("properties"))
    down = nation.select((1000 + n).alias("feature_index"), F.concat(F.lit("n"), n.cast("string")).alias("id"), F.array(F.array(point(4 * n, 0), point(4 * n, 50), point(4 * n + 2, 50))).alias("parts"), none.alias("properties"))
    ends = spark.range(1).select(F.lit(2000).cast("bigint").alias("feature_index"), F.lit("t").alias("id"), F.array(F.array(point(50, 5), point(50, 9))).alias("parts"), none.alias("properties"))
    masks = spark.createDataFrame([(8.0, 15.0, 1.0)], "cx double, cy double, radius double")
    return can.canonicalize(across.unionByName(down).unionByName(ends), can.Options(preserve_source_ids=True, end_stub_min_ratio=0.06, unlink_masks=masks))


def canonicalize_bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bent_lines(spark, sf_dir).network.segments
    return rounded(s.select("segment_index", "source", "target", "length_m", "x0", "y0", "x1", "y1", F.size("geometry").cast("bigint").alias("points"), "original_feature_id"))


def canonicalize_bent_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bent_lines(spark, sf_dir).metadata
    names = ("input_feature_count", "input_line_count", "intersections_split", "intersections_skipped_by_unlink", "zero_length_discarded", "discarded_end_stubs", "output_segment_count", "node_count")
    return spark.createDataFrame([tuple(found[n] for n in names) + (round(found["total_length_m"], 6),)], ", ".join(f"{n} bigint" for n in names) + ", total_length_m double")


def path_from_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The farthest node that node 0 reaches, its distance, and the sum of the least segments along the path that is found."""
    network = grid_network(spark, sf_dir)
    tree = paths.dijkstra(network, 0).cache()
    last = tree.orderBy(F.desc("distance"), F.desc("node")).first()
    way = paths.reconstruct_path(tree, last["node"])
    steps = spark.createDataFrame(list(zip(way, way[1:])), "from_node bigint, to_node bigint")
    least = topology.primal_edges(network).groupBy("from_node", "to_node").agg(F.min("weight").alias("weight"))
    return steps.join(least, ["from_node", "to_node"]).agg(F.lit(last["node"]).cast("bigint").alias("node"), F.lit(last["distance"]).alias("distance"), F.sum("weight").alias("along"))


def on_demand_primal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values asked one at a time, of the first three segments."""
    network = grid_network(spark, sf_dir)
    return rounded(spark.createDataFrame([(s, m.on_demand_primal_integration(network, RADIUS, s)) for s in range(3)], "segment_index bigint, value double"))


def components(kind: str) -> Query:
    return on_grid(paths.node_components if kind == "node" else paths.segment_components)


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    balance = F.col("s_acctbal").cast("double")
    pairs = s.select(F.col("s_suppkey").alias("row"), F.floor(balance / 100).cast("double").alias("reference"), F.floor(F.abs(balance) / 250).cast("double").alias("engine"))
    return rounded(validation.compare_columns(pairs))


def columns_of_a_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = grid_network(spark, sf_dir)
    return rounded(catalog.compute_columns(network, [c for c in catalog.allowed_columns() if c.endswith("_r400")]))


def queries() -> dict[str, Query]:
    pst = k.PstRadii(walking=RADIUS)
    return {
        "segments_valid": on_grid(lambda n: n.validate().segments.select("segment_index", "source", "target", "length_m", "x0", "y0", "x1", "y1")),
        "node_ids": on_grid(topology.node_ids),
        "node_index": on_grid(topology.node_index),
        "primal_edges": on_grid(topology.primal_edges),
        "dual_edges": on_grid(topology.dual_edges),
        "center_edges_metric": on_grid(lambda n: topology.centre_edges(n, "metric")),
        "center_edges_angular": on_grid(lambda n: topology.centre_edges(n, "turn")),
        "center_edges_sdna": on_grid(lambda n: topology.centre_edges(n, "bend")),
        "angular_state_edges": on_grid(topology.state_edges),
        "node_degree": on_grid(topology.node_degree),
        "segment_degree": on_grid(topology.segment_degree),
        "line_curvature": on_grid(topology.line_curvature),
        "node_components": components("node"),
        "segment_components": components("segment"),
        "dijkstra_from_node": on_grid(lambda n: paths.dijkstra(n, 0).select("node", "distance")),
        "bfs_from_node": on_grid(lambda n: paths.breadth_first(n, 0)),
        "relaxed_distances_r": on_grid(lambda n: paths.relaxed_node_distances(n, RADIUS)),
        "centre_distances_r": on_grid(lambda n: paths.centre_distances(n, RADIUS)),
        "reach_r": on_grid(lambda n: m.reach_count(n, RADIUS)),
        "farness_r": on_grid(lambda n: m.farness(n, RADIUS)),
        "harmonic_r": on_grid(lambda n: m.harmonic_closeness(n, RADIUS)),
        "mean_depth_r": on_grid(lambda n: m.mean_depth(n, RADIUS)),
        "reach_topological_r": on_grid(lambda n: m.reach_count(n, HOPS, "topological")),
        "farness_topological_r": on_grid(lambda n: m.farness(n, HOPS, "topological")),
        "primal_integration_r": on_grid(lambda n: m.primal_integration(n, RADIUS)),
        "node_betweenness_r": on_grid(lambda n: m.node_betweenness(n, RADIUS)),
        "node_betweenness_topological_r": on_grid(lambda n: m.node_betweenness(n, HOPS, "topological")),
        "segment_betweenness_r": on_grid(lambda n: m.segment_betweenness(n, RADIUS)),
        "primal_choice_r": on_grid(lambda n: m.primal_choice(n, RADIUS)),
        "sdna_mean_distance_r": on_grid(lambda n: m.sdna_mean_distance(n, RADIUS)),
        "sdna_links_r": on_grid(lambda n: m.sdna_links(n, RADIUS)),
        "sdna_length_r": on_grid(lambda n: m.sdna_length(n, RADIUS)),
        "sdna_weight_r": weighted(lambda n, w: m.sdna_weight(n, RADIUS, w)),
        "sdna_betweenness_r": on_grid(lambda n: m.sdna_betweenness(n, RADIUS)),
        "sdna_angular_mean_distance_r": on_grid(lambda n: m.sdna_angular_mean_distance(n, DEGREES)),
        "sdna_angular_betweenness_r": on_grid(lambda n: m.sdna_angular_betweenness(n, DEGREES)),
        "pst_reach_r": weighted(lambda n, w: m.pst_reach(n, RADIUS, w)),
        "pst_gravity_r": weighted(lambda n, w: m.pst_gravity(n, RADIUS, w)),
        "pst_mean_distance_r": weighted(lambda n, w: m.pst_mean_distance(n, RADIUS, w)),
        "pst_angular_reach_r": weighted(lambda n, w: m.pst_reach(n, DEGREES, w, angular=True)),
        "pst_angular_gravity_r": weighted(lambda n, w: m.pst_gravity(n, DEGREES, w, angular=True)),
        "pst_mean_angular_distance_r": weighted(lambda n, w: m.pst_mean_distance(n, DEGREES, w, angular=True)),
        **{f"pst_angular_{name}_r": on_grid(lambda n, name=name: m.pst_angular(n, name, pst)) for name in m._PST},
        "dmx_integration_r": on_grid(lambda n: m.dmx_integration(n, RADIUS)),
        "dmx_choice_r": on_grid(lambda n: m.dmx_choice(n, RADIUS)),
        "dmx_angular_integration_r": on_grid(lambda n: m.angular_integration(n, RADIUS)),
        "dmx_angular_choice_r": on_grid(lambda n: m.angular_trail_choice(n, RADIUS)),
        "angular_integration_r": on_grid(lambda n: m.angular_integration(n, RADIUS, 1.0)),
        "angular_nain_r": on_grid(lambda n: m.angular_nain(n, RADIUS)),
        "angular_choice_r": on_grid(lambda n: m.angular_choice(n, RADIUS)),
        "angular_nach_r": on_grid(lambda n: m.angular_nach(n, RADIUS)),
        "cityseer_harmonic_r": on_grid(lambda n: m.cityseer_harmonic(n, RADIUS)),
        "cityseer_betweenness_r": on_grid(lambda n: m.cityseer_betweenness(n, RADIUS)),
        "analysis_columns_r400": columns_of_a_session,
        "route_metric": route_query("metric"),
        "route_angular": route_query("angular"),
        "route_vector_angle": route_query("vectorAngle"),
        "route_vector_metric": route_query("vectorMetric"),
        "canonicalize_edges": canonicalize_edges,
        "canonicalize_hits": canonicalize_hits,
        "canonicalize_segments": canonicalize_segments,
        "canonicalize_metadata": canonicalize_metadata,
        "unlink_mask_skips": unlink_mask_skips,
        "normalize_coords": normalize_coords,
        "extent": extent,
        "mif_parse": mif_parse,
        "mid_parse": mid_parse,
        "geojson_roundtrip": geojson_roundtrip,
        "flatgeobuf_roundtrip": flatgeobuf_roundtrip,
        "feature_folder_roundtrip": feature_folder_roundtrip,
        "segment_csv_network": segment_csv_network,
        "columnar_init": columnar_init,
        "feature_parts": feature_parts,
        "mif_features": mif_features,
        "mif_unlink_masks": mif_unlink_masks,
        "canonicalize_bent": canonicalize_bent,
        "canonicalize_bent_metadata": canonicalize_bent_metadata,
        "path_from_node": path_from_node,
        "on_demand_primal": on_demand_primal,
        "method_catalog": lambda spark, _: catalog.method_catalog(spark).select("method", "measure", "radius", "column", "on_demand"),
        "allowed_columns": lambda spark, _: spark.createDataFrame([(c,) for c in catalog.allowed_columns()], "column string"),
        "compare_columns": compare,
        "row_hash": lambda spark, sf_dir: row_hash_frame(grid_network(spark, sf_dir)),
    }


# SQL of the same rows

_NET = (
    GRID_SQL.strip().replace("WITH n AS", "WITH RECURSIVE n AS", 1)
    + """,
node AS (SELECT source AS node FROM seg UNION SELECT target FROM seg),
prim AS (SELECT source AS a, target AS b, segment_index AS s, length_m AS w FROM seg UNION ALL SELECT target, source, segment_index, length_m FROM seg),
inc AS (SELECT source AS node, segment_index AS s, 0 AS e, length_m AS w, x0 AS hx, y0 AS hy, x1 AS fx, y1 AS fy FROM seg
        UNION ALL SELECT target, segment_index, 1, length_m, x1, y1, x0, y0 FROM seg),
dual AS (SELECT p.s AS a, q.s AS b, p.node, p.w AS wa, q.w AS wb, p.e AS ea, q.e AS eb,
                CASE WHEN (p.fx - p.hx) * (q.fx - p.hx) + (p.fy - p.hy) * (q.fy - p.hy) = 0 THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END AS turn
         FROM inc p JOIN inc q ON p.node = q.node AND p.s <> q.s),
q AS (SELECT l_suppkey AS source, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
wt AS (SELECT segment_index AS s, coalesce(weight, 0.0) AS weight FROM seg LEFT JOIN q USING (source))
"""
)


def _node_distances(radius: float, step: str = "e.w") -> str:
    return f""",
walk AS (SELECT node AS root, node, 0.0::DOUBLE AS d FROM node UNION
         SELECT r.root, e.b, r.d + {step} FROM walk r JOIN prim e ON e.a = r.node WHERE r.d + {step} <= {radius}),
dist AS (SELECT root, node, min(d) AS d FROM walk GROUP BY ALL)
"""


def _from_node(step: str) -> str:
    """Least distances from node 0 without a bound: a row for each node, which a shorter way replaces."""
    return f""",
walk(node, distance) USING KEY (node) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION
  SELECT p.b, min(v.distance + {step}) FROM walk v JOIN prim p ON p.a = v.node LEFT JOIN recurring.walk r ON r.node = p.b
  WHERE r.node IS NULL OR v.distance + {step} < r.distance GROUP BY p.b)
SELECT node, distance FROM walk
"""


def _centre_distances(weight: str, radius: float) -> str:
    return f""",
link AS (SELECT a, b, min({weight}) AS w FROM dual GROUP BY ALL),
walk AS (SELECT segment_index AS root, segment_index AS node, 0.0::DOUBLE AS d FROM seg UNION
         SELECT r.root, e.b, r.d + e.w FROM walk r JOIN link e ON e.a = r.node WHERE r.d + e.w <= {radius}),
dist AS (SELECT root, node, min(d) AS d FROM walk GROUP BY ALL)
"""


def _paths(edges: str, start: str) -> str:
    return f""",
way AS (SELECT {start} AS root, {start} AS node, 0.0::DOUBLE AS d FROM {"node" if start == "node" else "seg"} UNION ALL
        SELECT p.root, e.b, p.d + e.w FROM way p JOIN {edges} e ON e.a = p.node JOIN dist t ON t.root = p.root AND t.node = e.b AND t.d = p.d + e.w),
sig AS (SELECT root, node, d, count(*)::DOUBLE AS n FROM way GROUP BY ALL)
"""


_BETWEEN = """
SELECT {key}, round(coalesce(value, 0.0), 6) AS value FROM {table} LEFT JOIN (
  SELECT v.node AS ref, sum(v.n * t.n / st.n) / 2 AS value
  FROM sig st JOIN sig v ON v.root = st.root AND v.node <> st.root AND v.node <> st.node
  JOIN sig t ON t.root = v.node AND t.node = st.node AND v.d + t.d = st.d
  WHERE st.root <> st.node GROUP BY v.node) ON ref = {key}
"""

_ALONG = """
SELECT segment_index, round(coalesce(value, 0.0) * {factor}, 6) AS value FROM seg LEFT JOIN (
  SELECT e.s AS ref, sum(u.n * t.n / st.n) AS value
  FROM sig st JOIN sig u ON u.root = st.root JOIN prim e ON e.a = u.node
  JOIN sig t ON t.root = e.b AND t.node = st.node AND u.d + e.w + t.d = st.d
  WHERE st.root <> st.node GROUP BY e.s) ON ref = segment_index
"""

_LINES = """
WITH line AS (
  SELECT r_regionkey::BIGINT AS line, 'r' || r_regionkey AS id, true AS across, (10 * r_regionkey + 5)::DOUBLE AS pos, 100.0::DOUBLE AS size, 200.0::DOUBLE AS reported FROM region
  UNION ALL SELECT (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1, 'n' || n_nationkey, false, (4 * n_nationkey + 2)::DOUBLE, 60.0, 60.0 FROM nation),
hit AS (SELECT h.line AS line_a, v.pos AS at_a, v.line AS line_b, h.pos AS at_b, v.pos AS x, h.pos AS y FROM line h JOIN line v ON h.across AND NOT v.across),
cut AS (SELECT line, 0.0::DOUBLE AS d FROM line UNION SELECT line, size FROM line UNION SELECT line_a, at_a FROM hit UNION SELECT line_b, at_b FROM hit),
piece AS (SELECT line, d AS d0, lead(d) OVER (PARTITION BY line ORDER BY d) AS d1 FROM cut),
p AS (
  SELECT row_number() OVER (ORDER BY line, d0) - 1 AS segment_index, id, reported * (d1 - d0) / size AS length_m,
         CASE WHEN across THEN d0 ELSE pos END AS x0, CASE WHEN across THEN pos ELSE d0 END AS y0,
         CASE WHEN across THEN d1 ELSE pos END AS x1, CASE WHEN across THEN pos ELSE d1 END AS y1
  FROM piece JOIN line USING (line) WHERE d1 IS NOT NULL),
ends AS (SELECT x0 AS x, y0 AS y, 2 * segment_index AS seen FROM p UNION ALL SELECT x1, y1, 2 * segment_index + 1 FROM p),
nodes AS (SELECT x, y, row_number() OVER (ORDER BY min(seen)) - 1 AS node FROM ends GROUP BY x, y)
"""

_BENT = """
WITH line AS (
  SELECT r_regionkey::BIGINT AS line, 'r' || r_regionkey AS id, 'r' AS kind, (10 * r_regionkey + 5)::DOUBLE AS pos, 102.0::DOUBLE AS size, 204.0::DOUBLE AS reported FROM region
  UNION ALL SELECT (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1, 'n' || n_nationkey, 'n', (4 * n_nationkey)::DOUBLE, 52.0, 52.0 FROM nation
  UNION ALL SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation), 't', 't', 50.0, 4.0, 4.0),
hit AS (SELECT h.line AS line_a, v.pos + 1 AS at_a, v.line AS line_b, CASE WHEN v.kind = 'n' THEN h.pos ELSE 0.0 END AS at_b, v.pos = 8 AND h.pos = 15 AS skipped
        FROM line h JOIN line v ON h.kind = 'r' AND (v.kind = 'n' AND h.pos < 50 OR v.kind = 't' AND h.pos = 5)),
cut AS (SELECT line, 0.0::DOUBLE AS d FROM line UNION SELECT line, size FROM line UNION SELECT line_a, at_a FROM hit WHERE NOT skipped UNION SELECT line_b, at_b FROM hit WHERE NOT skipped),
piece AS (SELECT line, d AS d0, lead(d) OVER (PARTITION BY line ORDER BY d) AS d1 FROM cut),
whole AS (SELECT *, (d0 = 0 OR d1 = size) AND (d1 - d0) / size < 0.06 AS stub FROM piece JOIN line USING (line) WHERE d1 IS NOT NULL),
p AS (
  SELECT row_number() OVER (ORDER BY line, d0) - 1 AS segment_index, id, reported * (d1 - d0) / size AS length_m,
         CASE kind WHEN 'r' THEN d0 - 1 WHEN 'n' THEN pos + greatest(d0 - 50, 0) ELSE pos END AS x0, CASE kind WHEN 'r' THEN pos WHEN 'n' THEN least(d0, 50) ELSE 5 + d0 END AS y0,
         CASE kind WHEN 'r' THEN d1 - 1 WHEN 'n' THEN pos + greatest(d1 - 50, 0) ELSE pos END AS x1, CASE kind WHEN 'r' THEN pos WHEN 'n' THEN least(d1, 50) ELSE 5 + d1 END AS y1,
         CASE WHEN kind = 'n' AND d0 < 50 AND d1 > 50 THEN 3 ELSE 2 END AS points
  FROM whole WHERE NOT stub),
ends AS (SELECT x0 AS x, y0 AS y, 2 * segment_index AS seen FROM p UNION ALL SELECT x1, y1, 2 * segment_index + 1 FROM p),
nodes AS (SELECT x, y, row_number() OVER (ORDER BY min(seen)) - 1 AS node FROM ends GROUP BY x, y)
"""

#: The 64-bit FNV-1a hash over the bytes of an ASCII text, modulo 2^64 after every step.
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(t, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


def oracle_sql() -> dict[str, str]:
    metric, hops = _node_distances(RADIUS), _node_distances(HOPS, "1.0")
    centre, turns = _centre_distances("(wa + wb) / 2", RADIUS), _centre_distances("turn", DEGREES)
    others = "FROM node LEFT JOIN (SELECT root, node AS other, d FROM dist WHERE d > 0) ON root = node GROUP BY node"

    def fold(value: str, where: str = "true") -> str:
        return f" SELECT segment_index, round(coalesce(value, 0.0), 6) AS value FROM seg LEFT JOIN (SELECT root, {value} AS value FROM dist JOIN wt ON wt.s = dist.node JOIN seg t ON t.segment_index = dist.node WHERE {where} GROUP BY root) ON root = segment_index"

    columns = ", ".join(f"('{method}', '{measure}', {str((method, measure) in catalog.ON_DEMAND).lower()})" for method, measure in catalog.LABELS)
    radii = f"FROM (VALUES {columns}) t(method, measure, on_demand) CROSS JOIN (SELECT unnest([{', '.join(map(str, catalog.RADII))}])::BIGINT AS radius)"
    name = "method || '_' || measure || '_r' || radius"
    state = "2 * a + 1 - ea AS from_state, 2 * b + eb AS to_state"
    farness = "round(coalesce(sum(d), 0.0), 6)"
    return {
        "segments_valid": _NET + " SELECT segment_index, source, target, length_m, x0, y0, x1, y1 FROM seg",
        "node_ids": _NET + " SELECT node FROM node",
        "node_index": _NET + " SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_index FROM node",
        "primal_edges": _NET + " SELECT a AS from_node, b AS to_node, s AS segment_index, s AS segment_id, w AS weight FROM prim",
        "dual_edges": _NET + " SELECT a AS from_segment, b AS to_segment, node AS via_node, wb AS weight FROM dual",
        "center_edges_metric": _NET + " SELECT a AS from_segment, b AS to_segment, node AS via_node, (wa + wb) / 2 AS weight FROM dual",
        "center_edges_angular": _NET + " SELECT a AS from_segment, b AS to_segment, node AS via_node, turn AS weight FROM dual",
        "center_edges_sdna": _NET + " SELECT a AS from_segment, b AS to_segment, node AS via_node, turn AS weight FROM dual",
        "angular_state_edges": _NET + f" SELECT {state}, turn AS turn_degrees, wa / 2 + wb / 2 AS step_length FROM dual",
        "node_degree": _NET + " SELECT a AS node, count(*) AS value FROM prim GROUP BY a",
        "segment_degree": _NET + " SELECT segment_index, count(DISTINCT b) AS value FROM seg LEFT JOIN dual ON a = segment_index GROUP BY ALL",
        "line_curvature": _NET + " SELECT segment_index, 0.0::DOUBLE AS value FROM seg",
        "node_components": _NET + ", lab AS (SELECT node, node AS l FROM node UNION SELECT b, l FROM lab JOIN prim ON a = node) SELECT node, dense_rank() OVER (ORDER BY min(l)) - 1 AS value FROM lab GROUP BY node",
        "segment_components": _NET + ", lab AS (SELECT node, node AS l FROM node UNION SELECT b, l FROM lab JOIN prim ON a = node), comp AS (SELECT node, dense_rank() OVER (ORDER BY min(l)) - 1 AS value FROM lab GROUP BY node) SELECT segment_index, value FROM seg JOIN comp ON source = node",
        "dijkstra_from_node": _NET + _from_node("w"),
        "bfs_from_node": _NET + _from_node("1.0"),
        "relaxed_distances_r": _NET + metric + " SELECT root, node, d AS distance FROM dist",
        "centre_distances_r": _NET + centre + " SELECT root, node AS segment_index, d AS distance FROM dist",
        "reach_r": _NET + metric + f" SELECT node, count(d) AS value {others}",
        "farness_r": _NET + metric + f" SELECT node, {farness} AS value {others}",
        "harmonic_r": _NET + metric + f" SELECT node, round(coalesce(sum(1 / d), 0.0), 6) AS value {others}",
        "mean_depth_r": _NET + metric + f" SELECT node, round(coalesce(avg(d), 0.0), 6) AS value {others}",
        "reach_topological_r": _NET + hops + f" SELECT node, count(d) AS value {others}",
        "farness_topological_r": _NET + hops + f" SELECT node, {farness} AS value {others}",
        "primal_integration_r": _NET + metric + f", h AS (SELECT node, coalesce(sum(1 / d), 0.0) AS value {others}) SELECT segment_index, round((p.value + t.value) / 2, 6) AS value FROM seg JOIN h p ON p.node = source JOIN h t ON t.node = target",
        "node_betweenness_r": _NET + metric + _paths("prim", "node") + _BETWEEN.format(key="node", table="node"),
        "node_betweenness_topological_r": _NET + hops + ", hop AS (SELECT a, b, 1.0::DOUBLE AS w FROM prim)" + _paths("hop", "node") + _BETWEEN.format(key="node", table="node"),
        "segment_betweenness_r": _NET + metric + _paths("prim", "node") + _ALONG.format(factor=0.5),
        "primal_choice_r": _NET + metric + _paths("prim", "node") + _ALONG.format(factor=1.0),
        "sdna_mean_distance_r": _NET + centre + fold("avg(d)", "root <> dist.node"),
        "sdna_links_r": _NET + centre + fold("count(*)::DOUBLE"),
        "sdna_length_r": _NET + centre + fold("sum(length_m)"),
        "sdna_weight_r": _NET + centre + fold("sum(weight)"),
        "sdna_betweenness_r": _NET + centre + _paths("link", "segment_index") + _BETWEEN.format(key="segment_index", table="seg"),
        "sdna_angular_mean_distance_r": _NET + turns + fold("avg(d)"),
        "pst_reach_r": _NET + centre + fold("sum(weight)"),
        "pst_gravity_r": _NET + centre + fold("sum(weight / CASE WHEN d = 0 THEN 1 ELSE d END)"),
        "pst_mean_distance_r": _NET + centre + fold("sum(d * weight) / nullif(sum(weight), 0)"),
        "pst_angular_reach_r": _NET + turns + fold("sum(weight)"),
        "pst_angular_gravity_r": _NET + turns + fold("sum(weight / CASE WHEN d = 0 THEN 1 ELSE d END)"),
        "pst_mean_angular_distance_r": _NET + turns + fold("sum(d * weight) / nullif(sum(weight), 0)"),
        "canonicalize_edges": _LINES + " SELECT line, CASE WHEN across THEN 0.0 ELSE pos END AS ax, CASE WHEN across THEN pos ELSE 0.0 END AS ay, CASE WHEN across THEN size ELSE pos END AS bx, CASE WHEN across THEN pos ELSE size END AS by, 0.0::DOUBLE AS base, size AS len FROM line",
        "canonicalize_hits": _LINES + " SELECT line_a, at_a, line_b, at_b, x, y FROM hit",
        "canonicalize_segments": _LINES + " SELECT segment_index, s.node AS source, t.node AS target, round(length_m, 6) AS length_m, x0, y0, x1, y1, id AS original_feature_id FROM p JOIN nodes s ON s.x = x0 AND s.y = y0 JOIN nodes t ON t.x = x1 AND t.y = y1",
        "canonicalize_metadata": _LINES + " SELECT (SELECT count(*) FROM line) AS input_feature_count, (SELECT count(*) FROM line) AS input_line_count, (SELECT count(*) FROM hit) AS intersections_split, 0::BIGINT AS intersections_skipped_by_unlink, 0::BIGINT AS zero_length_discarded, 0::BIGINT AS discarded_end_stubs, (SELECT count(*) FROM p) AS output_segment_count, (SELECT count(*) FROM nodes) AS node_count, (SELECT round(sum(length_m), 6) FROM p) AS total_length_m",
        "unlink_mask_skips": _LINES + " SELECT line_a, line_b, EXISTS (SELECT 1 FROM region WHERE sqrt((x - 10 * r_regionkey) ** 2 + (y - 10 * r_regionkey - 5) ** 2) <= 4.5) AS skipped FROM hit",
        "normalize_coords": _LINES + ", pts AS (SELECT id, 0::BIGINT AS n, CASE WHEN across THEN 0.0 ELSE pos END AS x, CASE WHEN across THEN pos ELSE 0.0 END AS y FROM line UNION ALL SELECT id, 1, CASE WHEN across THEN size ELSE pos END, CASE WHEN across THEN pos ELSE size END FROM line), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts) SELECT id, n, round((x - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0), 6)::DOUBLE AS x, round((y - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0), 6)::DOUBLE AS y FROM pts, b",
        "extent": _LINES + " SELECT least(min(pos) FILTER (NOT across), 0.0)::DOUBLE AS min_x, least(min(pos) FILTER (across), 0.0)::DOUBLE AS min_y, greatest(max(pos) FILTER (NOT across), max(size) FILTER (across))::DOUBLE AS max_x, greatest(max(pos) FILTER (across), max(size) FILTER (NOT across))::DOUBLE AS max_y FROM line",
        "mif_parse": _NET + " SELECT segment_index AS row, x0, y0, x1, y1, 'Road, no. ' || segment_index AS name, length_m FROM seg",
        "mid_parse": _NET + " SELECT segment_index AS row, 'Road, no. ' || segment_index AS name, length_m FROM seg",
        "geojson_roundtrip": _NET + " SELECT segment_index, segment_index AS segment_id, source, target, length_m, x0, y0, x1, y1 FROM seg",
        "flatgeobuf_roundtrip": _NET + " SELECT segment_index, segment_index AS segment_id, source, target, length_m, x0, y0, x1, y1 FROM seg",
        "feature_folder_roundtrip": _NET + " SELECT segment_index, segment_index AS segment_id, source, target, length_m, x0, y0, x1, y1 FROM seg",
        "segment_csv_network": _NET + ", seen AS (SELECT x0 AS x, y0 AS y, 2 * segment_index AS met FROM seg UNION ALL SELECT x1, y1, 2 * segment_index + 1 FROM seg), nn AS (SELECT x, y, row_number() OVER (ORDER BY min(met)) - 1 AS node FROM seen GROUP BY x, y) SELECT segment_index, s.node AS source, t.node AS target, length_m, x0, y0, x1, y1 FROM seg JOIN nn s ON s.x = x0 AND s.y = y0 JOIN nn t ON t.x = x1 AND t.y = y1",
        "columnar_init": """
WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_nationkey AS n, n_regionkey AS r, n_nationkey % 3 <> 0 AS there, n_nationkey + 1.5::DOUBLE AS w FROM nation)
SELECT i AS segment_index, n::BIGINT AS source, 100 + r::BIGINT AS target, w AS length_m, CASE WHEN there THEN n::DOUBLE END AS x0, CASE WHEN there THEN n::DOUBLE END AS y0, CASE WHEN there THEN r::DOUBLE END AS x1, CASE WHEN there THEN r::DOUBLE END AS y1,
       CASE WHEN there THEN n ELSE 0 END::DOUBLE AS ax, CASE WHEN there THEN n ELSE i END::DOUBLE AS ay, CASE WHEN there THEN r ELSE w END::DOUBLE AS bx, CASE WHEN there THEN r ELSE i END::DOUBLE AS by FROM r""",
        "feature_parts": """
WITH r AS (SELECT n_nationkey AS n, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS part, count(*) OVER (PARTITION BY n_regionkey) AS parts FROM nation),
f AS (SELECT n_regionkey AS r, row_number() OVER (ORDER BY n_regionkey) - 1 AS feature_index FROM nation GROUP BY n_regionkey)
SELECT feature_index, part, 'r' || r || CASE WHEN r % 2 = 0 AND parts > 1 THEN ':' || part ELSE '' END AS id, 3::BIGINT AS points, (n + 2)::DOUBLE AS x, (r + 1)::DOUBLE AS y, r::VARCHAR AS kind FROM r JOIN f USING (r) WHERE r % 2 = 0 OR part = 0""",
        "mif_features": _NET + " SELECT segment_index AS feature_index, segment_index::VARCHAR AS id, x0, y0, x1, y1, 'Road, no. ' || segment_index AS name FROM seg",
        "mif_unlink_masks": _NET + " SELECT (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, round(greatest(2.0::DOUBLE, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 2 + 2), 6) AS radius FROM seg",
        "canonicalize_bent": _BENT + " SELECT segment_index, s.node AS source, t.node AS target, round(length_m, 6) AS length_m, x0, y0, x1, y1, points::BIGINT AS points, id AS original_feature_id FROM p JOIN nodes s ON s.x = x0 AND s.y = y0 JOIN nodes t ON t.x = x1 AND t.y = y1",
        "canonicalize_bent_metadata": _BENT + " SELECT (SELECT count(*) FROM line) AS input_feature_count, (SELECT count(*) FROM line) AS input_line_count, (SELECT count(*) FROM hit WHERE NOT skipped) AS intersections_split, (SELECT count(*) FROM hit WHERE skipped) AS intersections_skipped_by_unlink, 0::BIGINT AS zero_length_discarded, (SELECT count(*) FROM whole WHERE stub) AS discarded_end_stubs, (SELECT count(*) FROM p) AS output_segment_count, (SELECT count(*) FROM nodes) AS node_count, (SELECT round(sum(length_m), 6) FROM p) AS total_length_m",
        "path_from_node": _NET + _from_node("w").replace("SELECT node, distance FROM walk", "SELECT node, distance, distance AS along FROM walk ORDER BY distance DESC, node DESC LIMIT 1"),
        "on_demand_primal": _NET + metric + f", h AS (SELECT node, coalesce(sum(1 / d), 0.0) AS value {others}) SELECT segment_index, round((p.value + t.value) / 2, 6) AS value FROM seg JOIN h p ON p.node = source JOIN h t ON t.node = target WHERE segment_index < 3",
        "row_hash": _NET + f", x AS (SELECT string_agg(segment_index || '|' || source || '|' || target || '|' || printf('%.6f', length_m) || chr(10), '' ORDER BY segment_index) AS t FROM seg) SELECT lower(lpad(to_hex(({_FNV})::UBIGINT), 16, '0')) AS row_hash, (SELECT count(*) FROM seg) AS feature_count FROM x",
        "method_catalog": f"SELECT method, measure, radius, {name} AS \"column\", on_demand {radii}",
        "allowed_columns": f"SELECT {name} AS \"column\" {radii}",
        "compare_columns": """
WITH p AS (SELECT s_suppkey AS row, floor(s_acctbal::DOUBLE / 100) AS reference, floor(abs(s_acctbal::DOUBLE) / 250) AS engine FROM supplier),
r AS (SELECT *, rank() OVER (ORDER BY reference) + (count(*) OVER (PARTITION BY reference) - 1) / 2.0 AS rr, rank() OVER (ORDER BY engine) + (count(*) OVER (PARTITION BY engine) - 1) / 2.0 AS re,
      row_number() OVER (ORDER BY reference DESC, row) AS pr, row_number() OVER (ORDER BY engine DESC, row) AS pe, ceil(count(*) OVER () * 0.1) AS top, abs(reference - engine) AS d FROM p)
SELECT count(*) AS count, round(corr(reference, engine), 6) AS pearson, round(corr(rr, re), 6) AS spearman, round(avg(d), 6) AS mean_absolute_difference, round(median(d), 6) AS median_absolute_difference,
       max(d) AS max_absolute_difference, count(*) FILTER (d = 0) AS exact_matches, round(count(*) FILTER (pr <= top AND pe <= top) / max(top), 6)::DOUBLE AS top_decile_overlap FROM r""",
    }



def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach, farness, harmonic closeness and mean depth of every node of the derived network."""
    return rounded(m.distance_folds(grid_network(spark, sf_dir), RADIUS))
