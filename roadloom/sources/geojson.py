"""GeoJSON feature collections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.plans.network import NetworkError, RoadNetwork
from roadloom.schema import SEGMENTS

_OPTIONAL = ("x0", "y0", "x1", "y1")
_TEXT = ("source_dataset", "cleaning_profile", "original_feature_id")

#: Features stay text until their kind is known: coordinates nest differently for lines and multi-lines.
_COLLECTION = "type string, features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>, metadata string"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _features(texts: DataFrame) -> DataFrame:
    """(feature_index, id, kind, coordinates, properties) of collections in a column ``value``."""
    parsed = texts.select(F.from_json("value", _COLLECTION, {"mode": "FAILFAST", "allowNumericLeadingZeros": "true"}).alias("c"))
    if parsed.where("c.type is null or c.type != 'FeatureCollection' or c.features is null").limit(1).count():
        raise NetworkError("Expected a GeoJSON FeatureCollection.")
    return parsed.select(F.posexplode("c.features").alias("feature_index", "f")).select(
        F.col("feature_index").cast("bigint"), F.col("f.id").alias("id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")
    )


def _points(pairs):
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def features_of(texts: DataFrame) -> DataFrame:
    """``schema.FEATURES`` of collections of lines and multi-lines; other geometries are refused."""
    f = _features(texts)
    if f.where("kind is null or kind not in ('LineString', 'MultiLineString')").limit(1).count():
        raise NetworkError("Only LineString and MultiLineString features are supported.")
    single = F.array(_points(F.from_json("coordinates", "array<array<double>>")))
    many = F.transform(F.from_json("coordinates", "array<array<array<double>>>"), _points)
    return f.select("feature_index", F.coalesce("id", F.col("feature_index").cast("string")).alias("id"), F.when(F.col("kind") == "LineString", single).otherwise(many).alias("parts"), "properties")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return features_of(_documents(spark, path))


def flattened(features: DataFrame) -> DataFrame:
    """One feature per part: id ``<id>:<part>`` where there are several kinds of parts, the id itself for a single line."""
    many = F.size("parts") > 1
    parts = features.select("feature_index", F.coalesce("id", F.col("feature_index").cast("string")).alias("id"), many.alias("many"), F.posexplode("parts").alias("part", "points"), "properties")
    return parts.select("feature_index", "part", F.when(F.col("many"), F.concat_ws(":", "id", F.col("part").cast("string"))).otherwise(F.col("id")).alias("id"), "points", "properties")


def network_of(texts: DataFrame) -> RoadNetwork:
    """The segment graph of collections as ``to_geojson`` writes them; source, target and length_m are needed."""
    f = _features(texts)
    if f.where("kind is null or kind != 'LineString'").limit(1).count():
        raise NetworkError("Segments must be LineString features.")
    p = F.col("properties")
    number = lambda c: F.expr(f"try_cast(trim(properties['{c}']) as double)")
    missing = [c for c in ("source", "target", "length_m") if f.where(number(c).isNull()).limit(1).count()]
    if missing:
        raise NetworkError(f"Feature property {missing[0]} must be numeric.")
    columns = {
        "segment_index": F.col("feature_index"),
        "segment_id": F.coalesce(number("segment_id"), F.expr("try_cast(id as double)"), F.col("feature_index").cast("double")).cast("bigint"),
        "source": number("source").cast("bigint"),
        "target": number("target").cast("bigint"),
        "length_m": number("length_m"),
        "geometry": _points(F.from_json("coordinates", "array<array<double>>")),
        **{c: number(c) for c in _OPTIONAL},
        **{c: p[c] for c in _TEXT},
        "component_id": number("component_id").cast("bigint"),
    }
    held = texts.select(F.get_json_object("value", "$.metadata").alias("m")).where("m is not null").first()
    return RoadNetwork(f.select(*(c.alias(n) for n, c in columns.items())), json.loads(held["m"]) if held else {}).validate()


def read_network(spark: SparkSession, path: str) -> RoadNetwork:
    """GeoJSON, or FlatGeobuf by its suffix."""
    if path.lower().endswith(".fgb"):
        from roadloom.sources.flatgeobuf import read_flatgeobuf

        return read_flatgeobuf(spark, path)
    return network_of(_documents(spark, path))


def feature_lines(network: RoadNetwork) -> DataFrame:
    """(segment_index, feature) each segment as the JSON text of a feature; absent fields are left out."""
    s = network.segments
    properties = F.struct("segment_id", "source", "target", "length_m", *_OPTIONAL, *_TEXT, "component_id")
    line = F.struct(F.lit("LineString").alias("type"), F.transform("geometry", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return s.select("segment_index", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("segment_id").alias("id"), line.alias("geometry"), properties.alias("properties"))).alias("feature"))


def to_geojson(network: RoadNetwork) -> str:
    """One collection as text, for networks that fit the driver; ``write_features`` scales."""
    rows = feature_lines(network).orderBy("segment_index").toLocalIterator()
    metadata = f', "metadata": {json.dumps(network.metadata)}' if network.metadata else ""
    return '{"type": "FeatureCollection"' + metadata + ', "features": [' + ",\n".join(r["feature"] for r in rows) + "]}"


def write_features(network: RoadNetwork, path: str) -> None:
    """A folder of newline-delimited features in order of segment_index, written by all executors."""
    feature_lines(network).orderBy("segment_index").select("feature").write.mode("overwrite").text(path)


def read_feature_lines(spark: SparkSession, path: str) -> RoadNetwork:
    """What ``write_features`` wrote; rows are numbered by segment_id."""
    from roadloom.plans.network import with_index

    nested = T.StructType([T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))])), T.StructField("properties", T.StructType([f for f in SEGMENTS.fields if f.name not in ("segment_index", "geometry")]))])
    rows = spark.read.schema(nested).json(path)
    rows = rows.select("properties.*", _points(F.col("geometry.coordinates")).alias("geometry"))
    return RoadNetwork(with_index(rows, "segment_id").select(*SEGMENTS.names))
