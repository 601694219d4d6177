"""Types and constants of the data model.

A network is a table with one row per segment. Row identity is ``segment_index``, the position of the
feature in its source: results are keyed by it, ties are broken by it, and it never depends on the
partitioning. An absent value is null; a measure that is undefined for a segment is NaN.
"""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)

SEGMENTS = T.StructType(
    [
        T.StructField("segment_index", T.LongType(), False),
        T.StructField("segment_id", T.LongType()),
        T.StructField("source", T.LongType()),
        T.StructField("target", T.LongType()),
        T.StructField("length_m", T.DoubleType()),
        T.StructField("geometry", LINE),
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("cleaning_profile", T.StringType()),
        T.StructField("original_feature_id", T.StringType()),
        T.StructField("component_id", T.LongType()),
    ]
)

FEATURES = T.StructType(
    [
        T.StructField("feature_index", T.LongType(), False),
        T.StructField("id", T.StringType()),
        T.StructField("parts", T.ArrayType(LINE)),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)

MASKS = T.StructType([T.StructField("cx", T.DoubleType()), T.StructField("cy", T.DoubleType()), T.StructField("radius", T.DoubleType())])

# Fixed values.
EPSILON = 1e-10
TIE = 1e-9
LENGTH_KEYS = ("length_m", "Line_Length", "Segment_Length", "line_length", "length", "Length", "LENGTH", "len", "LEN")
ANGULAR_BINS_SEMICIRCLE = 513
ANGULAR_DEPTH_SCALE = 256
METRIC_BUCKETS = 512
ROUTE_COST_TIE = 1e-6
RADII = tuple(range(400, 2001, 200))

#: A graph of at most this many segments is broadcast whole (about 100 bytes each); a larger one is cut into tiles.
BROADCAST_SEGMENTS = 2_000_000
