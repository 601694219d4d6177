"""A fingerprint of the segments and their order."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame

from roadloom.plans.network import RoadNetwork

# Fixed values of the 64-bit FNV-1a hash.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
_SIX = Decimal("0.000001")


def fold(rows) -> str:
    """Hash of (id, source, target, length) rows in order: fields joined by bars, lengths with six decimals, a line feed after each."""
    value = BASIS
    for i, s, t, length in rows:
        text = f"{i}|{s}|{t}|{Decimal(length).quantize(_SIX, ROUND_HALF_UP)}\n"
        for byte in text.encode():
            value = (value ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{value:016x}"


def row_hash(network: RoadNetwork) -> str:
    """The fold is sequential by definition; rows stream to the driver in order, a partition at a time."""
    return fold((r["segment_id"], r["source"], r["target"], r["length_m"]) for r in network.segments.select("segment_index", "segment_id", "source", "target", "length_m").orderBy("segment_index").toLocalIterator(prefetchPartitions=True))


def row_hash_frame(network: RoadNetwork) -> DataFrame:
    return network.spark.createDataFrame([(row_hash(network), network.size[0])], "row_hash string, feature_count bigint")
