"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.cluster import discard, met, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that joins two different nodes; root is the smallest node of the component.

    Each round hooks every node to its smallest neighbour if that is smaller, flattens the trees by
    pointer jumping and contracts the edges to roots, which at least halves the nodes that still have
    edges. All rounds are DataFrame joins on tables in the shared folder; what is joined to a hot root
    or the centre of a star is one row for each node that has another parent, broadcast if few and
    salted else (``met``). Loops, repeated edges and null ends are dropped; an empty table gives no rows.
    """
    ends = F.col(a), F.col(b)
    edges = edges.where(ends[0] != ends[1]).select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
    edges = stored(edges, "edges")
    mapping = None
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = stored(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "parents")
        while True:
            up = parents.where("node != root").select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = met(parents, up, "root", "node").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            jumped = stored(jumped, "jumped")
            discard(parents)
            parents = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        up = parents.where("node != root").select("node", F.col("root").alias("above"))
        if mapping is None:
            mapping = parents
        else:
            old, mapping = mapping, stored(met(mapping, up.withColumnRenamed("node", "root"), "root", "node").select("node", F.coalesce("above", "root").alias("root")), "mapping")
            discard(old)
        moved = met(edges, up.withColumnRenamed("node", "a"), "a", "b").select(F.coalesce("above", "a").alias("a"), "b")
        moved = met(moved, up.withColumnRenamed("node", "b"), "b", "a").select("a", F.coalesce("above", "b").alias("b"))
        old, edges = edges, stored(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(old)
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
