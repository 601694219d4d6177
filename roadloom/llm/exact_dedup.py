"""Exact deduplication with a split of heavy hitters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.cluster import stored

#: Deleted before texts are compared (fixed value).
WHITE_SPACE = " \t\n\x0b\x0c\r"


class MisraGries:
    """At most ``size`` counters; a value with more than rows/(size+1) of the rows is always among them."""

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, values: list, counts: list[int]) -> None:
        held = self.counts
        for value, count in zip(values, counts, strict=True):
            held[value] = held.get(value, 0) + count
        if len(held) > self.size:
            cut = sorted(held.values(), reverse=True)[self.size]
            self.counts = {v: c - cut for v, c in held.items() if c > cut}


def heavy_values(df: DataFrame, column: str, counters: int) -> DataFrame:
    """Values of a binary column with over 2.2/counters of the rows, and maybe some with over 1/counters: at most ``counters`` rows.

    Each task sends a summary of at most ``counters`` values; the sums of the counters never exceed
    the true counts, so that no more than ``counters`` values can reach the limit.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, rows = MisraGries(counters), 0
        for batch in batches:
            rows += batch.num_rows
            found = pc.value_counts(batch.column(0))
            summary.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        if rows:
            least = rows / (8 * counters)  # what is below even here can't matter in the sum
            kept = {v: c for v, c in summary.counts.items() if v is not None and c >= max(2, least)}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64()), pa.array([0] * len(kept), pa.int64())], ["value", "n", "rows"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], ["value", "n", "rows"])

    found = df.select(column).mapInArrow(summaries, "value binary, n bigint, rows bigint").groupBy("value").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    found = stored(found, "heavy")
    total = found.where(F.col("value").isNull()).agg(F.sum("rows")).first()[0] or 0
    return found.where(F.col("value").isNotNull() & (F.col("n") >= max(2, total / counters))).select(F.col("value").alias(column))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; a null text is empty. Of equal texts
    the one with the most code points stays, then that with the smallest id (a null id is smallest).
    Rows repeated with the same id share one decision. An empty table gives no rows; other columns
    of ``df`` are not read.

    Digests held by a large share of the rows are found with Misra-Gries summaries; their verified
    winners (at most ``counters`` rows) are broadcast, so that hot groups are never shuffled. The
    other digests are grouped by an ordinary shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(F.translate(text, WHITE_SPACE, "").cast("binary"), 256)).alias("digest"),
        F.length(text).alias("n_chars"),
    )
    rows = stored(rows, "digests")
    heavy = stored(heavy_values(rows, "digest", counters), "heavy-digests")

    def winners(part: DataFrame) -> DataFrame:
        first = F.min(F.struct((-F.col("n_chars")).alias("order"), F.col("id").alias("keep_id")))
        return part.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("first.keep_id").alias("keep_id"), "group_size")

    hot = rows.join(F.broadcast(heavy), "digest", "left_semi")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    hot_winners = stored(winners(hot), "hot-winners")
    out = hot.join(F.broadcast(hot_winners), "digest").unionByName(rest.join(winners(rest), "digest"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
