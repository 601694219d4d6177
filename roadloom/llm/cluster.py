"""Scratch space that every executor shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: the files survive the loss of any
executor, are compressed, and a re-read scan knows its size.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of a few numbers a row (8 to 40 bytes) is broadcast up to so many rows; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Parts of a hot key's rows that meet its one row of the other side apart.
SALTS = 16


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where the session names none and runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share.")
        root = "file://" + os.path.join(tempfile.gettempdir(), "roadloom-scratch")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{scratch_root(spark)}/roadloom/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` frame that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/roadloom/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def within(rows: DataFrame) -> DataFrame:
    """``rows``, marked for broadcast if they are few."""
    return F.broadcast(rows) if few(rows) else rows


def met(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Left join with a table of one row for each ``key``: broadcast if it is small; else rows of ``left`` are dealt apart by a hash of ``by``, so that a hot key is no single task's."""
    if few(right):
        return left.join(F.broadcast(right), key, "left")
    salt = fresh(left, "salt")
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return left.join(right, [key, salt], "left").drop(salt)
