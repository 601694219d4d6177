"""Cutting lineage in loops."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors; a temporary one only where it names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share.")
        named = "file://" + os.path.join(tempfile.gettempdir(), "roadloom-checkpoints")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in that folder, removed when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the context has, else in ``folder``."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)
