"""Searches on the JVM, for many roots or requests: ``searches.java``, compiled by the compiler that Spark brings along.

Each function has its twin in ``kernels``, which says what is found and in which order; tests hold them against each other.
"""

from __future__ import annotations

import math
import os
import pkgutil
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from roadloom.plans.network import RoadNetwork

CREDITS = "at bigint, credit double"
ROUTES = "from_segment bigint, to_segment bigint, mode string, found boolean, segment_indexes array<bigint>, distance_m double, angular_cost double, vector_cost double"
_CHUNK = 4096
_compiled: dict[str, object] = {}


def _registered(spark: SparkSession, returns: str) -> str:
    """The name of the function in this session; its class reaches the executors as a jar."""
    context, jvm = spark.sparkContext, spark._jvm
    if context.applicationId not in _compiled:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
        compiler.cook(pkgutil.get_data("roadloom.operators", "searches.java").decode())
        path = os.path.join(tempfile.mkdtemp(), "roadloom-searches.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(path)
        none = context._gateway.new_array(jvm.java.lang.Class, 0)
        _compiled.clear()
        _compiled[context.applicationId] = compiler.getClassLoader().loadClass("roadloom.Searches").getDeclaredConstructor(none).newInstance(context._gateway.new_array(jvm.java.lang.Object, 0))
    name = "roadloom_credits" if returns == CREDITS else "roadloom_routes"
    kind = spark._jsparkSession.parseDataType(_parse_datatype_string(f"array<struct<{returns.replace(' ', ':').replace(',:', ',')}>>").json())
    spark._jsparkSession.udf().register(name, _compiled[context.applicationId], kind)
    return name


def packed(network: RoadNetwork, options: bytes = b"") -> DataFrame:
    """One row with the graph's columns and the options as bytes."""
    table = network.graph.value
    whole = lambda c: table[c].cast(pa.int64()).fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes()
    real = lambda c: table[c].cast(pa.float64()).fill_null(math.nan).to_numpy().astype("<f8")
    ends = [real(c) for c in ("ax", "ay", "bx", "by")]
    columns = [whole("segment_index"), whole("source"), whole("target"), real("length_m").tobytes(), *(e.tobytes() for e in ends), real("curvature").tobytes()]
    return network.spark.createDataFrame([(bytearray(b"".join(columns)), bytearray(options))], "graph binary, options binary")


def _run(network: RoadNetwork, rows: DataFrame, task: Column, options: bytes, returns: str, chunk: int, together: str | None = None) -> DataFrame:
    """Rows of the function for the numbers in the columns of ``rows`` (first, second, mode), dealt to all cores, a chunk at a time; near ones of ``together`` in one."""
    names = rows.columns

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        for batch in batches:
            for column, values in zip(held, batch.columns, strict=True):
                column.extend(values.to_pylist())
            while len(held[0]) >= chunk:
                yield pa.RecordBatch.from_arrays([pa.array([c[:chunk]], pa.list_(t)) for c, t in zip(held, batch.schema.types, strict=True)], names)
                held = [c[chunk:] for c in held]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(t)) for c, t in zip(held, batch.schema.types, strict=True)], names)

    schema = ", ".join(f"{name} array<{kind}>" for name, kind in rows.dtypes)
    spread = 4 * network.spark.sparkContext.defaultParallelism
    if together is None or rows.isStreaming:
        dealt = rows.repartition(spread, *names)
    else:
        order = [together, *(name for name in names if name != together)]
        dealt = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order)
    gathered = dealt.mapInArrow(gather, schema).crossJoin(F.broadcast(packed(network, options)))
    found = F.call_udf(_registered(network.spark, returns), task, F.col("graph"), F.col(names[0]), F.col(names[min(1, len(names) - 1)]), F.col("options"))
    return gathered.select(F.inline(found))


def credits(network: RoadNetwork, roots: DataFrame, radius: float, own: list[float] | None, to: list[float] | None) -> DataFrame:
    """(at, credit): ``centre_search`` of each root in the column ``root`` over angles with curvatures, then ``first_path_credits``."""
    head = np.array([radius, own is not None, to is not None], "<f8").tobytes()
    options = head + b"".join(np.array(x, "<f8").tobytes() for x in (own, to) if x is not None)
    return _run(network, roots.select(F.col("root").cast("bigint").alias("root")), F.lit("credits"), options, CREDITS, 1 << 20)


def routes(network: RoadNetwork, requests: DataFrame, mode: str | None) -> DataFrame:
    """``node_route`` or ``angular_route`` of each request (from_segment, to_segment[, mode])."""
    task = F.lit(mode) if mode is not None else F.array_join("mode", ",", "None")
    # By angles one search serves all requests that lead to a node.
    return _run(network, requests, task, b"", ROUTES, _CHUNK, None if mode in ("metric", "angular") else "to_segment")
