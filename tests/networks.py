"""Tiny networks whose measures can be checked by hand."""

from roadloom.plans.network import from_columns


def make(spark, segments):
    """(source, target, length, x0, y0, x1, y1) rows."""
    return from_columns(spark, *(list(c) for c in zip(*segments, strict=True)))


def chain(spark, n, step=10.0):
    return make(spark, [(i, i + 1, step, step * i, 0.0, step * (i + 1), 0.0) for i in range(n)])


def cross(spark):
    return make(spark, [(0, 1, 10.0, 0.0, 0.0, 10.0, 0.0), (1, 2, 10.0, 10.0, 0.0, 20.0, 0.0), (1, 3, 10.0, 10.0, 0.0, 10.0, 10.0), (1, 4, 10.0, 10.0, 0.0, 10.0, -10.0)])


def right_angle(spark):
    return make(spark, [(0, 1, 10.0, 0.0, 0.0, 10.0, 0.0), (1, 2, 10.0, 10.0, 0.0, 10.0, 10.0)])


def square(spark):
    return make(spark, [(0, 1, 3.0, 0.0, 0.0, 3.0, 0.0), (1, 2, 3.0, 3.0, 0.0, 3.0, 3.0), (2, 3, 3.0, 3.0, 3.0, 0.0, 3.0), (3, 0, 3.0, 0.0, 3.0, 0.0, 0.0)])


def disconnected(spark):
    return make(spark, [(0, 1, 10.0, 0.0, 0.0, 10.0, 0.0), (1, 2, 10.0, 10.0, 0.0, 20.0, 0.0), (10, 11, 5.0, 100.0, 0.0, 105.0, 0.0)])


def values(df, key=None):
    key = key or df.columns[0]
    return [r["value"] for r in df.orderBy(key).collect()]
