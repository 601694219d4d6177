"""Geometry of lines as arrays of points, in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.schema import EPSILON


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def clean_points(points: Column | str) -> Column:
    """The points of which both ordinates are finite."""
    return F.filter(col(points), lambda p: finite(p["x"]) & finite(p["y"]))


def steps(points: Column | str) -> Column:
    """Length of each piece between neighbouring points."""
    points = col(points)
    n = F.size(points)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])),
    ).otherwise(F.array().cast("array<double>"))


def line_length(points: Column | str) -> Column:
    return F.aggregate(steps(points), F.lit(0.0), lambda total, d: total + d)


def cumulative(points: Column | str) -> Column:
    """Arc length from the first point to each point."""
    return F.aggregate(steps(points), F.array(F.lit(0.0)), lambda run, d: F.concat(run, F.array(F.element_at(run, -1) + d)))


def bearing(x0, y0, x1, y1) -> Column:
    """Direction from the first point to the second in degrees, 0 <= bearing < 360."""
    angle = F.atan2(col(y1) - col(y0), col(x1) - col(x0)) * 180 / math.pi
    return F.when(angle < 0, angle + 360).otherwise(angle)


def angle_between(a, b) -> Column:
    """Least angle between two bearings in degrees."""
    return F.abs((((col(b) - col(a)) % 360) + 540) % 360 - 180)


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Deflection in degrees on the way a, b, c: 180 for a way straight back, 90 where an arm has no length."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    first, second = F.hypot(ax - bx, ay - by), F.hypot(cx - bx, cy - by)
    cosine = ((ax - bx) * (cx - bx) + (ay - by) * (cy - by)) / F.nullif(first * second, F.lit(0.0))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when((ax == cx) & (ay == cy), 180.0).when((first == 0) | (second == 0), 90.0).otherwise(180 - F.acos(bounded) * 180 / math.pi)


def curvature(points: Column | str) -> Column:
    """Sum of the deflections at the inner points of a line."""
    points = col(points)
    inner = F.when(F.size(points) > 2, F.sequence(F.lit(2), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))

    def at(i):
        a, b, c = F.element_at(points, i - 1), F.element_at(points, i), F.element_at(points, i + 1)
        return turn(a["x"], a["y"], b["x"], b["y"], c["x"], c["y"])

    return F.aggregate(F.transform(inner, at), F.lit(0.0), lambda total, d: total + d)


def point_at(points: Column, run: Column, at: Column) -> Column:
    """The point at arc length ``at``; ``run`` is ``cumulative(points)``. The ends are returned as they are."""
    n = F.size(run)
    # The first piece that reaches so far, so that a point on a vertex is taken from the piece before it.
    index = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(2), n), lambda i: at <= F.element_at(run, i) + EPSILON)), n)
    a, b = F.element_at(points, index - 1), F.element_at(points, index)
    start, size = F.element_at(run, index - 1), F.element_at(run, index) - F.element_at(run, index - 1)
    t = F.when(size > 0, (at - start) / F.nullif(size, F.lit(0.0))).otherwise(0.0)
    between = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    pair = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return F.when(at <= 0, pair(first)).when(at >= F.element_at(run, -1), pair(last)).otherwise(between)


def sub_line(points: Column, run: Column, start: Column, end: Column) -> Column:
    """The part of a line between two arc lengths, with the vertices strictly inside."""
    inside = F.filter(F.arrays_zip(points.alias("p"), run.alias("d")), lambda z: (z["d"] > start + EPSILON) & (z["d"] < end - EPSILON))
    return F.concat(F.array(point_at(points, run, start)), F.transform(inside, lambda z: z["p"]), F.array(point_at(points, run, end)))
