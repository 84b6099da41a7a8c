"""Lines and corners in the plane, as Column functions.

A line is given by two points (x1, y1) and (x2, y2), a point by a struct of x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: directions whose cross product is below this are parallel.
PARALLEL = 1e-6


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from the x axis, in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def intersection(a: tuple, b: tuple) -> Column:
    """Struct of x and y where two lines (x1, y1, x2, y2), however long, meet; not a number for parallel ones."""
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    turn = _cross(ax, ay, bx, by)
    # how far along the first line, as a share of it
    share = F.when(F.abs(turn) < PARALLEL, F.lit(float("nan"))).otherwise(F.try_divide(_cross(b[0] - a[0], b[1] - a[1], bx, by), turn))
    return F.struct((a[0] + share * ax).alias("x"), (a[1] + share * ay).alias("y"))


def corners(points: Column) -> Column:
    """Struct of the corners of an array of points: top left and bottom right by x + y, top right and bottom left by y - x; ties by place."""
    by = lambda key, sign: F.transform(points, lambda p, i: F.struct(key(p).alias("k"), (sign * i).alias("i"), p.alias("p")))
    total, apart = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    least = lambda key: F.array_min(by(key, 1))["p"]
    most = lambda key: F.array_max(by(key, -1))["p"]
    return F.struct(least(total).alias("top_left"), least(apart).alias("top_right"), most(total).alias("bottom_right"), most(apart).alias("bottom_left"))
