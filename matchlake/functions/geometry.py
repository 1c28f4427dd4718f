"""Distances, cells, angles and piecewise-linear scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.sources.match_view import ARENA_M


def metres(dx: Column, dy: Column) -> Column:
    """Distance in metres of a difference of positions in [0,1].

    The root of the sum of squares, as in the SQL of the queries: of two equal distances hypot may call one less.
    """
    mx, my = dx * F.lit(ARENA_M[0]), dy * F.lit(ARENA_M[1])
    return F.sqrt(mx * mx + my * my)


def rect_distance(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Metres to a rectangle; 0 inside."""
    return metres(F.greatest(F.lit(x0) - x, F.lit(0.0), x - F.lit(x1)), F.greatest(F.lit(y0) - y, F.lit(0.0), y - F.lit(y1)))


def cell(v: Column, n: int) -> Column:
    """Index of the cell of n that holds v; values outside go to the border cells."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), (v * n).cast("int")))


def angle_difference(a: Column, b: Column) -> Column:
    """Signed difference in degrees, -180 to 180."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def note(value: Column, low: Column, mid: Column, high: Column) -> Column:
    """0 to 10 through (low, 0), (mid, 5) and (high, 10); a span of no width jumps."""
    under = F.when(mid > low, 5 * (value - low) / (mid - low)).otherwise(F.lit(5.0))
    over = F.when(high > mid, 5 + 5 * (value - mid) / (high - mid)).otherwise(F.lit(5.0))
    return F.when(value <= low, F.when(low < mid, 0.0).otherwise(5.0)).when(value < mid, under).when(value >= high, F.when(high > mid, 10.0).otherwise(5.0)).otherwise(over)


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd test against a polygon's edges."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if ay != by:
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            crossed = crossed + F.when(spans & (x < F.lit(bx - ax) * (y - F.lit(ay)) / F.lit(by - ay) + F.lit(ax)), 1).otherwise(0)
    return crossed % 2 == 1
