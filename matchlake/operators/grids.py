"""Heat grids as sparse (ix, iy, v) frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.operators.aggregates import percentile_at


def merge(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cell by cell sum."""
    return a.unionByName(b).groupBy(*(keys or []), "ix", "iy").agg(F.sum("v").alias("v"))


def dense(grid: DataFrame, n: int) -> DataFrame:
    """All n * n cells; cells outside are dropped, duplicates summed, missing ones 0."""
    spine = grid.sparkSession.range(n * n).select((F.col("id") % n).cast("int").alias("ix"), F.floor(F.col("id") / n).cast("int").alias("iy"))
    return spine.join(grid.groupBy("ix", "iy").agg(F.sum("v").alias("v")), ["ix", "iy"], "left").fillna(0.0, ["v"])


def _kernel(sigma: float) -> list[tuple[int, float]]:
    radius = math.ceil(3 * sigma)
    return [(d, math.exp(-d * d / (2 * sigma * sigma))) for d in range(-radius, radius + 1)]


def _kernel_mass(taps: Column, at: Column, n: int) -> Column:
    """Sum of the weights that fall on the grid."""
    return F.aggregate(F.filter(taps, lambda k: (at + k["d"]).between(0, n - 1)), F.lit(0.0), lambda s, k: s + k["w"])


def blur(grid: DataFrame, n: int, sigma: float, keys: list[str] | None = None) -> DataFrame:
    """Separable Gaussian blur, renormalised at the edges; sigma 0 or less leaves the grid as it is."""
    if sigma <= 0:
        return grid
    keys = keys or []
    kernel = _kernel(sigma)
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in kernel])
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        mass = _kernel_mass(taps, F.col(axis), n)
        spread = grid.select(*keys, (F.col(axis)).alias("from"), other, "v", F.explode(taps).alias("k"))
        moved = spread.select(*keys, (F.col("from") + F.col("k.d")).alias(axis), other, (F.col("v") * F.col("k.w")).alias("v")).where(F.col(axis).between(0, n - 1))
        grid = moved.groupBy(*keys, axis, other).agg(F.sum("v").alias("v")).withColumn("v", F.col("v") / mass)
    return grid.select(*keys, "ix", "iy", "v")


def scale_by_p98(grid: DataFrame) -> DataFrame:
    """Values over the 98th-centile positive value, at most 1; only positive cells."""
    positive = grid.where("v > 0")
    top = percentile_at(positive, [], "v", 0.98, "top")
    return positive.crossJoin(F.broadcast(top)).select("ix", "iy", F.least(F.lit(1.0), F.col("v") / F.col("top")).alias("v"))


def masked_difference(a: DataFrame, b: DataFrame, floor: float = 0.10) -> DataFrame:
    """a - b where a + b reaches `floor` of its own 98th centile; `signed` is over the largest difference."""
    both = (a.select("ix", "iy", F.col("v").alias("a")).join(b.select("ix", "iy", F.col("v").alias("b")), ["ix", "iy"], "full").fillna(0.0, ["a", "b"]).withColumn("v", F.col("a") + F.col("b")))
    top = percentile_at(both.where("v > 0"), [], "v", 0.98, "top")
    shown = both.crossJoin(F.broadcast(top)).where(F.col("v") >= F.col("top") * floor).select("ix", "iy", (F.col("a") - F.col("b")).alias("d"))
    most = shown.agg(F.max(F.abs("d")).alias("most"))
    return shown.crossJoin(F.broadcast(most)).select("ix", "iy", "d", F.coalesce(F.try_divide(F.col("d"), F.col("most")), F.lit(0.0)).alias("signed"))
