"""As-of, interval and band joins by equal keys and time buckets, never by a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], t: str, payload: list[str], tolerance: float | None = None, direction: str = "nearest", tie: str = "__tie") -> DataFrame:
    """left with the payload and `found_t` of the right row of equal keys nearest in time.

    direction: nearest (a tie goes to the earlier), backward (at or before) or strictly_before. One union, one sort.
    `tie` names a right column that orders rows of equal time, the last of which counts as the later one.
    """
    right = right if tie in right.columns else right.withColumn(tie, F.lit(0))
    mine = F.struct(*[F.col(c) for c in left.columns]).alias("__left")
    theirs = F.struct(F.col(t).alias("found_t"), *[F.col(c) for c in payload]).alias("__right")
    both = (left.select(*by, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__order"), mine)
            .unionByName(right.select(*by, F.col(t).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__order"), theirs), allowMissingColumns=True))
    # backward takes a right row of the same time, so it sorts before the left one; for nearest it is a later one
    side = F.col("__side").asc() if direction == "backward" else F.col("__side").desc()
    w = Window.partitionBy(*by).orderBy(F.col("__t"), side, F.col("__order"))
    before = F.last("__right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if direction == "nearest":
        # the same order backwards, as a frame that is open at its end is read again for every row
        back = Window.partitionBy(*by).orderBy(F.col("__t").desc(), F.col("__side").asc(), F.col("__order").desc())
        after = F.last("__right", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        both = both.withColumn("__b", before).withColumn("__a", after)
        best = F.when(F.col("__a").isNull() | (F.col("__t") - F.col("__b.found_t") <= F.col("__a.found_t") - F.col("__t")), F.col("__b")).otherwise(F.col("__a"))
    else:
        both = both.withColumn("__b", before)
        best = F.col("__b")
    both = both.where("__side = 1").withColumn("__best", best)
    near = F.abs(F.col("__best.found_t") - F.col("__t")) <= tolerance if tolerance is not None else F.lit(True)
    return both.select("__left.*", *[F.when(near, F.col(f"__best.{c}")).alias(c) for c in ("found_t", *payload)])


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], t: str, t0: str, t1: str, width: float, slack: float = 0.0) -> DataFrame:
    """Pairs with t0 - slack <= t <= t1 + slack; joined on keys and time buckets of `width`."""
    spans = intervals.where(F.col(t1) >= F.col(t0)).withColumn("__bucket", F.explode(_buckets(F.col(t0) - slack, F.col(t1) + slack, width)))
    marked = points.withColumn("__bucket", F.floor(F.col(t) / width))
    return marked.join(spans, [*by, "__bucket"]).where(F.col(t).between(F.col(t0) - slack, F.col(t1) + slack)).drop("__bucket")


def overlaps(a: DataFrame, b: DataFrame, by: list[str], width: float, a0: str = "a0", a1: str = "a1", b0: str = "b0", b1: str = "b1", touching: bool = False) -> DataFrame:
    """Pairs of intervals that share time, or where `touching` a moment, with `shared`; each pair once, in the bucket of its later start."""
    left = a.withColumn("__bucket", F.explode(_buckets(F.col(a0), F.greatest(F.col(a0), F.col(a1)), width)))
    right = b.withColumn("__bucket", F.explode(_buckets(F.col(b0), F.greatest(F.col(b0), F.col(b1)), width)))
    shared = F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0))
    return (left.join(right, [*by, "__bucket"]).where(((shared >= 0) if touching else (shared > 0)) & (F.col("__bucket") == F.floor(F.greatest(F.col(a0), F.col(b0)) / width)))
            .withColumn("shared", shared).drop("__bucket"))


def within(a: DataFrame, b: DataFrame, by: list[str], ta: str, tb: str, low: float, high: float) -> DataFrame:
    """Pairs of equal keys with low <= tb - ta <= high, joined on time buckets as wide as the band."""
    width = max(high - low, 1e-9)
    right = b.withColumn("__bucket", F.floor(F.col(tb) / width))
    left = a.withColumn("__bucket", F.explode(_buckets(F.col(ta) + low, F.col(ta) + high, width)))
    return left.join(right, [*by, "__bucket"]).where((F.col(tb) - F.col(ta)).between(low, high)).drop("__bucket")
