"""Aggregates that say what null, ties and small samples mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_sum(x: Column) -> Column:
    """Null if any value is null or there is none."""
    return F.when((F.count(x) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(x))


def rounded(x: Column, digits: int) -> Column:
    """x rounded as the SQL of the queries has it: scaled, to the nearest whole number, away from 0 where two are as near, and back.

    F.round takes the shortest decimal of x instead, which is another number where scaling x is not exact: 68.725 is 68.73 by it, here 68.72.
    """
    scale = F.lit(float(10**digits))
    return F.round(x * scale) / scale


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b, rounded; null if either is null or b is 0."""
    return rounded(F.try_divide(a.cast("double"), b.cast("double")), digits)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows that have both and a positive weight; null if there is none."""
    use = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(use, value * weight)), F.sum(F.when(use, weight)))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The value at place floor(n / 2) of each group's ascending values: the upper one of an even count."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("__nth", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__nth") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col(value).alias(name))


def percentile_at(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place min(n - 1, floor(share * n)) of each group's ascending values."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = df.withColumn("__nth", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__nth") == F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(share)))).select(*keys, F.col(value).alias(name))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("low"), "__first", F.col(value).alias("v"))).alias("__m")).select(*keys, F.col("__m.v").alias(name), (-F.col("__m.low")).alias(f"{name}_n"))


def share_of_total(value: Column, keys: list[str]) -> Column:
    """A row's share of its group's sum; null where the sum is 0."""
    return F.try_divide(value, F.sum(value).over(Window.partitionBy(*keys)))
