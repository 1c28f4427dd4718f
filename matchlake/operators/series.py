"""Runs, sessions and gap rules over rows ordered in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_runs(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "run") -> DataFrame:
    """Number rows by how many runs have started; `starts` is true on the first row of a run."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__start", starts.cast("int")).withColumn(name, F.sum("__start").over(w)).drop("__start")


def label_runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """One row a run of equal labels (null equals null): keys, run, label, t0, t1, n; t is the first order column."""
    before = F.lag(label).over(_ordered(keys, order))
    nth = F.row_number().over(_ordered(keys, order))
    numbered = with_runs(df.withColumn("__new", (nth == 1) | ~F.col(label).eqNullSafe(before)), keys, order, F.col("__new"))
    return numbered.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(order[0]).alias("t0"), F.max(order[0]).alias("t1"), F.count("*").alias("n"))


def sessions(df: DataFrame, keys: list[str], order: list[str], gap: float) -> DataFrame:
    """df with `run`: a row more than gap after the one before it starts a new one (a gap of exactly `gap` does not)."""
    since = F.col(order[0]) - F.lag(order[0]).over(_ordered(keys, order))
    return with_runs(df.withColumn("__since", since), keys, order, F.col("__since").isNull() | (F.col("__since") > gap)).drop("__since")


def merge_segments(df: DataFrame, keys: list[str], gap: float, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Segments of equal keys joined where the next starts at most gap after all before it have ended."""
    w = _ordered(keys, [t0, t1])
    reach = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = with_runs(df.withColumn("__reach", reach), keys, [t0, t1], F.col("__reach").isNull() | (F.col(t0) > F.col("__reach") + gap))
    return numbered.groupBy(*keys, "run").agg(F.min(t0).alias(t0), F.max(t1).alias(t1), F.count("*").alias("n"))


def fill_short_gaps(runs: DataFrame, keys: list[str], label: str, short: float) -> DataFrame:
    """Label of runs shorter than `short` between two equal neighbours becomes the neighbours'."""
    w = _ordered(keys, ["t0", "run"])
    left, right = F.lag(label).over(w), F.lead(label).over(w)
    return runs.withColumn("filled", F.when((F.col("t1") - F.col("t0") < short) & (left == right), left).otherwise(F.col(label)))


def trailing_drops(df: DataFrame, keys: list[str], t: str, value: str, window: int, drop: float, gap: float) -> DataFrame:
    """Groups, at most `gap` apart, of rows at least `drop` below the highest value of the `window` before."""
    high = F.max(value).over(Window.partitionBy(*keys).orderBy(t).rangeBetween(-window, 0))
    low = df.withColumn("high", high).where(F.col("high") - F.col(value) >= drop)
    return sessions(low, keys, [t], gap).groupBy(*keys, "run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"), F.max(F.col("high") - F.col(value)).alias("depth"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, t: str, hold: float, name: str) -> DataFrame:
    """The last known value, kept for at most `hold` after its row; null beyond."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    return df.withColumn("__last", last).withColumn(name, F.when(F.col(t) - F.col("__last.t") <= hold, F.col("__last.v"))).drop("__last")


def linear_fill(df: DataFrame, keys: list[str], order: list[str], value: str, t: str, most: float, name: str) -> DataFrame:
    """Null values by a line between the known ones around them, if those are at most `most` apart."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    # both ways from the start of an order, as a frame that is open at its end is read again for every row
    ahead, back = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (_ordered(keys, order), _ordered(keys, [F.desc(c) for c in order])))
    both = df.withColumn("__a", F.last(known, ignorenulls=True).over(ahead)).withColumn("__b", F.last(known, ignorenulls=True).over(back))
    span = F.col("__b.t") - F.col("__a.t")
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(t) - F.col("__a.t")) / span
    return both.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).when((span > 0) & (span <= most), line)).drop("__a", "__b")


def trailing_max(df: DataFrame, keys: list[str], at: str, width: int, value: str, name: str) -> DataFrame:
    """df with the most of `value` over the rows of equal keys from `width` before `at`, a whole number, to it, both included.

    In blocks as wide as the window a row has all of its own block up to it, and of the block before what is at most
    `width` away, which is read from its end. So each row is read twice, where a sliding frame reads a window for each.
    """
    block = F.floor(F.col(at) / width)
    own = df.withColumns({"__block": block, "__at": F.col(at), "__here": F.lit(True), "__now": F.col(value), "__then": F.lit(None).cast(df.schema[value].dataType)})
    earlier = df.select(*keys, (block + 1).alias("__block"), (F.col(at) + width).alias("__at"), F.lit(False).alias("__here"), F.col(value).alias("__then"))
    part = Window.partitionBy(*keys, "__block")
    up_to, from_on = (part.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("__at"), F.col("__at").desc()))
    both = own.unionByName(earlier, allowMissingColumns=True).withColumn("__after", F.max("__then").over(from_on)).where("__here")
    return both.withColumn(name, F.greatest(F.max("__now").over(up_to), "__after")).drop("__block", "__at", "__here", "__now", "__then", "__after")
