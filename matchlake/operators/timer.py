"""Matches of a video from the readings of its countdown, with windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.series import with_runs

# Readings that make a run, and how far the start is looked for.
RUN, ORIGIN = 8, 40


def games_of_timer(readings: DataFrame, gap_s: float = 30.0, jump_up: float = 5.0, min_readings: int = 10, min_game_s: float = 60.0, pre_roll: float = 0.0, post_roll: float = 0.0) -> DataFrame:
    """video_id, game, start_s, end_s, readings, estimated of each match, from (video_id, t, remaining).

    Unreadable (null) readings and single ones that fit neither neighbour are left out. A new match starts where the
    countdown jumps up by more than jump_up, or where it does not go on as expected (within 3 s) after a gap above
    gap_s. A match needs a run of eight readings that fall a second a second. It starts half a second before the moment,
    by the median of the first forty readings of that run, at which the countdown left its first value; if that was not
    seen twice, at its first reading (`estimated`).
    """
    w = Window.partitionBy("video_id").orderBy("t")
    read = readings.where(F.col("remaining").isNotNull()).select("video_id", F.col("t").cast("double").alias("t"), F.col("remaining").cast("double").alias("v"))
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    read = read.withColumn("b", before).withColumn("a", after)
    read = read.where(~F.coalesce((F.col("b") >= F.col("a")) & ~F.col("v").between(F.col("a") - 2, F.col("b") + 2), F.lit(False))).drop("a", "b")
    gap, fall = F.col("t") - F.lag("t").over(w), F.lag("v").over(w) - F.col("v")
    read = read.withColumn("gap", gap).withColumn("fall", fall)
    starts = F.col("gap").isNull() | (-F.col("fall") > jump_up) | ((F.col("gap") > gap_s) & (F.abs(F.col("fall") - F.col("gap")) > 3))
    read = with_runs(read, ["video_id"], ["t"], starts, "game")
    g = Window.partitionBy("video_id", "game").orderBy("t")
    ahead = g.rowsBetween(0, RUN - 1)
    steady = F.abs(F.lead("v").over(g) - F.col("v") + F.lead("t").over(g) - F.col("t")) <= 1
    read = (read.withColumn("nth", F.row_number().over(g)).withColumn("first", F.first("v").over(g))
            .withColumn("steady", steady.cast("int")))
    falls = F.first("v").over(ahead) - F.last("v").over(ahead)
    lasts = F.last("t").over(ahead) - F.first("t").over(ahead)
    # a run: its first seven steps are steady, and it falls by most of the time that passes
    run = (F.sum("steady").over(g.rowsBetween(0, RUN - 2)) == RUN - 1) & (F.count("*").over(ahead) == RUN) & (falls >= 0.7 * lasts)
    every = Window.partitionBy("video_id", "game")
    read = read.withColumn("run", run).withColumn("left", F.min(F.when(F.col("v") != F.col("first"), F.col("nth"))).over(every)).withColumn("previous", F.lag("v").over(g))
    read = read.withColumn("from", F.min(F.when(F.col("run") & (F.col("nth") >= F.col("left")), F.col("nth"))).over(every))
    at = F.when(F.col("nth") == F.col("from"), F.when(F.abs(F.col("previous") - F.col("v")) <= 2, F.col("previous")).otherwise(F.col("v")))
    read = read.withColumn("reference", F.max(at).over(every))
    origin = F.median(F.when(F.col("nth").between(F.col("from"), F.col("from") + ORIGIN - 1), F.col("t") - (F.col("reference") - F.col("v"))))
    found = read.groupBy("video_id", "game").agg(F.count("*").alias("readings"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.bool_or("run").alias("runs"), F.max("left").alias("left"), origin.alias("origin"))
    kept = found.where((F.col("readings") >= min_readings) & (F.col("t1") - F.col("t0") >= min_game_s) & F.col("runs"))
    seen = (F.col("left") > 2) & F.col("origin").isNotNull()
    start = F.greatest(F.lit(0.0), F.when(seen, F.col("origin") - 0.5).otherwise(F.col("t0")) - pre_roll)
    return kept.select("video_id", "game", start.alias("start_s"), (F.col("t1") + 1 + post_roll).alias("end_s"), "readings", (~seen).alias("estimated"))
