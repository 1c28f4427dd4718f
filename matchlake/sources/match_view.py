"""The match-shaped view of the events table: positions, teams and eliminations by game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.sources.tables import table

#: Scale of the arena in metres.
ARENA_M = (31.0, 16.5)


def seconds_of_day(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) % F.lit(86_400_000_000) / F.lit(1e6)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, game_id (day since 1970), slot 1-8, team A/B, t (seconds of the day), x, y in [0,1], alive, kind, value."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    slot = (F.col("user_id") % 8 + 1).cast("int")
    return events.select(
        "event_id", F.unix_date(F.to_date("ts")).alias("game_id"), slot.alias("slot"), F.when(slot <= 4, "A").otherwise("B").alias("team"),
        seconds_of_day(F.col("ts")).alias("t"), (k / 100).alias("x"), (F.floor(F.col("value") * 100) % 100 / F.lit(100.0)).alias("y"),
        (F.col("event_type") != "error").alias("alive"), F.col("event_type").alias("kind"), "value")
