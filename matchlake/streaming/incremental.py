"""Streaming counterparts of the presence and series queries.

Each takes a stream of match events and gives a streaming DataFrame; `drain` runs one to the end of the input that is
there and returns what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchlake.scratch import shared_dir


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream with a timestamp column `at`."""
    path = f"{folder.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, so that one file serves as well as a folder of files
    return spark.readStream.schema(schema).parquet(path.removesuffix("s.parquet") + "[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events by window and kind, each event_id once."""
    return (events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
            .groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value")))


def session_counts(events: DataFrame, gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by kind; events at most `gap` apart belong together. Appended once the watermark has passed them, and then forgotten."""
    return (events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "event_type").agg(F.count("*").alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n"))


def _count_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, changes, n = state.get if state.exists else ("", 0, 0)
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
    for kind in rows["event_type"]:
        changes += int(n > 0 and kind != last)
        last, n = kind, n + 1
    state.update((last, changes, n))
    yield pd.DataFrame({"user_id": [key[0]], "changes": [changes], "n": [n]})


def state_changes(events: DataFrame) -> DataFrame:
    """Changes of kind by user so far, in the order of arrival by batch and of time within one."""
    return events.select("user_id", "event_id", "at", "event_type").groupBy("user_id").applyInPandasWithState(
        _count_changes, "user_id long, changes long, n long", "last string, changes long, n long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream over all input there is; the last row of each key, by batch."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    wrote = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
             .foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")).start())
    wrote.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    values = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in values])
