"""Readings that are costly to make, kept by game with a fingerprint of the parameters they were made with."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlake.sources.bundles import _exists
from matchlake.sources.sinks import replace_games


def fingerprint(*parameters: Column) -> Column:
    """A digest of the parameters, null and absent ones included."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parameters)]), {"ignoreNullFields": "false"}), 256)


INDEX = "key string, n long, kind string, game_id long"


def kept_readings(spark: SparkSession, folder: str, games: DataFrame, read: Callable[[DataFrame], DataFrame], refresh: bool = False) -> DataFrame:
    """The readings (game_id, ...) of games (game_id, key): kept ones where the key is theirs, else made by `read` and kept.

    `read` gets the games (game_id, key) to read. A game's readings are used if the index has its key and as many rows of
    it can be read as the index says; so those of other parameters, of an import cut short and of a spoilt file are made
    again. The index is written after the readings. Readings of games not asked for stay untouched.
    """
    index, rows = f"{folder}/index", f"{folder}/readings"
    asked = games.select(F.col("game_id").cast("long").alias("game_id"), "key").distinct()
    missing = asked
    if not refresh and _exists(spark, index):
        missing = asked.join(_hits(spark, index, rows), ["game_id", "key"], "left_anti")
    missing = missing.persist()
    try:
        if missing.limit(1).count():
            made = read(missing)
            made = made.select(*[c for c in made.columns if c != "game_id"], F.col("game_id").cast("long").alias("game_id"))
            replace_games(made, rows)
            counted = _whole(spark, rows, made.schema.json()).groupBy("game_id").agg(F.count("*").alias("n"))
            entries = missing.join(counted, "game_id", "left").fillna(0, ["n"])
            replace_games(entries.select("key", "n", F.lit(made.schema.json()).alias("kind"), "game_id"), index)
    finally:
        missing.unpersist()
    kind = _entries(spark, index).select("kind").first()
    return _whole(spark, rows, kind["kind"] if kind else StructType().add("game_id", "long").json()).join(asked.select("game_id"), "game_id", "left_semi")


def _entries(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", "true").schema(INDEX).parquet(index)


def _whole(spark: SparkSession, rows: str, kind: str) -> DataFrame:
    """The readings that can be read; their kind is told, as a spoilt file could not tell it."""
    return spark.read.option("ignoreCorruptFiles", "true").schema(StructType.fromJson(json.loads(kind))).parquet(rows)


def _hits(spark: SparkSession, index: str, rows: str) -> DataFrame:
    """game_id and key of the games whose readings are whole."""
    entries = _entries(spark, index)
    kind = entries.select("kind").first()
    if kind is None or not _exists(spark, rows):
        return entries.select("game_id", "key").where("false")
    found = _whole(spark, rows, kind["kind"]).groupBy("game_id").agg(F.count("*").alias("there"))
    return entries.join(found, "game_id", "left").where(F.col("n") == F.coalesce("there", F.lit(0))).select("game_id", "key")
