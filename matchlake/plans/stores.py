"""Games that travel as bundles, and readings kept by their parameters, over the match view."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.plans.registry import query
from matchlake.scratch import fresh_path
from matchlake.sources import bundles as B
from matchlake.sources.match_view import samples
from matchlake.sources.readings import fingerprint, kept_readings
from matchlake.sources.sinks import replace_games


def _games(ev):
    """Games, videos and tables of an installation: a game a day, five videos."""
    day = ev.select(F.col("game_id").cast("long").alias("id")).distinct()
    games = day.select("id", (F.col("id") % 5).alias("video_id"), (F.col("id") * 10.0).alias("start_s"), (F.col("id") * 10.0 + 5).alias("end_s"), F.concat(F.lit("map"), F.col("id") % 4).alias("map"))
    videos = day.select((F.col("id") % 5).alias("id")).distinct().select("id", F.concat(F.lit("D:/videos/v"), "id", F.lit(".mp4")).alias("path"), (F.lit(600.0) + F.col("id")).alias("duration_s"))
    rows = ev.select(F.col("game_id").cast("long").alias("game_id"), "slot", "t", "x", "y", "alive")
    kills = rows.where("NOT alive").select("game_id", "t", F.col("slot").alias("victim_slot"), F.concat(F.lit("B"), F.col("slot") % 3).alias("weapon"))
    return games, videos, {"samples": rows.drop("alive"), "kills": kills}


@query("bundle_import", """, g AS (SELECT DISTINCT game_id, game_id % 5 AS v FROM ev), own AS (SELECT * FROM g WHERE v < 3 AND game_id % 3 = 0),
  n AS (SELECT game_id, count(*) AS n_samples, count(*) FILTER (NOT alive) AS n_kills, count(*) FILTER (NOT alive AND slot % 3 = 1) AS n_b1 FROM ev GROUP BY ALL)
SELECT CASE WHEN own.game_id IS NULL THEN game_id * 10.0 ELSE game_id * 10.0 + 1 END AS start_s, 'map' || (game_id % 4) AS map, CASE WHEN g.v < 3 THEN 'C:/other/v' ELSE 'D:/videos/v' END || g.v || '.mp4' AS path, n_samples, n_kills, CASE WHEN own.game_id IS NULL THEN n_b1 ELSE 0 END AS n_renamed
FROM g LEFT JOIN own USING (game_id) JOIN n USING (game_id)""")
def bundle_import(spark, d):
    """An installation after it took over the games it lacked: three of five videos and a third of their games were there."""
    games, videos, tables = _games(samples(spark, d))
    folder, root = fresh_path(spark, "bundles"), fresh_path(spark, "installation")
    B.export_bundles(games, videos, tables, folder)
    own_videos = videos.where("id < 3").select((F.col("id") + 100).alias("id"), F.regexp_replace("path", "D:/videos", "C:/other").alias("path"), (F.col("duration_s") + 0.5).alias("duration_s"))
    own = games.where("video_id < 3 AND id % 3 = 0").withColumn("video_id", F.col("video_id") + 100).withColumn("start_s", F.col("start_s") + 1)
    own_videos.write.parquet(f"{root}/videos")
    own.write.parquet(f"{root}/games")
    for name, df in tables.items():
        # an installation of an older version, without y
        replace_games(df.join(own.select(F.col("id").alias("game_id")), "game_id", "left_semi").select(*[c for c in df.columns if c not in ("game_id", "y")], "game_id"), f"{root}/{name}")
    icons = spark.createDataFrame([("B1", "B9")], "old string, new string")
    B.import_bundles(spark, folder, root, icons)
    rows = B.installed(spark, root, "samples").groupBy("game_id").agg(F.count("*").alias("n_samples"))
    kills = B.installed(spark, root, "kills").groupBy("game_id").agg(F.count("*").alias("n_kills"), F.count_if(F.col("weapon") == "B9").alias("n_renamed"))
    there = spark.read.parquet(f"{root}/games").join(spark.read.parquet(f"{root}/videos").withColumnRenamed("id", "video_id"), "video_id")
    whole = there.withColumnRenamed("id", "game_id").join(rows, "game_id", "left").join(kills, "game_id", "left")
    return whole.select("start_s", "map", "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_samples", "n_kills", "n_renamed")])


@query("bundle_export", """, g AS (SELECT game_id, bool_or(NOT alive) AS dead FROM ev GROUP BY ALL) SELECT 'map' || (game_id % 4) AS map, count(*) AS games, count(*) FILTER (game_id % 4 = 0 AND dead) AS changed FROM g GROUP BY ALL""")
def bundle_export(spark, d):
    """How many games of a map a second export writes again, after the kills of a quarter of them were read anew."""
    games, videos, tables = _games(samples(spark, d))
    folder = fresh_path(spark, "bundles")
    B.export_bundles(games, videos, tables, folder)
    before = spark.read.parquet(f"{folder}/manifest").select("uid", F.col("digest").alias("before")).collect
    first = spark.createDataFrame(before(), "uid string, before string")
    again = tables["kills"].withColumn("weapon", F.when(F.col("game_id") % 4 == 0, "B7").otherwise(F.col("weapon")))
    B.export_bundles(games, videos, {**tables, "kills": again}, folder)
    now = spark.read.parquet(f"{folder}/manifest").join(first, "uid")
    return now.groupBy("map").agg(F.count("*").alias("games"), F.count_if(F.col("digest") != F.col("before")).alias("changed"))


@query("readings_kept", """, n AS (SELECT game_id, count(*) AS n FROM ev WHERE alive GROUP BY ALL) SELECT game_id, CASE WHEN game_id % 3 = 0 THEN 2 ELSE 1 END AS made, n FROM n WHERE game_id % 5 > 0""")
def readings_kept(spark, d):
    """Readings asked for again with other parameters for a third of the games: which pass made them."""
    ev, folder = samples(spark, d), fresh_path(spark, "readings")
    games = ev.select("game_id").distinct()

    def read(made: int):
        return lambda asked: ev.where("alive").join(asked.select("game_id"), "game_id").select("slot", "t", F.lit(made).alias("made"), "game_id")

    kept_readings(spark, folder, games.select("game_id", fingerprint(F.col("game_id"), F.lit(1.5)).alias("key")), read(1))
    step = F.when(F.col("game_id") % 3 == 0, 2.5).otherwise(1.5)
    found = kept_readings(spark, folder, games.where("game_id % 5 > 0").select("game_id", fingerprint(F.col("game_id"), step).alias("key")), read(2))
    return found.groupBy(F.col("game_id").cast("int").alias("game_id"), "made").agg(F.count("*").alias("n"))
