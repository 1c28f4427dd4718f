"""Bundles, icons, kept readings and job logs on hand-made installations."""

import os

import pytest
from pyspark.sql import functions as F

from matchlake.sources import bundles as B
from matchlake.sources.readings import fingerprint, kept_readings
from matchlake.sources.sinks import insert_or_ignore, replace_games, upsert
from matchlake.streaming.progress import JobLog, follow, history

GAMES = "id long, video_id long, start_s double, end_s double, map string, status string"
VIDEOS = "id long, path string, duration_s double, fps double"


def source(spark):
    games = spark.createDataFrame([(1, 1, 10.0, 250.0, "North", "confirmed"), (2, 1, 300.0, 500.0, "North", None), (3, 2, 10.0, 90.0, "South", "draft")], GAMES)
    videos = spark.createDataFrame([(1, "D:/films/cup.mp4", 600.0, 30.0), (2, "D:\\videos\\other.mp4", 100.0, 60.0)], VIDEOS)
    samples = spark.createDataFrame([(g, f, f * 0.2, 1, 0.1 * f) for g in (1, 2) for f in range(5)], "game_id long, frame int, t double, slot int, x double")
    loadouts = spark.createDataFrame([(1, 1, "B1", None, "G1"), (3, 1, "B2", "B1", None)], "game_id long, slot int, weapon1 string, weapon2 string, gadget string")
    comments = spark.createDataFrame([(7, 1, 1, 12.0, 'to be "seen" again\n')], "id long, game_id long, video_id long, t double, text string")
    return games, videos, {"samples": samples, "loadouts": loadouts, "comments": comments}


def installation(spark, root, games=(), videos=()):
    spark.createDataFrame(list(games), GAMES).write.parquet(f"{root}/games")
    spark.createDataFrame(list(videos), VIDEOS).write.parquet(f"{root}/videos")
    # an older version: samples without x, and a table that bundles do not have
    replace_games(spark.createDataFrame([(0, 0.0, 1, -1)], "frame int, t double, slot int, game_id long"), f"{root}/samples")
    replace_games(spark.createDataFrame([(0, "a", "b", "c", -1)], "slot int, weapon1 string, weapon2 string, gadget string, game_id long"), f"{root}/loadouts")
    replace_games(spark.createDataFrame([(1, 2.0, "x", -1)], "video_id long, t double, text string, game_id long"), f"{root}/comments")


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bundle"))
    assert B.export_bundles(*source(spark), folder) == {"games": 3, "written": 3, "unchanged": 0, "orphans": 0}
    return folder


def test_documents_of_equal_games_are_equal(spark):
    games, videos, tables = source(spark)
    one = {r["uid"]: r["digest"] for r in B.game_documents(games, videos, tables).collect()}
    shuffled = {n: df.orderBy(F.rand(3)) for n, df in tables.items()}
    renumbered = {n: df.withColumn("game_id", F.col("game_id") + 40) for n, df in shuffled.items()}
    two = {r["uid"]: r["digest"] for r in B.game_documents(games.withColumn("id", F.col("id") + 40), videos, renumbered).collect()}
    assert one == two and len(one) == 3


def test_only_what_changed_is_written_again(spark, tmp_path):
    folder = str(tmp_path)
    games, videos, tables = source(spark)
    B.export_bundles(games, videos, tables, folder)
    stamps = {os.path.join(d, r): os.path.getmtime(os.path.join(d, r)) for d, _, files in os.walk(f"{folder}/games") for r in files if r.startswith("part-")}
    assert B.export_bundles(games, videos, tables, folder) == {"games": 3, "written": 0, "unchanged": 3, "orphans": 0}
    changed = tables["samples"].where("NOT (game_id = 2 AND frame = 4)")
    assert B.export_bundles(games.where("id < 3"), videos, {**tables, "samples": changed}, folder) == {"games": 2, "written": 1, "unchanged": 1, "orphans": 1}
    now = {os.path.join(d, r): os.path.getmtime(os.path.join(d, r)) for d, _, files in os.walk(f"{folder}/games") for r in files if r.startswith("part-")}
    assert len(set(stamps) & set(now)) == 2 and len(now) == 3
    rows = {r["rows"].get("samples") for r in spark.read.parquet(f"{folder}/manifest").collect()}
    assert rows == {5, 4, None}


def test_import_into_an_empty_installation(spark, bundle, tmp_path):
    root = str(tmp_path)
    installation(spark, root)
    report = B.import_bundles(spark, bundle, root)
    assert report == {"imported": 3, "skipped": 0, "rows": {"samples": 10, "loadouts": 2, "comments": 1}, "dry_run": False}
    games = spark.read.parquet(f"{root}/games").orderBy("id").collect()
    videos = {r["id"]: r for r in spark.read.parquet(f"{root}/videos").collect()}
    assert sorted((g["map"], g["start_s"], g["status"]) for g in games) == [("North", 10.0, "confirmed"), ("North", 300.0, None), ("South", 10.0, "draft")]
    assert sorted(g["id"] for g in games) == [1, 2, 3] and {videos[g["video_id"]]["path"] for g in games if g["map"] == "South"} == {"D:\\videos\\other.mp4"} and len(videos) == 2
    first = next(g for g in games if g["status"] == "confirmed")
    (comment,) = B.installed(spark, root, "comments").collect()
    assert (comment["game_id"], comment["video_id"], comment["text"]) == (first["id"], first["video_id"], 'to be "seen" again\n')
    samples = B.installed(spark, root, "samples")
    assert "x" not in samples.columns and samples.count() == 10 and -1 not in {r["game_id"] for r in samples.collect()}
    assert B.import_bundles(spark, bundle, root)["imported"] == 0
    assert B.installed(spark, root, "samples").count() == 10


def test_what_is_there_is_skipped_and_icons_are_renamed(spark, bundle, tmp_path):
    root = str(tmp_path)
    installation(spark, root, [(5, 9, 11.9, 250.0, "North", "mine")], [(9, "/elsewhere/cup.mp4", 600.9, 30.0), (8, "/elsewhere/other.mp4", 102.0, 60.0)])
    report = B.import_bundles(spark, bundle, root, spark.createDataFrame([("B1", "B4"), ("B2", "B2")], "old string, new string"))
    assert (report["imported"], report["skipped"]) == (2, 1)
    games = {(g["map"], g["start_s"]): g for g in spark.read.parquet(f"{root}/games").collect()}
    assert set(games) == {("North", 11.9), ("North", 300.0), ("South", 10.0)} and games["North", 300.0]["video_id"] == 9 and games["North", 300.0]["id"] > 5
    assert games["South", 10.0]["video_id"] == 10  # of the same name, but two seconds longer
    (row,) = B.installed(spark, root, "loadouts").collect()
    assert (row["weapon1"], row["weapon2"], row["gadget"]) == ("B2", "B4", None)


def test_a_dry_run_writes_nothing(spark, bundle, tmp_path):
    root = str(tmp_path)
    installation(spark, root)
    assert B.import_bundles(spark, bundle, root, dry_run=True) == {"imported": 3, "skipped": 0, "rows": {"samples": 10, "loadouts": 2, "comments": 1}, "dry_run": True}
    assert spark.read.parquet(f"{root}/games").count() == 0 and spark.read.parquet(f"{root}/samples").count() == 1


def test_another_format_is_refused(spark, bundle, tmp_path):
    spark.read.parquet(f"{bundle}/manifest").withColumn("format", F.lit(99)).write.parquet(f"{tmp_path}/manifest")
    with pytest.raises(ValueError, match="99"):
        B.import_bundles(spark, str(tmp_path), str(tmp_path))


def test_a_failed_import_is_not_seen_and_can_be_tried_again(spark, bundle, tmp_path, monkeypatch):
    root, calls = str(tmp_path), []
    installation(spark, root)

    def fails(df, path, key="game_id"):
        if len(calls) == 1:
            raise OSError("no room left")
        calls.append(path)
        replace_games(df, path, key)

    with monkeypatch.context() as m:
        m.setattr(B, "replace_games", fails)
        with pytest.raises(OSError, match="no room"):
            B.import_bundles(spark, bundle, root)
    assert all(B.installed(spark, root, t).count() == 0 for t in ("samples", "loadouts", "comments"))
    B.import_bundles(spark, bundle, root)
    assert [B.installed(spark, root, t).count() for t in ("samples", "loadouts", "comments")] == [10, 2, 1]


def test_icons(spark):
    theirs = spark.createDataFrame([("B1", "x1", "HAMMER"), ("B2", "x2", "PIKE"), ("B3", "x3", None), ("B4", "x4", "NEW"), ("B5", "x5", "NEW"), ("G1", "y1", "ROPE")], "id string, digest string, name string")
    ours = spark.createDataFrame([("B1", "x1", "HAMMER"), ("B2", "other", "BOW"), ("B7", "z", "PIKE"), ("B10", "zz", "PIKE")], "id string, digest string, name string")
    assert {r["old"]: (r["new"], r["created"]) for r in B.map_icons(theirs, ours).collect()} == {"B1": ("B1", False), "B2": ("B7", False), "B3": ("B11", True), "B4": ("B12", True), "B5": ("B12", True), "G1": ("G1", True)}


def test_readings_are_made_once_for_their_parameters(spark, tmp_path):
    folder, asked = str(tmp_path), []

    def read(games):
        asked.append(sorted(r["game_id"] for r in games.collect()))
        return games.where("game_id < 3").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("value"), F.col("key").alias("by"), "game_id")

    def games(step):
        return spark.createDataFrame([(g,) for g in (1, 2, 3)], "game_id long").select("game_id", fingerprint(F.col("game_id"), step).alias("key"))

    plain = F.lit(0.5)
    assert kept_readings(spark, folder, games(plain), read).count() == 4 and asked == [[1, 2, 3]]
    assert kept_readings(spark, folder, games(plain), read).count() == 4 and asked == [[1, 2, 3]]  # game 3 has no reading, and that is known
    other = F.when(F.col("game_id") == 2, 0.7).otherwise(0.5)
    assert {r["by"] for r in kept_readings(spark, folder, games(other), read).where("game_id = 2").collect()} == {r["key"] for r in games(other).where("game_id = 2").collect()} and asked[1:] == [[2]]
    assert kept_readings(spark, folder, games(other), read, refresh=True).count() == 4 and asked[2:] == [[1, 2, 3]]
    # a spoilt file
    (part,) = [os.path.join(d, f) for d, _, files in os.walk(f"{folder}/readings/game_id=1") for f in files if f.endswith(".parquet")]
    with open(part, "wb") as f:
        f.write(b"spoilt")
    for name in os.listdir(os.path.dirname(part)):
        if name.endswith(".crc"):
            os.remove(os.path.join(os.path.dirname(part), name))
    assert kept_readings(spark, folder, games(other), read).count() == 4 and asked[3:] == [[1]]


def test_fingerprints_tell_nulls_and_values_apart(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1), (None, None)], "a int, b int")
    assert df.select(fingerprint(F.col("a"), F.col("b")).alias("k")).distinct().count() == 4


def test_a_job_log_is_replayed_and_followed(spark, tmp_path):
    path, folder = f"{tmp_path}/log", f"{tmp_path}/seen"
    log = JobLog(spark, path)
    log.tell([{"step": "read", "rows": 3}, {"step": "write", "rows": 3}])
    spark.createDataFrame([("a library's word",), ("{}",), ("",)], "value string").coalesce(1).write.mode("append").text(path)

    def seen():
        stream = follow(spark, path).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", folder).start()
        stream.awaitTermination()
        return sorted((r["at"], r["event"], r["step"]) for r in spark.read.parquet(folder).collect())

    assert seen() == [(0, "progress", "read"), (1, "progress", "write")]
    log.tell([{"event": "done"}])
    log.tell([{"event": "progress", "step": "after the end"}])
    assert seen() == [(0, "progress", "read"), (1, "progress", "write"), (2, "done", "")]
    assert history(spark, path).count() == 3


def test_upserts_keep_columns_of_any_name(spark):
    now = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "new int, nth int, row string")
    changes = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, None, "e")], "new int, nth int, row string")
    assert sorted(tuple(r) for r in upsert(now, changes, ["new"], "nth").select("new", "row").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    assert sorted(tuple(r) for r in insert_or_ignore(now, changes, ["new"], "nth").select("new", "row").collect()) == [(1, "a"), (2, "b"), (3, "e")]
