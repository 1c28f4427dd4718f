"""Games as bundles of JSON that travel between installations: export of what changed, import of what is not there yet.

A bundle folder has `games`, one partition a game with its document, and `manifest`, one row a game. An installation is
a folder of tables: `games` and `videos`, and tables with a game_id, partitioned by it. Readers take the rows of games
that `games` names, so an import, which writes that table last and at once, is seen whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.sources.sinks import game_uid, orphans, replace_games

FORMAT = 1
# Columns that cite an icon, and how close two videos and two games are the same.
ICON_COLUMNS = ("weapon", "weapon1", "weapon2", "gadget")
SAME_VIDEO_S, SAME_GAME_S = 1.0, 2.0


def game_documents(games: DataFrame, videos: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """uid, map, video, duration_s, start_s, body, digest and rows (by table) of every game.

    The body is a JSON object of the game, its video and of each table's rows, sorted, so that equal games give equal
    bodies; a game's rows are gathered in one value, as they are in its file.
    """
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    rows = games.join(videos.withColumnRenamed("id", "video_id"), "video_id").withColumn("uid", game_uid(name, F.col("duration_s"), F.col("start_s") * 10))
    inner = [c for c in games.columns if c not in ("id", "video_id")]
    rows = rows.select(F.col("id").alias("game_id"), "uid", "map", name.alias("video"), "duration_s", "start_s", _json(F.struct(*inner)).alias("game"), _json(F.struct(*[c for c in videos.columns if c != "id"])).alias("of_video"))
    parts = None
    for table in sorted(tables):
        df = tables[table]
        columns = [c for c in df.columns if c not in ("game_id", "id")]
        part = df.groupBy("game_id").agg(F.sort_array(F.collect_list(_json(F.struct(*columns)))).alias("lines"))
        part = part.select("game_id", F.struct(F.lit(table).alias("name"), F.size("lines").cast("long").alias("n"), F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]")).alias("lines")).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    held = parts.groupBy("game_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    rows = rows.join(held, "game_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<name:string,n:bigint,lines:string>>")))
    listed = F.array_join(F.transform("parts", lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["lines"])), ",")
    body = F.concat(F.lit(f'{{"format":{FORMAT},"video":'), "of_video", F.lit(',"game":'), "game", F.lit(',"tables":{'), listed, F.lit("}}"))
    counts = F.map_from_entries(F.transform("parts", lambda p: F.struct(p["name"], p["n"])))
    return rows.select("uid", "map", "video", "duration_s", "start_s", body.alias("body"), F.sha1(body).alias("digest"), counts.alias("rows"))


def _json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    if _exists(spark, f"{folder}/manifest"):
        return spark.read.parquet(f"{folder}/manifest")
    return spark.createDataFrame([], "format int, uid string, map string, video string, duration_s double, start_s double, digest string, rows map<string,bigint>")


def export_bundles(games: DataFrame, videos: DataFrame, tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write the documents of the games that `folder` lacks or has otherwise: games, written, unchanged, orphans.

    Documents of unchanged games are not touched. Orphans, documents of games that are no longer there, stay.
    """
    spark = games.sparkSession
    known = _manifest(spark, folder)
    documents = game_documents(games, videos, tables)
    fresh = documents.join(known.select("uid", "digest"), ["uid", "digest"], "left_anti")
    replace_games(fresh.select("uid", "body"), f"{folder}/games", "uid")
    entries = documents.select(F.lit(FORMAT).alias("format"), "uid", "map", "video", "duration_s", "start_s", "digest", "rows")
    left = orphans(known, entries, "uid")
    # the manifest reads itself, so it is written beside and then takes its place
    entries.unionByName(left).write.mode("overwrite").parquet(f"{folder}/manifest-new")
    both = spark.read.parquet(f"{folder}/manifest-new").join(known.select("uid", F.col("digest").alias("before")), "uid", "left")
    counts = both.join(entries.select("uid", F.lit(True).alias("there")), "uid", "left").agg(F.count_if("there").alias("games"), F.count_if(F.col("there") & ~F.col("digest").eqNullSafe(F.col("before"))).alias("written"), F.count_if(F.col("there").isNull()).alias("orphans")).first()
    _replace(spark, f"{folder}/manifest-new", f"{folder}/manifest")
    return {"games": counts["games"], "written": counts["written"], "unchanged": counts["games"] - counts["written"], "orphans": counts["orphans"]}


def _replace(spark: SparkSession, source: str, target: str) -> None:
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(paths(target), True)
    if not system.rename(paths(source), paths(target)):
        raise OSError(f"{source} could not be moved to {target}")


def map_icons(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """old and new of their icons (id, digest, name): ours of equal id and digest, else the first of ours of equal kind and name, else a new number.

    The kind is an id's first letter; of their new icons of one kind and name the first gets the number.
    """
    number = F.coalesce(F.expr("try_cast(substring(id, 2) AS int)"), F.lit(0))
    mine = ours.select("id", "digest", "name", F.left("id", F.lit(1)).alias("kind"), number.alias("n"))
    rows = theirs.select("id", "digest", "name", F.left("id", F.lit(1)).alias("kind"), number.alias("n"))
    same = mine.select("id", "digest", F.col("id").alias("same"))
    named = mine.where("name IS NOT NULL").groupBy("kind", "name").agg(F.min_by("id", F.struct("n", "id")).alias("named"))
    rows = rows.join(same, ["id", "digest"], "left").join(named, ["kind", "name"], "left").withColumn("found", F.coalesce("same", "named"))
    one = F.when(F.col("name").isNotNull(), F.first("id").over(Window.partitionBy("kind", "name", F.col("found").isNull()).orderBy("n", "id"))).otherwise(F.col("id"))
    rows = rows.withColumn("as", F.when(F.col("found").isNull(), one))
    last = mine.groupBy("kind").agg(F.max("n").alias("last"))
    fresh = rows.where("found IS NULL").select("kind", "as").distinct().join(rows.select(F.col("id").alias("as"), F.col("n").alias("at")).distinct(), "as").join(last, "kind", "left")
    fresh = fresh.withColumn("made", F.concat("kind", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("kind").orderBy("at", "as"))))
    return rows.join(fresh.select("as", "made"), "as", "left").select(F.col("id").alias("old"), F.coalesce("found", "made").alias("new"), F.col("found").isNull().alias("created"))


def new_games(entries: DataFrame, games: DataFrame, videos: DataFrame) -> DataFrame:
    """The manifest's entries that are not there yet, with the video they belong to, null for a new one.

    A video is the same by file name and a duration at most SAME_VIDEO_S apart, a game by its video and a start at most
    SAME_GAME_S apart.
    """
    named = videos.select(F.col("id").alias("video_id"), F.element_at(F.split("path", r"[/\\]"), -1).alias("video"), F.col("duration_s").alias("its"))
    met = entries.join(named, "video", "left").withColumn("near", F.coalesce(F.abs(F.col("its") - F.col("duration_s")) <= SAME_VIDEO_S, F.lit(False)))
    found = met.groupBy("uid").agg(F.min(F.when(F.col("near"), F.col("video_id"))).alias("video_id"))
    asked = entries.join(found, "uid")
    there = games.select("video_id", F.col("start_s").alias("its_start"))
    known = asked.join(there, "video_id").where(F.abs(F.col("its_start") - F.col("start_s")) <= SAME_GAME_S).select("uid").distinct()
    return asked.join(known, "uid", "left_anti")


def import_bundles(spark: SparkSession, folder: str, root: str, icons: DataFrame | None = None, dry_run: bool = False) -> dict:
    """Take over the games of a bundle folder that the installation at `root` lacks: imported, skipped, rows by table.

    Another format is refused before anything is read. Of tables and columns, those that the installation has are
    taken; games and videos get new ids, icons are renamed by `icons` (old, new). With `dry_run` nothing is written.
    A failed import leaves nothing to see, and the next one writes over what it left.
    """
    entries = spark.read.parquet(f"{folder}/manifest")
    formats = [r[0] for r in entries.select("format").distinct().limit(2).collect()]
    if formats not in ([], [FORMAT]):
        raise ValueError(f"bundles of format {formats} are not known, only {FORMAT}")
    games, videos = spark.read.parquet(f"{root}/games"), spark.read.parquet(f"{root}/videos")
    fresh = new_games(entries, games, videos)
    total, imported = entries.count(), fresh.count()
    counts = fresh.select(F.explode("rows").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
    report = {"imported": imported, "skipped": total - imported, "rows": {r["name"]: r["n"] for r in counts.collect()}, "dry_run": dry_run}
    if dry_run or not imported:
        return report
    last_game, last_video = (df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for df in (games, videos))
    # the new ids follow from the uids, so that an import that is tried again gives the same ones
    numbered = fresh.withColumn("game_id", (F.lit(last_game) + F.row_number().over(Window.orderBy("uid"))).cast("long"))
    docs = numbered.select("uid", "game_id", "video_id", "video", "duration_s").join(spark.read.parquet(f"{folder}/games").select(F.col("uid").cast("string").alias("uid"), "body"), "uid")
    unknown = numbered.where("video_id IS NULL").groupBy("video", F.floor("duration_s").alias("whole_s")).agg(F.min("uid").alias("first"))
    unknown = unknown.withColumn("new_id", (F.lit(last_video) + F.row_number().over(Window.orderBy("first"))).cast("long"))
    docs = docs.join(unknown, (F.col("video_id").isNull()) & (docs["video"] == unknown["video"]) & (F.floor(docs["duration_s"]) == F.col("whole_s")), "left").select("uid", "game_id", F.coalesce("video_id", "new_id").alias("video_id"), F.when(F.col("video_id").isNull() & (F.col("uid") == F.col("first")), True).alias("adds_video"), "body")
    for table in sorted(report["rows"]):
        if not _exists(spark, f"{root}/{table}"):
            continue
        schema = spark.read.parquet(f"{root}/{table}").schema
        fields = [f for f in schema if f.name != "game_id"]
        kind = "array<struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields) + ">>"
        rows = docs.select("game_id", F.col("video_id").alias("own_video"), F.explode(F.from_json(F.get_json_object("body", f"$.tables.{table}"), kind)).alias("r")).select("game_id", "own_video", "r.*")
        if "video_id" in rows.columns:
            rows = rows.withColumn("video_id", F.col("own_video").cast(schema["video_id"].dataType))
        for c in ICON_COLUMNS:
            if icons is not None and c in rows.columns:
                rows = rows.join(icons.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        replace_games(rows.select(*[f.name for f in fields], "game_id"), f"{root}/{table}")

    def taken(part: str, schema, given: dict[str, Column], rows: DataFrame) -> DataFrame:
        fields = [f for f in schema if f.name not in given]
        kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields) + ">"
        parsed = rows.withColumn("r", F.from_json(F.get_json_object("body", f"$.{part}"), kind))
        return parsed.select(*[given[f.name].cast(f.dataType).alias(f.name) if f.name in given else F.col(f"r.{f.name}") for f in schema])

    taken("video", videos.schema, {"id": F.col("video_id")}, docs.where("adds_video")).write.mode("append").parquet(f"{root}/videos")
    taken("game", games.schema, {"id": F.col("game_id"), "video_id": F.col("video_id")}, docs).write.mode("append").parquet(f"{root}/games")
    return report


def installed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table whose game is there."""
    return spark.read.parquet(f"{root}/{table}").join(spark.read.parquet(f"{root}/games").select(F.col("id").alias("game_id")), "game_id", "left_semi")
