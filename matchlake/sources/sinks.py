"""Writes by game: replace, upsert, first-wins and deterministic export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_games(df: DataFrame, path: str, key: str = "game_id") -> None:
    """Replace the rows of exactly the games that df holds; other games stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both by key, the one of the highest `order` winning, null the lowest; on a tie the change. Columns of any name stay."""
    both = current.select("*", F.lit(0).alias(new := _unused("new", current, changes))).unionByName(changes.select("*", F.lit(1).alias(new)), allowMissingColumns=True)
    rows = both.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(order).alias("o"), F.col(new).alias("n"), F.struct(*[c for c in both.columns if c != new]).alias("row"))
    w = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy(F.col("o").desc_nulls_last(), F.col("n").desc())
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("row.*")


def insert_or_ignore(current: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current, and of the rows whose keys it lacks the first of each key. Columns of any name stay."""
    held = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(order).alias("o"), F.struct(*rows.columns).alias("row"))
    w = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("o")
    first = held.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("row.*")
    return current.unionByName(first.join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def _unused(name: str, *frames: DataFrame) -> str:
    """A name that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def game_uid(name: Column, duration: Column, start: Column) -> Column:
    """Ten hex digits that name a game by its file, rounded duration and rounded start."""
    whole = [F.bround(x).cast("long").cast("string") for x in (duration, start)]
    return F.left(F.sha1(F.concat_ws("|", name, *whole)), F.lit(10))


def changed_bundles(df: DataFrame, known: DataFrame, key: str = "game_uid") -> DataFrame:
    """One JSON text a game, rows in order, with its hash; only games whose hash `known` (key, digest) lacks."""
    columns = sorted(c for c in df.columns if c != key)
    rows = df.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))
    bundles = rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("row")), "\n").alias("body")).withColumn("digest", F.sha1("body"))
    return bundles.join(known.select(key, "digest"), [key, "digest"], "left_anti")


def orphans(known: DataFrame, games: DataFrame, key: str = "game_uid") -> DataFrame:
    """Exported games that are no longer there."""
    return known.join(games.select(key), key, "left_anti")


def _family(outcome: Column) -> Column:
    """Series of kills exchange verdicts only among themselves."""
    return F.coalesce(F.startswith(outcome, F.lit("series_")), F.lit(False))


def keep_verdicts(new: DataFrame, old: DataFrame, within: float = 3.0) -> DataFrame:
    """new with the verdict of the old episode of equal game, kind, point, team and family that starts at most `within` away.

    Two null points or teams are equal. An old row serves every new row within reach; of several old rows the earliest
    serves. Without an outcome column all episodes are of one family.
    """
    keys = ["game_id", "kind", "point", "team"]
    families = [_family(F.col("outcome")) if "outcome" in df.columns else F.lit(False) for df in (new, old)]
    numbered = new.drop("verdict").select(F.struct("*").alias("row"), *[F.col(k).alias(f"new_{k}") for k in keys], F.col("t0").alias("new_t0"), families[0].alias("new_family"))
    kept = old.where(F.col("verdict").isNotNull()).select(*[F.col(k).alias(f"old_{k}") for k in keys], F.col("t0").alias("old_t0"), families[1].alias("old_family"), F.col("verdict").alias("old_verdict"))
    same = (F.col("new_game_id") == F.col("old_game_id")) & (F.col("new_kind") == F.col("old_kind")) & (F.col("new_family") == F.col("old_family"))
    for k in ("point", "team"):
        same &= F.col(f"new_{k}").eqNullSafe(F.col(f"old_{k}"))
    asked = numbered.select(*[f"new_{k}" for k in keys], "new_t0", "new_family").distinct()
    best = (asked.join(kept, same & (F.abs(F.col("new_t0") - F.col("old_t0")) <= within))
            .groupBy(*[f"new_{k}" for k in keys], "new_t0", "new_family").agg(F.min(F.struct("old_t0", "old_verdict")).alias("best")))
    best = best.withColumnsRenamed({f"new_{k}": f"its_{k}" for k in (*keys, "t0", "family")})
    there = F.lit(True)
    for k in (*keys, "t0", "family"):
        there &= F.col(f"new_{k}").eqNullSafe(F.col(f"its_{k}"))
    return numbered.join(best, there, "left").select("row.*", F.col("best.old_verdict").alias("verdict"))


def stale(games: DataFrame, done: DataFrame, module: str, revision: int) -> DataFrame:
    """Games for which the module has not run at this revision."""
    ran = done.where((F.col("module") == module) & (F.col("revision") == revision)).select("game_id")
    return games.join(ran, "game_id", "left_anti")
