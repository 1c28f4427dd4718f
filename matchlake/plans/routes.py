"""The read queries a match-statistics service answers, over a set of match tables.

`tables` is a mapping of table names to DataFrames with the columns of the match tables. Every function returns a
DataFrame in the order the service gives.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import cell
from matchlake.functions.text import name_key, player_identity
from matchlake.operators import match as M
from matchlake.operators.aggregates import first_seen_mode, ratio, rounded, strict_sum, upper_median, weighted_mean

Tables = Mapping[str, DataFrame]
MAX_GAMES = 200


def games_of(tables: Tables, map_name: str | None = None, ids: list[int] | None = None, most: int = MAX_GAMES) -> DataFrame:
    """Games of a map, by exact name, or by ids; ids beyond `most` are an error."""
    if ids is not None and len(ids) > most:
        raise ValueError(f"at most {most} games")
    games = tables["games"]
    if map_name is not None:
        games = games.where(F.col("map") == map_name)
    return games if ids is None else games.where(F.col("id").isin(ids))


def _one(tables: Tables, name: str, game_id: int, *order: str) -> DataFrame:
    return tables[name].where(F.col("game_id") == game_id).orderBy(*order)


def lives(tables: Tables, game_id: int) -> DataFrame:
    return _one(tables, "lives", game_id, "slot", "idx")


def links(tables: Tables, game_id: int) -> DataFrame:
    return _one(tables, "kill_links", game_id, "t", "victim_slot", "kind")


def life_loadouts(tables: Tables, game_id: int) -> DataFrame:
    spans = tables["lives"].select("game_id", "slot", F.col("idx").alias("life_idx"), "t0", "t1")
    return tables["life_loadouts"].where(F.col("game_id") == game_id).join(spans, ["game_id", "slot", "life_idx"]).orderBy("slot", "life_idx")


def owners(tables: Tables, game_id: int) -> DataFrame:
    return _one(tables, "point_owner", game_id, "t0", "point")


def active(tables: Tables, game_id: int) -> DataFrame:
    return _one(tables, "point_active", game_id, "t0", "point")


def levels(tables: Tables, game_id: int) -> DataFrame:
    return _one(tables, "player_levels", game_id, "slot", "t0")


def gadgets(tables: Tables, game_id: int) -> DataFrame:
    return _one(tables, "gadget_state", game_id, "slot", "t0")


def duels(tables: Tables, game_id: int) -> DataFrame:
    return _one(tables, "duels", game_id, "t0", "id")


def kill_scores(tables: Tables, game_id: int) -> DataFrame:
    """Kill scores with reasons as an array, null if malformed; a missing death impact is the negative impact."""
    rows = _one(tables, "kill_scores", game_id, "t", "victim_slot")
    return rows.withColumn("reasons", F.from_json("reasons", "array<string>")).withColumn("death_impact", F.coalesce("death_impact", -F.col("impact")))


def episodes(tables: Tables, game_id: int | None = None, map_name: str | None = None, kind: str | None = None, team: str | None = None) -> DataFrame:
    """Episodes of one game, or of a kind on a map; exactly one of both is asked for."""
    if (game_id is None) == (map_name is None or kind is None):
        raise ValueError("either a game, or a map and a kind")
    found = tables["episodes"]
    if game_id is not None:
        found = found.where(F.col("game_id") == game_id)
    else:
        found = found.where(F.col("kind") == kind).join(games_of(tables, map_name).select(F.col("id").alias("game_id")), "game_id", "left_semi")
    return (found if team is None else found.where(F.col("team") == team)).orderBy("game_id", "t0", "id")


def set_verdict(tables: Tables, episode_id: int, verdict: str | None) -> DataFrame:
    """Episodes with one verdict changed to ok, ko or null."""
    if verdict not in ("ok", "ko", None):
        raise ValueError("verdict is ok, ko or null")
    return tables["episodes"].withColumn("verdict", F.when(F.col("id") == episode_id, F.lit(verdict)).otherwise(F.col("verdict")))


def teams(tables: Tables) -> DataFrame:
    """Names of teams with their number of games, folded by name key; the name shown is the one seen most."""
    sides = tables["games"].select("id", F.explode(F.array("team_a", "team_b")).alias("name")).where("name IS NOT NULL").withColumn("key", name_key(F.col("name")))
    return first_seen_mode(sides, ["key"], "name", "id", "name").join(sides.groupBy("key").agg(F.count_distinct("id").alias("games")), "key").select("key", "name", "games").orderBy("key")


def frame_steps(samples: DataFrame) -> DataFrame:
    times = samples.select("game_id", "t").distinct()
    gaps = times.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("game_id").orderBy("t"))).where("gap > 0")
    return upper_median(gaps, ["game_id"], "gap", "step")


def presence(tables: Tables, map_name: str, n: int = 32, slots: tuple[int, int] = (1, 8), ids: list[int] | None = None) -> DataFrame:
    """Seconds by cell, over games that have a frame step."""
    games = games_of(tables, map_name, ids, 50).select(F.col("id").alias("game_id"))
    rows = tables["samples"].join(games, "game_id", "left_semi")
    alive = rows.where(F.col("alive") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("slot").between(*slots))
    return (alive.join(frame_steps(rows), "game_id").groupBy(cell(F.col("x"), n).alias("ix"), cell(F.col("y"), n).alias("iy"))
            .agg(F.round(F.sum("step"), 3).alias("seconds")).orderBy("iy", "ix"))


def scoreboard(tables: Tables, game_id: int) -> DataFrame:
    whole = [F.when(F.col(c) == F.floor(c), F.col(c).cast("int")).alias(c) for c in ("kills", "deaths", "assists", "score")]
    return _one(tables, "scoreboard", game_id, "slot").select("slot", *whole, "name_read", "source")


def player_stats(tables: Tables, game_id: int) -> DataFrame:
    """Statistics, impact and ratings by slot; a slot appears if any of the three knows it."""
    stats = tables["player_game_stats"].where(F.col("game_id") == game_id)
    scores = tables["kill_scores"].where(F.col("game_id") == game_id)
    made = scores.where("killer_slot IS NOT NULL").groupBy("game_id", F.col("killer_slot").alias("slot")).agg(F.sum("impact").alias("impact"))
    lost = scores.groupBy("game_id", F.col("victim_slot").alias("slot")).agg(F.sum(F.coalesce("death_impact", -F.col("impact"))).alias("death_impact"))
    rated = tables["player_ratings"].where(F.col("game_id") == game_id).select("game_id", "slot", "individual", "teamplay", "overall")
    names = tables["players"].select("game_id", "slot", "name")
    keys = ["game_id", "slot"]
    every = stats.join(made, keys, "full").join(lost, keys, "full").join(rated, keys, "full").join(names, keys, "left")
    return every.withColumn("kd", ratio(F.col("kills"), F.col("deaths"))).orderBy("slot")


def game_summary(tables: Tables, game_id: int | None = None) -> DataFrame:
    """Totals of both teams of a game, or of every game: strict sums, weighted speed, wave tally and changes of the active point."""
    own = F.lit(True) if game_id is None else F.col("game_id") == game_id
    stats = tables["player_game_stats"].where(own).withColumn("team", M.team_of(F.col("slot")))
    totals = stats.groupBy("game_id", "team").agg(
        F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), strict_sum(F.col("alive_s")).alias("alive_s"), strict_sum(F.col("dist_m")).alias("dist_m"),
        rounded(weighted_mean(F.col("v_mean"), F.col("alive_s")), 3).alias("v_mean"), strict_sum(F.col("gadget_possible")).alias("gadget_possible"), F.sum("gadget_uses").alias("gadget_uses"))
    waves = M.wave_tally(_waves(tables["episodes"].where(own)), ["game_id", "team"])
    return totals.join(waves, ["game_id", "team"], "left").join(M.point_changes(tables["point_active"]), "game_id", "left").orderBy("game_id", "team")


def _waves(rows: DataFrame) -> DataFrame:
    """Episodes with has_wave, speed and size from their JSON; malformed data has no wave."""
    wave = F.from_json("data", "wave struct<speed:string,size:int>").getField("wave")
    return rows.withColumn("wave", wave).select("*", F.col("wave").isNotNull().alias("has_wave"), F.col("wave.speed").alias("speed"), F.col("wave.size").alias("size")).drop("wave")


def team_summary(tables: Tables, map_name: str) -> DataFrame:
    """By team name key on a map: games, totals, K/D and waves; every selected game counts."""
    games = games_of(tables, map_name)
    sides = games.select(F.col("id").alias("game_id"), F.explode(F.array(F.struct(F.lit("A").alias("team"), F.col("team_a").alias("name")), F.struct(F.lit("B").alias("team"), F.col("team_b").alias("name")))).alias("s"))
    sides = sides.select("game_id", "s.team", name_key(F.col("s.name")).alias("key"), F.col("s.name").alias("name"))
    stats = tables["player_game_stats"].withColumn("team", M.team_of(F.col("slot"))).groupBy("game_id", "team").agg(F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), strict_sum(F.col("gadget_uses")).alias("gadget_uses"))
    joined = sides.join(stats, ["game_id", "team"], "left")
    totals = joined.groupBy("key").agg(F.count_distinct("game_id").alias("games"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), strict_sum(F.col("gadget_uses")).alias("gadget_uses"))
    waves = M.wave_tally(_waves(tables["episodes"]).join(sides, ["game_id", "team"]), ["key"])
    shown = first_seen_mode(sides, ["key"], "name", "game_id", "name").select("key", "name")
    return totals.join(shown, "key").join(waves, "key", "left").withColumn("kd", ratio(F.col("kills"), F.col("deaths"))).orderBy("key")


def global_summary(tables: Tables, map_name: str, n: int = 32) -> DataFrame:
    """Deaths and kills by side and cell on a map."""
    games = games_of(tables, map_name).select(F.col("id").alias("game_id"))
    ended = tables["lives"].join(games, "game_id", "left_semi").where("ended = 'death' AND x1 IS NOT NULL AND y1 IS NOT NULL")
    ended = ended.withColumn("ix", cell(F.col("x1"), n)).withColumn("iy", cell(F.col("y1"), n))
    died = ended.select(M.team_of(F.col("slot")).alias("team"), "ix", "iy", F.lit("death").alias("what"))
    made = ended.where(M.team_of(F.col("killer_slot")) != M.team_of(F.col("slot"))).select(M.team_of(F.col("killer_slot")).alias("team"), "ix", "iy", F.lit("kill").alias("what"))
    return died.unionByName(made).groupBy("what", "team", "ix", "iy").agg(F.count("*").alias("n")).orderBy("what", "team", "iy", "ix")


def _kills_first(kills: Column, name: Column) -> list[Column]:
    return [F.coalesce(kills, F.lit(-1)).desc(), name.asc()]


def players_summary(tables: Tables, map_key: str | None = None) -> DataFrame:
    """By folded identity: games, totals, K/D, speed and medians; most kills first, unknown last."""
    games = tables["games"].select(F.col("id").alias("game_id"), name_key(F.col("map")).alias("map_key"))
    named = tables["players"].withColumn("identity", player_identity(F.col("name")))
    rows = tables["player_game_stats"].join(named, ["game_id", "slot"]).join(games, "game_id")
    if map_key is not None:
        rows = rows.where(F.col("map_key") == map_key)
    rows = rows.withColumn("order", F.col("game_id") * 10 + F.col("slot"))
    shown = first_seen_mode(rows, ["identity"], "name", "order", "name").select("identity", "name")
    totals = rows.groupBy("identity").agg(F.count_distinct("game_id").alias("games"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), F.sum("dist_m").alias("dist_m"),
                                          rounded(weighted_mean(F.col("v_mean"), F.col("alive_s")), 3).alias("v_mean"), F.median("kills").alias("median_kills"))
    return totals.join(shown, "identity").withColumn("kd", ratio(F.col("kills"), F.col("deaths"))).orderBy(*_kills_first(F.col("kills"), F.col("identity")))


def teams_summary(tables: Tables) -> DataFrame:
    """By team name key: games, totals and mean capture; slots with statistics but no name count for their side."""
    sides = tables["games"].select(F.col("id").alias("game_id"), F.explode(F.array(F.struct(F.lit("A").alias("team"), F.col("team_a").alias("name")), F.struct(F.lit("B").alias("team"), F.col("team_b").alias("name")))).alias("s"))
    sides = sides.select("game_id", "s.team", "s.name", name_key(F.col("s.name")).alias("key")).where("key IS NOT NULL AND key <> ''")
    last = Window.partitionBy("game_id", "point").orderBy(F.col("t").desc(), F.col("pct").desc())
    scores = tables["capture_state"].where(F.col("point").isin("score_A", "score_B")).withColumn("nth", F.row_number().over(last)).where("nth = 1").select("game_id", F.right("point", F.lit(1)).alias("team"), "pct")
    stats = tables["player_game_stats"].withColumn("team", M.team_of(F.col("slot"))).groupBy("game_id", "team").agg(F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"))
    rows = sides.join(stats, ["game_id", "team"], "left").join(scores, ["game_id", "team"], "left")
    totals = rows.groupBy("key").agg(F.count_distinct("game_id").alias("games"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), rounded(F.avg("pct"), 2).alias("capture"))
    shown = first_seen_mode(sides, ["key"], "name", "game_id", "name").select("key", "name")
    return totals.join(shown, "key").withColumn("kd", ratio(F.col("kills"), F.col("deaths"))).orderBy(*_kills_first(F.col("kills"), F.col("key")))
