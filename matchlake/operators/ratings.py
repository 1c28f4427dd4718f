"""Ratings of players: raw components by game and slot, and their notes of 0 to 20 on a measured scale.

Positions are read on a grid of half-second steps, one row a game and step with the players who live and are located
there. Frames as in `combat` and `waves`; kill_scores (game_id, killer_slot, victim_slot, impact, death_impact), links
as of `kill_links`, with killer_slot where it is known, stats (game_id, slot, gadget_uses, gadget_possible), board (game_id, slot, assists).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import metres
from matchlake.operators import combat as C
from matchlake.operators.aggregates import rounded
from matchlake.operators.joins import within
from matchlake.operators.match import team_of
from matchlake.operators.series import sessions
from matchlake.scratch import written
from matchlake.sources.match_view import ARENA_M

PLAYER = ["game_id", "slot"]
# Component, group, weight, and whether less is better.
COMPONENTS = [
    ("kills_per_min", "individual", 3, False), ("deaths_per_min", "individual", 3, True), ("assists_per_min", "individual", 2, False), ("kill_quality", "individual", 1, False), ("death_quality", "individual", 1, False),
    ("share_kills", "teamplay", 2, False), ("share_deaths", "teamplay", 2, True), ("share_assists", "teamplay", 1, False), ("presence", "teamplay", 2, False), ("objective", "teamplay", 1, False), ("space", "teamplay", 1, False),
    ("fight_front", "teamplay", 1, False), ("fight_first_kill", "teamplay", 1, False), ("aggro", "teamplay", 2, False), ("trades", "teamplay", 1, False), ("cohesion", "teamplay", 1, True), ("gadget", "teamplay", 1, False),
]
#: Components whose scale is kept by where assists come from.
SOURCED = ("assists_per_min", "share_assists")


@dataclass(frozen=True)
class RatingLimits:
    """Seconds, metres and shares of the components."""

    step: float = 0.5
    position: float = 1.5
    margin: float = 1.0  # metres around a starting zone
    near: float = 7.0  # metres from a point
    assist_m: float = 3.0
    assist_s: float = 4.6
    front_m: float = 16.0
    front_lead: float = 0.5
    aggro_m: float = 10.0
    closing: float = 0.5  # metres in closing_s
    closing_s: float = 1.0
    most_enemies: int = 2
    help: float = 10.0
    episode: float = 1.0  # between two moments of one episode
    survive: float = 3.0
    unavenged: float = 0.5  # credit of an episode that ends in a death for nothing
    avenge: float = 1.5
    same_kill: float = 0.5
    coverage: float = 0.5
    minute: float = 60.0


def position_grid(games: DataFrame, lives: DataFrame, samples: DataFrame, limits: RatingLimits = RatingLimits()) -> DataFrame:
    """game_id, i, players: by step of a game, slot, x and y of the players who live and have a position."""
    steps = games.select("game_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / limits.step).cast("int"))).alias("i"))
    seen = C.players_at(steps.withColumn("t", F.col("i") * limits.step), lives, samples, limits.position).where("x IS NOT NULL")
    return seen.groupBy("game_id", "i").agg(F.sort_array(F.collect_list(F.struct("slot", "x", "y"))).alias("players"))


def _apart(p: Column, q: Column) -> Column:
    return metres(p["x"] - q["x"], p["y"] - q["y"])


def _mates(slot: Column, players: str) -> Column:
    return F.filter(players, lambda q: ((q["slot"] <= 4) == (slot <= 4)) & (q["slot"] != slot))


def _enemies(slot: Column, players: str) -> Column:
    return F.filter(players, lambda q: (q["slot"] <= 4) != (slot <= 4))


def _each(grid: DataFrame) -> DataFrame:
    """A row for each player of a step, `me`, beside all."""
    return grid.select("game_id", "i", "players", F.explode("players").alias("me")).withColumn("slot", F.col("me.slot"))


def presence_values(grid: DataFrame, games: DataFrame, zones: DataFrame, points: DataFrame, lives: DataFrame, limits: RatingLimits = RatingLimits()) -> DataFrame:
    """game_id, slot, presence, objective, space, cohesion: over the steps at which a player is out of its zones.

    `points` (game_id, t0, t1, rect) are those that can be taken, of a game without any the objective is null; space is
    null where both teams start in the same zones.
    """
    mx, my = limits.margin / ARENA_M[0], limits.margin / ARENA_M[1]
    own = zones.groupBy("game_id", "team").agg(F.collect_list("zone").alias("zones"))
    rows = _each(grid).withColumn("team", team_of(F.col("slot"))).join(own, ["game_id", "team"], "left")
    inside = F.exists(F.coalesce("zones", F.array().cast(own.schema["zones"].dataType)), lambda z: F.col("me.x").between(z["x0"] - mx, z["x1"] + mx) & F.col("me.y").between(z["y0"] - my, z["y1"] + my))
    begin = lives.groupBy("game_id").agg(*[F.avg(F.when((F.col("slot") <= 4) == F.lit(t == "a"), F.col(c))).alias(f"{t}{c[0]}") for t in "ab" for c in ("x0", "y0")])
    sides = zones.groupBy("game_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("team") == t, F.col("zone")))).alias(f"z{t.lower()}") for t in "AB"]).select("game_id", (F.col("za") != F.col("zb")).alias("axis"))
    listed = points.groupBy("game_id").agg(F.collect_list(F.struct("t0", "t1", "rect")).alias("points"))
    rows = rows.where(~inside).join(begin, "game_id", "left").join(sides, "game_id", "left").join(listed, "game_id", "left")
    a = F.col("slot") <= 4
    ox, oy, tx, ty = (F.when(a, F.col(p)).otherwise(F.col(q)) for p, q in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay")))
    ux, uy = (tx - ox) * ARENA_M[0], (ty - oy) * ARENA_M[1]
    n2 = ux * ux + uy * uy
    part = ((F.col("me.x") - ox) * ARENA_M[0] * ux + (F.col("me.y") - oy) * ARENA_M[1] * uy) / F.when(n2 >= 1e-9, n2)
    t = F.col("i") * limits.step
    near = F.exists("points", lambda p: (p["t0"] <= t) & (t < p["t1"]) & (C.rect_metres(F.col("me.x"), F.col("me.y"), p["rect"]) <= limits.near))
    closest = F.array_min(F.transform(_mates(F.col("slot"), "players"), lambda q: _apart(q, F.col("me"))))
    values = rows.groupBy(*PLAYER).agg(F.count("*").alias("n"), F.avg(near.cast("double")).alias("objective"), F.avg(F.when(F.col("axis") & part.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))).alias("space"), F.avg(closest).alias("cohesion"))
    length = games.select("game_id", (F.floor(F.col("duration") / limits.step) + 1).alias("steps"))
    return values.join(length, "game_id").select(*PLAYER, (F.col("n") / F.col("steps")).alias("presence"), "objective", "space", "cohesion")


def fight_values(grid: DataFrame, focused: DataFrame, games: DataFrame, limits: RatingLimits = RatingLimits()) -> DataFrame:
    """game_id, slot, fight_front, fight_first_kill: the share of fights with somebody in front in which a player is, and of all
    fights that its kill opens."""
    opened = focused.groupBy("game_id", "run").agg(F.min(F.struct("nth", "t", "killer_slot")).alias("k")).select("game_id", "run", "k.t", "k.killer_slot")
    counted = opened.groupBy("game_id").agg(F.count("*").alias("fights"))
    last = games.select("game_id", F.floor(F.col("duration") / limits.step).cast("int").alias("last"))
    at = opened.join(last, "game_id").withColumn("i", F.greatest(F.lit(0), F.least("last", F.rint((F.col("t") - limits.front_lead) / limits.step).cast("int"))))
    rows = _each(at.select("game_id", "run", "i").join(grid, ["game_id", "i"]).withColumn("i", F.struct("run", "i"))).withColumn("run", F.col("i.run"))
    far = F.array_min(F.transform(_enemies(F.col("slot"), "players"), lambda q: _apart(q, F.col("me"))))
    front = rows.withColumn("far", far).where(F.col("far") <= limits.front_m).groupBy("game_id", "run", team_of(F.col("slot")).alias("team")).agg(F.min(F.struct("far", "slot")).alias("m"))
    fronts = front.groupBy("game_id", "team").agg(F.count("*").alias("of_team"))
    made = front.groupBy("game_id", F.col("m.slot").alias("slot")).agg(F.count("*").alias("front"))
    first = opened.groupBy("game_id", F.col("killer_slot").alias("slot")).agg(F.count("*").alias("first"))
    slots = counted.withColumn("slot", C.slots()).withColumn("team", team_of(F.col("slot")))
    rows = slots.join(fronts, ["game_id", "team"], "left").join(made, PLAYER, "left").join(first, PLAYER, "left").fillna(0, ["front", "first"])
    return rows.select(*PLAYER, F.try_divide("front", "of_team").alias("fight_front"), F.try_divide("first", "fights").alias("fight_first_kill"))


def aggro_values(grid: DataFrame, lives: DataFrame, links: DataFrame, limits: RatingLimits = RatingLimits()) -> DataFrame:
    """game_id, slot, aggro_s: seconds in which one or two enemies close in on a player and on no team-mate of it.

    An episode counts in part where the player dies soon after and the death is neither traded nor avenged.
    """
    k = max(1, round(limits.closing_s / limits.step))
    before = grid.select("game_id", (F.col("i") + k).alias("i"), F.col("players").alias("old"))
    rows = _each(grid).join(before, ["game_id", "i"]).withColumn("was", F.get(F.filter("old", lambda q: q["slot"] == F.col("slot")), F.lit(0))).where("was IS NOT NULL")

    def closes(q: Column) -> Column:
        then = F.get(F.filter("old", lambda o: o["slot"] == q["slot"]), F.lit(0))
        alone = ~F.exists(_mates(F.col("slot"), "players"), lambda m: _apart(m, q) <= limits.help)
        return then.isNotNull() & (_apart(q, F.col("me")) <= limits.aggro_m) & (_apart(then, F.col("was")) - _apart(q, F.col("me")) >= limits.closing) & alone

    active = rows.where(F.size(F.filter(_enemies(F.col("slot"), "players"), closes)).between(1, limits.most_enemies)).select(*PLAYER, "i", (F.col("i") * limits.step).alias("t"))
    episodes = sessions(active, PLAYER, ["t"], limits.episode + 1e-9).groupBy(*PLAYER, "run").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    episodes = written(episodes.select(*PLAYER, "run", ((F.col("b") - F.col("a") + 1) * limits.step).alias("seconds"), (F.col("b") * limits.step).alias("t_end")), "aggro-episodes")
    ends = lives.where("ended = 'death'").select(*PLAYER, F.col("t1").alias("death"))
    dies = episodes.join(ends, PLAYER).where((F.col("death") >= F.col("t_end") - 1e-6) & (F.col("death") <= F.col("t_end") + limits.survive + 1e-6)).groupBy(*PLAYER, "run").agg(F.min("death").alias("death"))
    traded = links.where("kind = 'trade'").select("game_id", F.col("victim_slot").alias("slot"), F.col("t").alias("paid"))
    avenged = links.where("kind = 'revenge'").select("game_id", F.col("other_slot").alias("slot"), (F.col("t") - F.coalesce("dt", F.lit(0.0))).alias("paid"))
    paid = dies.join(traded.unionByName(avenged), PLAYER).where(F.abs(F.col("paid") - F.col("death")) <= limits.avenge).select(*PLAYER, "run").distinct().withColumn("paid", F.lit(True))
    rows = episodes.join(dies, [*PLAYER, "run"], "left").join(paid, [*PLAYER, "run"], "left")
    factor = F.when(F.col("death").isNull() | F.col("paid"), 1.0).otherwise(limits.unavenged)
    return rows.groupBy(*PLAYER).agg(F.sum(F.col("seconds") * factor).alias("aggro_s"))


def assists_near(grid: DataFrame, deaths: DataFrame, games: DataFrame, limits: RatingLimits = RatingLimits()) -> DataFrame:
    """game_id, slot, assists: of deaths (game_id, t, victim_slot, killer_slot, x, y), those with the killer's team-mate beside the
    victim at a step of the last `assist_s` seconds; a victim without a position is where it died."""
    last = games.select("game_id", F.floor(F.col("duration") / limits.step).cast("int").alias("last"))
    index = lambda t: F.greatest(F.lit(0), F.least("last", F.rint(t / limits.step).cast("int")))
    spans = deaths.join(last, "game_id").select("game_id", "t", "victim_slot", "killer_slot", "x", "y", F.explode(F.sequence(index(F.col("t") - limits.assist_s), index(F.col("t")))).alias("i"))
    rows = spans.join(grid, ["game_id", "i"]).withColumn("v", F.get(F.filter("players", lambda p: p["slot"] == F.col("victim_slot")), F.lit(0)))
    at = F.struct(F.coalesce("v.x", "x").alias("x"), F.when(F.col("v").isNotNull(), F.col("v.y")).otherwise(F.col("y")).alias("y"))
    near = F.filter(_mates(F.col("killer_slot"), "players"), lambda m: _apart(m, F.col("at")) <= limits.assist_m)
    helpers = rows.withColumn("at", at).select("game_id", "t", "victim_slot", F.explode(near).alias("m")).select("game_id", "t", "victim_slot", F.col("m.slot").alias("slot")).distinct()
    return helpers.groupBy(*PLAYER).agg(F.count("*").alias("assists"))


def _avengers(links: DataFrame, kills: DataFrame, limits: RatingLimits) -> DataFrame:
    """game_id, slot: who made the kill of each revenge: the link's killer_slot where links have it, else the killer of the first kill beside it."""
    if "killer_slot" in links.columns:
        return links.select("game_id", F.col("killer_slot").alias("slot"))
    own = kills.select("game_id", "victim_slot", F.col("t").alias("kt"), "killer_slot")
    near = within(links.select("game_id", "t", "victim_slot"), own, ["game_id", "victim_slot"], "t", "kt", -limits.same_kill, limits.same_kill)
    return near.groupBy("game_id", "t", "victim_slot").agg(F.min_by("killer_slot", "kt").alias("slot")).select(*PLAYER)


def raw_components(games: DataFrame, lives: DataFrame, samples: DataFrame, kills: DataFrame, focused: DataFrame, zones: DataFrame, points: DataFrame, kill_scores: DataFrame, links: DataFrame, stats: DataFrame, board: DataFrame | None = None, limits: RatingLimits = RatingLimits()) -> DataFrame:
    """game_id, slot, assists, assist_source and the seventeen components of every slot that has a life.

    lives have killer_slot; a death counts as a kill for an opponent. Assists are the board's where it tells them for all slots of a game
    (source 'board'), else those measured (source 'measured'). A component without data is null.
    """
    grid = written(position_grid(games, lives, samples, limits), "rating-grid")
    ended = lives.where("ended = 'death'")
    deaths = ended.groupBy(*PLAYER).agg(F.count("*").alias("deaths"))
    opposed = team_of(F.col("killer_slot")) != team_of(F.col("slot"))
    events = ended.where(opposed).select("game_id", F.col("t1").alias("t"), F.col("slot").alias("victim_slot"), "killer_slot", F.col("x1").alias("x"), F.col("y1").alias("y"))
    made = events.groupBy("game_id", F.col("killer_slot").alias("slot")).agg(F.count("*").alias("kills"))
    slots = written(lives.select(*PLAYER).distinct(), "rated-slots")
    measured = slots.join(assists_near(grid, events, games, limits), PLAYER, "left").select(*PLAYER, F.coalesce("assists", F.lit(0)).alias("measured"))
    if board is None:
        assists = measured.select(*PLAYER, F.col("measured").alias("assists"), F.lit("measured").alias("assist_source"))
    else:
        told = measured.join(board.select(*PLAYER, F.col("assists").alias("told")), PLAYER, "left")
        whole = F.count("told").over(Window.partitionBy("game_id")) == F.count("*").over(Window.partitionBy("game_id"))
        assists = told.select(*PLAYER, F.when(whole, F.col("told")).otherwise(F.col("measured")).cast("long").alias("assists"), F.when(whole, "board").otherwise("measured").alias("assist_source"))
    killed = kill_scores.groupBy("game_id", F.col("killer_slot").alias("slot")).agg(F.avg("impact").alias("kill_quality"))
    lost = kill_scores.groupBy("game_id", F.col("victim_slot").alias("slot")).agg(F.avg(F.coalesce("death_impact", -F.col("impact"))).alias("death_quality"))
    revenges = _avengers(links.where("kind = 'revenge'"), kills, limits).groupBy(*PLAYER).agg(F.count("*").alias("revenges"))
    rows = slots.join(games.select("game_id", (F.col("duration") / limits.minute).alias("minutes")), "game_id")
    parts = (made, deaths, assists, killed, lost, revenges, written(presence_values(grid, games, zones, points, lives, limits), "presence-values"), written(fight_values(grid, focused, games, limits), "fight-values"),
             written(aggro_values(grid, lives, links, limits), "aggro-values"), stats.select(*PLAYER, "gadget_uses", "gadget_possible"))
    for part in parts:
        rows = rows.join(part, PLAYER, "left")
    rows = rows.fillna(0, ["kills", "deaths", "assists", "revenges", "presence"]).fillna(0.0, ["aggro_s"])
    team = Window.partitionBy("game_id", F.col("slot") <= 4)
    of_team = {c: F.sum(c).over(team) for c in ("kills", "deaths", "assists")}
    share = lambda c: F.try_divide(F.col(c), of_team[c])
    mates = of_team["deaths"] - F.col("deaths")
    values = {"kills_per_min": F.col("kills") / F.col("minutes"), "deaths_per_min": F.col("deaths") / F.col("minutes"), "assists_per_min": F.col("assists") / F.col("minutes"), "share_kills": share("kills"), "share_deaths": share("deaths"),
              "share_assists": share("assists"), "aggro": F.col("aggro_s") / F.col("minutes"), "trades": F.when(mates > 0, F.col("revenges") / mates), "gadget": F.when((F.col("gadget_possible") > 0) & F.col("gadget_uses").isNotNull(), F.least(F.lit(1.0), F.col("gadget_uses") / F.col("gadget_possible")))}
    return rows.withColumns(values).select(*PLAYER, "assists", "assist_source", *[F.col(c[0]).cast("double").alias(c[0]) for c in COMPONENTS])


def _unpivoted(raws: DataFrame) -> DataFrame:
    """game_id, slot, assist_source, component, raw, and the component's key of the scale."""
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("raw"), (F.concat(F.lit(f"{c}:"), "assist_source") if c in SOURCED else F.lit(c)).alias("key")) for c, *_ in COMPONENTS]))
    return raws.select(*PLAYER, listed.alias("c")).select(*PLAYER, "c.*")


def calibrated(raws: DataFrame) -> DataFrame:
    """key, p05, p50, p95 and n of the components' values: the scale, by interpolating percentiles."""
    p = F.percentile("raw", [0.05, 0.5, 0.95])
    return _unpivoted(raws).where("raw IS NOT NULL").groupBy("key").agg(p.alias("p"), F.count("*").alias("n")).select("key", F.col("p")[0].alias("p05"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"), "n")


def note_20(value: Column, low: Column, mid: Column, high: Column, down: Column) -> Column:
    """0 at low, 10 at mid, 20 at high, by lines between and held beyond; turned round where less is better, null without a value or scale."""
    under = F.when(mid > low, 10.0 * (value - low) / F.when(mid > low, mid - low)).otherwise(F.when(value == mid, 10.0).otherwise(0.0))
    over = F.when(high > mid, 10.0 + 10.0 * (value - mid) / F.when(high > mid, high - mid)).otherwise(20.0)
    held = F.greatest(F.lit(0.0), F.least(F.lit(20.0), F.when(value <= mid, under).otherwise(over)))
    return F.when(value.isNotNull() & mid.isNotNull(), F.when(down, 20.0 - held).otherwise(held))


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "component string, part string, weight int, down boolean")


def rate_players(raws: DataFrame, scale: DataFrame, limits: RatingLimits = RatingLimits()) -> DataFrame:
    """game_id, slot, individual, teamplay, overall and notes (component, raw, note) of every slot.

    A note's mean is weighted over the components that have a value and a scale; it is null where these are less than
    `coverage` of the weight. The overall note is the mean of both, null where one is.
    """
    # seventeen components: both dimensions are small by construction
    rows = _unpivoted(raws).join(F.broadcast(_weights(raws.sparkSession)), "component").join(F.broadcast(scale.select("key", "p05", "p50", "p95")), "key", "left")
    rows = rows.withColumn("note", rounded(note_20(*map(F.col, ("raw", "p05", "p50", "p95", "down"))), 2))
    has = F.when(F.col("note").isNotNull(), F.col("weight"))

    def of(part: str) -> Column:
        own = F.col("part") == part
        share = F.sum(F.when(own, has)) / F.sum(F.when(own, F.col("weight")))
        return F.when(share >= limits.coverage, F.round(F.sum(F.when(own, F.col("note") * has)) / F.sum(F.when(own, has)), 2)).alias(part)

    rated = rows.groupBy(*PLAYER).agg(of("individual"), of("teamplay"), F.sort_array(F.collect_list(F.struct("component", rounded(F.col("raw"), 4).alias("raw"), "note"))).alias("notes"))
    return rated.select(*PLAYER, "individual", "teamplay", F.round((F.col("individual") + F.col("teamplay")) / 2, 2).alias("overall"), "notes")
