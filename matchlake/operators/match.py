"""Derived tables of matches: kill links, scores, retakes, rotations and ratings, as set-based plans by game.

Frames have the columns of the match tables: lives (game_id, slot, idx, t0, t1, ended, killer_slot, kill_kind), kills
(game_id, t, killer_slot, victim_slot, kind), samples (game_id, slot, t, x, y, alive), point_owner (game_id, point, t0,
t1, owner), episodes and so on; slots 1-4 are team A, 5-8 team B; times are seconds of the game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import metres
from matchlake.operators.aggregates import rounded
from matchlake.operators.joins import asof, points_in_intervals, within
from matchlake.operators.stateful import mutual_pairs

# Limits of trades and revenges, in seconds and metres.
TRADE_S, REVENGE_S, REVENGE_M, POSITION_S = 1.0, 5.0, 12.0, 3.0


def team_of(slot: Column) -> Column:
    return F.when(slot <= 4, "A").when(slot <= 8, "B")


def valid_kills(kills: DataFrame, kinds: tuple[str, ...] | None = ("kill", "inferred")) -> DataFrame:
    """Kills by a known opponent; `kinds` None takes any kind."""
    opposed = F.col("killer_slot").isNotNull() & (F.col("killer_slot") != F.col("victim_slot")) & (team_of(F.col("killer_slot")) != team_of(F.col("victim_slot")))
    return kills.where(opposed if kinds is None else opposed & F.col("kind").isin(list(kinds)))


def _located(kills: DataFrame, samples: DataFrame) -> DataFrame:
    """Kills with the victim's nearest position, at most POSITION_S away."""
    spots = samples.where("alive AND x IS NOT NULL AND y IS NOT NULL").select("game_id", F.col("slot").alias("victim_slot"), "t", "x", "y")
    return asof(kills, spots, ["game_id", "victim_slot"], "t", ["x", "y"], POSITION_S).drop("found_t")


def trades(kills: DataFrame) -> DataFrame:
    """Pairs of kills in which both players kill each other within TRADE_S, each kill once, closest first."""
    valid = valid_kills(kills).withColumn("id", F.row_number().over(Window.partitionBy("game_id").orderBy("t", "victim_slot")))
    typed = valid.select(F.col("game_id").cast("long").alias("game_id"), "id", "t", F.col("killer_slot").cast("int").alias("killer"), F.col("victim_slot").cast("int").alias("victim"))
    return typed.groupBy("game_id").applyInPandas(lambda rows: mutual_pairs(rows, TRADE_S), "game_id long, p int, q int, ta double, a int, tb double, b int, dt double")


def revenges(kills: DataFrame, samples: DataFrame) -> DataFrame:
    """Kills of a player who killed a team-mate of the killer at most REVENGE_S before and REVENGE_M away; an unknown distance passes."""
    valid = _located(valid_kills(kills).select("game_id", "t", "killer_slot", "victim_slot"), samples)
    lost = valid.select("game_id", F.col("killer_slot").alias("target"), F.col("victim_slot").alias("lost_slot"), F.col("t").alias("ta"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    paid = valid.select("game_id", F.col("victim_slot").alias("target"), F.col("killer_slot").alias("avenger"), F.col("t").alias("tb"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    far = metres(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))
    pairs = within(lost, paid, ["game_id", "target"], "ta", "tb", 0.0, REVENGE_S).where((team_of(F.col("avenger")) == team_of(F.col("lost_slot"))) & (F.col("avenger") != F.col("lost_slot")))
    near = pairs.withColumn("dist_m", far).where(F.col("dist_m").isNull() | (F.col("dist_m") <= REVENGE_M))
    best = near.groupBy("game_id", "target", "avenger", "tb").agg(F.max(F.struct("ta", "lost_slot", "dist_m")).alias("m"))
    return best.select("game_id", F.col("tb").alias("t"), F.col("target").alias("victim_slot"), F.lit("revenge").alias("kind"), F.col("m.lost_slot").alias("other_slot"), (F.col("tb") - F.col("m.ta")).alias("dt"), F.col("m.dist_m").alias("dist_m"))


def kill_links(kills: DataFrame, samples: DataFrame) -> DataFrame:
    """Trades, one row for each of both kills, and revenges."""
    both = trades(kills)
    rows = both.select(F.col("game_id"), F.explode(F.array(F.struct(F.col("ta").alias("t"), F.col("q").alias("victim_slot"), F.col("p").alias("other_slot")), F.struct(F.col("tb").alias("t"), F.col("p").alias("victim_slot"), F.col("q").alias("other_slot")))).alias("r"), "dt")
    traded = rows.select("game_id", "r.t", "r.victim_slot", F.lit("trade").alias("kind"), "r.other_slot", "dt", F.lit(None).cast("double").alias("dist_m"))
    return traded.unionByName(revenges(kills, samples))


def kills_and_deaths(lives: DataFrame) -> DataFrame:
    """game_id, slot, kills, deaths from the ends of lives; a kill needs an opponent and is no suicide or environment."""
    ended = lives.where("ended = 'death'")
    counted = ended.where((team_of(F.col("killer_slot")) != team_of(F.col("slot"))) & ~F.coalesce(F.col("kill_kind"), F.lit("")).isin("suicide", "environment"))
    made = counted.groupBy("game_id", F.col("killer_slot").alias("slot")).agg(F.count("*").alias("kills"))
    died = ended.groupBy("game_id", "slot").agg(F.count("*").alias("deaths"))
    return made.join(died, ["game_id", "slot"], "full").fillna(0, ["kills", "deaths"])


def life_at(points: DataFrame, lives: DataFrame, slack: float = 1e-6) -> DataFrame:
    """points (game_id, slot, t, ...) with the idx of the life that holds t, ends included."""
    spans = lives.select("game_id", "slot", "idx", F.col("t0").alias("life_t0"), F.col("t1").alias("life_t1"))
    return points_in_intervals(points, spans, ["game_id", "slot"], "t", "life_t0", "life_t1", 60.0, slack)


def owner_timeline(owners: DataFrame, ignore: float = 2.0, hold: float = 30.0) -> DataFrame:
    """Holdings (owner A or B) of at least `ignore` seconds, each kept through neutral time for at most `hold` seconds."""
    real = owners.where(F.col("owner").isin("A", "B") & (F.col("t1") - F.col("t0") >= ignore))
    w = Window.partitionBy("game_id", "point").orderBy("t0")
    following = F.lead("t0").over(w)
    return real.withColumn("t1", F.greatest(F.col("t1"), F.least(F.coalesce(following, F.col("t1")), F.col("t1") + hold)))


def captures(owners: DataFrame, adjacent: float = 3.0) -> DataFrame:
    """Moments at which a point changes hands; the first holding counts only if it starts at most `adjacent` after neutral time."""
    w = Window.partitionBy("game_id", "point").orderBy("t0")
    steps = owners.withColumn("before", F.last(F.when(F.col("owner") != "none", F.col("owner")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    steps = steps.withColumn("gap", F.col("t0") - F.lag("t1").over(w)).withColumn("last", F.lag("owner").over(w)).where("owner <> 'none'")
    changed = (F.col("before") != F.col("owner")) | (F.col("before").isNull() & (F.col("last") == "none") & (F.col("gap") <= adjacent))
    return steps.where(changed).select("game_id", "point", F.col("t0").alias("t"), F.col("owner").alias("team"), "before")


def point_changes(active: DataFrame, fixed_maps: DataFrame | None = None) -> DataFrame:
    """How often consecutive active segments of a game name another point; 0 for the games in fixed_maps."""
    w = Window.partitionBy("game_id").orderBy("t0", "point")
    counted = active.withColumn("changed", (F.col("point") != F.lag("point").over(w)).cast("int")).groupBy("game_id").agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"))
    if fixed_maps is None:
        return counted
    return counted.join(fixed_maps.select("game_id", F.lit(True).alias("fixed")), "game_id", "left").select("game_id", F.when(F.col("fixed"), F.lit(0)).otherwise(F.col("changes")).alias("changes"))


def wave_tally(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Waves, their outcomes, how many are decided and the success rate; episodes marked 'ko' or without a wave do not count."""
    counted = episodes.where((F.coalesce(F.col("verdict"), F.lit("")) != "ko") & F.col("has_wave"))
    by = counted.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))
    decided = F.sum(F.when(F.col("outcome").isin("success", "fail", "won_no_capture"), F.col("n")).otherwise(0))
    won = F.sum(F.when(F.col("outcome") == "success", F.col("n")).otherwise(0))
    return by.groupBy(*keys).agg(F.sum("n").alias("waves"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"), decided.alias("decided"), rounded(F.try_divide(won, decided), 3).alias("rate"))


def gadget_use(states: DataFrame, lives: DataFrame, delays: DataFrame) -> DataFrame:
    """By life: uses, first use, ready and used seconds, unused at death, and how many uses the delay allowed."""
    w = Window.partitionBy("game_id", "slot").orderBy("t0")
    known = states.where("state <> 'unknown'").withColumn("before", F.lag("state").over(w))
    spans = lives.select("game_id", "slot", "idx", "ended", F.col("t0").alias("life_t0"), F.col("t1").alias("life_t1"))
    # a life has few segments and a slot few lives: equal keys bound the pairs
    met = known.join(spans, ["game_id", "slot"]).withColumn("shared", F.least("t1", "life_t1") - F.greatest("t0", "life_t0")).where("shared > 0")
    starts = (F.col("state") == "used") & (F.coalesce(F.col("before"), F.lit("")) != "used") & F.col("t0").between(F.col("life_t0"), F.col("life_t1"))
    per = met.groupBy("game_id", "slot", "idx", "ended", "life_t0", "life_t1", "gadget").agg(
        F.count_if(starts).alias("uses"), F.min(F.when(starts, F.col("t0") - F.col("life_t0"))).alias("first_use"), F.sum(F.when(F.col("state") == "ready", F.col("shared")).otherwise(0.0)).alias("ready_s"),
        F.sum(F.when(F.col("state") == "used", F.col("shared")).otherwise(0.0)).alias("used_s"), F.max_by("state", "t1").alias("last"))
    per = per.join(F.broadcast(delays), "gadget", "left")
    return per.select("game_id", "slot", "idx", "gadget", "uses", "first_use", "ready_s", "used_s", ((F.col("ended") == "death") & (F.col("last") == "ready")).alias("unused_at_death"),
                      F.when(F.col("delay") > 0, 1 + F.floor((F.col("life_t1") - F.col("life_t0")) / F.col("delay"))).alias("possible"))
