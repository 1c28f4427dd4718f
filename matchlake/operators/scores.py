"""What a kill is worth to its team, and a death to the victim's: bounded sums of reasons.

Both are told by the numbers of players near the place before and after, by the wave, the point and the fight they
belong to. Frames as in `combat` and `waves`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.geometry import metres
from matchlake.operators import combat as C
from matchlake.operators.combat import FightLimits
from matchlake.operators.joins import asof
from matchlake.operators.match import team_of
from matchlake.scratch import written

KILL = ["game_id", "nth"]


@dataclass(frozen=True)
class ScoreLimits:
    """Seconds and metres, and what each reason counts."""

    lowest: float = -2.0
    highest: float = 3.0
    base: float = 1.0
    superiority: float = 1.0
    first_of_wave: float = 1.0
    point: float = 1.0
    death: float = -1.0
    traded_death: float = -0.5
    shield: float = 2.0
    trade: float = 1.0  # between the deaths of victim and killer
    before: float = 0.3  # before the death, players are counted
    after: float = 0.5  # and after it
    window: float = 20.0  # in which the point is taken or held
    point_m: float = 7.0
    enemies: int = 2  # that make pressure on the victim
    lookback: float = 3.0
    step: float = 0.5
    margin: int = 1  # of losses that makes a fight won


def _deaths(kills: DataFrame, lives: DataFrame, limits: ScoreLimits, fight_limits: FightLimits) -> DataFrame:
    """kills with t_death, the end of the victim's life if one is near, matched, and trade, whether the killer dies then too."""
    ends = lives.where("ended = 'death'")
    own = ends.select("game_id", F.col("slot").alias("victim_slot"), F.col("t1").alias("t"), F.col("t1").alias("end"))
    rows = asof(kills, own, ["game_id", "victim_slot"], "t", ["end"], fight_limits.death).drop("found_t")
    rows = rows.withColumn("matched", F.col("end").isNotNull()).withColumn("t_death", F.coalesce("end", "t")).drop("end")
    other = ends.select("game_id", F.col("slot").alias("killer_slot"), F.col("t1").alias("t_death"), F.col("t1").alias("its_end"))
    rows = asof(rows, other, ["game_id", "killer_slot"], "t_death", ["its_end"], limits.trade).drop("found_t")
    return rows.withColumn("trade", F.col("matched") & F.col("its_end").isNotNull()).drop("its_end")


def _numbers(rows: DataFrame, lives: DataFrame, samples: DataFrame, limits: ScoreLimits, fight_limits: FightLimits) -> DataFrame:
    """By kill: n_before and m_before, of the killer's and the victim's team near the place, own_after and their_after, of the
    victim's team and the killer's without the victim, and pressure, the most enemies near the victim at a step before its death."""
    n = round(limits.lookback / limits.step)
    moments = [("before", -limits.before), ("after", limits.after), *[(f"step{i}", -limits.lookback + i * limits.step) for i in range(n + 1)]]
    asks = rows.select(*KILL, "killer_slot", "victim_slot", "x", "y", F.explode(F.array(*[F.struct(F.lit(w).alias("what"), (F.col("t_death") + d).alias("t")) for w, d in moments])).alias("m"))
    asks = asks.select("game_id", "nth", "killer_slot", "victim_slot", F.col("x").alias("cx"), F.col("y").alias("cy"), "m.what", "m.t")
    players = C.around(asks, lives, samples, fight_limits.position)
    victim = F.get(F.filter("players", lambda p: p["slot"] == F.col("victim_slot")), F.lit(0))
    vx, vy = F.coalesce(victim["x"], F.col("cx")), F.when(victim["x"].isNotNull(), victim["y"]).otherwise(F.col("cy"))

    def near(p: Column, x: Column, y: Column) -> Column:
        return p["living"] & F.coalesce(metres(p["x"] - x, p["y"] - y) <= fight_limits.help, F.lit(False))

    def of_team(p: Column, slot: str) -> Column:
        return (p["slot"] <= 4) == (F.col(slot) <= 4)

    def count(test) -> Column:
        return F.size(F.filter("players", test))

    here = {"n": lambda p: of_team(p, "killer_slot") & ((p["slot"] == F.col("killer_slot")) | near(p, F.col("cx"), F.col("cy"))),
            "m": lambda p: of_team(p, "victim_slot") & ((p["slot"] == F.col("victim_slot")) | near(p, F.col("cx"), F.col("cy"))),
            "own": lambda p: of_team(p, "victim_slot") & (p["slot"] != F.col("victim_slot")) & near(p, F.col("cx"), F.col("cy")),
            "their": lambda p: of_team(p, "killer_slot") & near(p, F.col("cx"), F.col("cy")),
            "enemies": lambda p: of_team(p, "killer_slot") & near(p, vx, vy)}
    counted = players.select(*KILL, "what", *[count(test).alias(name) for name, test in here.items()])
    at = lambda what, name: F.max(F.when(F.col("what") == what, F.col(name)))
    return counted.groupBy(*KILL).agg(at("before", "n").alias("n_before"), at("before", "m").alias("m_before"), at("after", "own").alias("own_after"), at("after", "their").alias("their_after"),
                                      F.max(F.when(F.startswith("what", F.lit("step")), F.col("enemies"))).alias("pressure"))


def _points(rows: DataFrame, line: DataFrame, captures: DataFrame, instances: DataFrame, limits: ScoreLimits) -> DataFrame:
    """The kills after which the killer's team takes or holds a point near the victim's place."""
    last = line.groupBy("game_id", "inst").agg(F.max("t1").alias("read_until"))
    near = rows.select(*KILL, "t", team_of(F.col("killer_slot")).alias("team"), "x", "y").join(instances.select("game_id", "inst", "rect", F.col("t0").alias("i0"), F.col("t1").alias("i1")).join(last, ["game_id", "inst"]), "game_id")
    near = near.where((F.col("t") >= F.col("i0") - 1) & (F.col("t") <= F.col("i1") + 1) & (C.rect_metres(F.col("x"), F.col("y"), F.col("rect")) <= limits.point_m))
    near = near.withColumn("until", F.least(F.col("t") + limits.window, F.col("read_until") - 0.01, F.col("i1") - 0.01)).select(*KILL, "t", "team", "inst", "until")
    # the next capture after the kill, and what each moment's team held last: a moment meets one row, not all of its time
    soon = captures.select("game_id", "team", "inst", (-F.col("t")).alias("t"), F.col("t").alias("cap_t"))
    takes = asof(near.withColumns({"t": -F.col("t"), "end": F.col("t") + limits.window}), soon, ["game_id", "team", "inst"], "t", ["cap_t"], direction="backward").where("cap_t <= end").select(*KILL)
    held = line.where("holder IS NOT NULL").select("game_id", "inst", F.col("holder").alias("team"), (F.col("t0") - 1e-6).alias("t"), F.col("t1").alias("h1"))
    moments = near.where("until > t").select(*KILL, "inst", "team", F.explode(F.array(F.struct(F.lit(False).alias("last"), F.col("t")), F.struct(F.lit(True).alias("last"), F.col("until").alias("t")))).alias("s")).select(*KILL, "inst", "team", "s.*")
    met = asof(moments, held, ["game_id", "inst", "team"], "t", ["h1"], direction="backward").where("t < h1")
    holds = met.groupBy(*KILL, "inst").agg(F.bool_or(~F.col("last")).alias("first"), F.bool_or("last").alias("then")).where("first AND then").select(*KILL)
    return takes.unionByName(holds).distinct().withColumn("point", F.lit(True))


def score_kills(focused: DataFrame, fights: DataFrame, waves: DataFrame, line: DataFrame, captures: DataFrame, instances: DataFrame, lives: DataFrame, samples: DataFrame, limits: ScoreLimits = ScoreLimits(), fight_limits: FightLimits = FightLimits()) -> DataFrame:
    """game_id, t, killer_slot, victim_slot, impact, death_impact and reasons of every kill by an opponent.

    A kill counts one, and one more each if its team outnumbers the others near the place afterwards, if it is the
    first contact of a wave, and, where the team outnumbers, if it takes or holds the point. A death counts minus one,
    half of it where the killer dies too, and two more for a shield: it drew enemies, and its team then outnumbers them
    and wins the fight. Numbers, trades and shields need the end of the victim's life.
    """
    rows = written(_deaths(focused, lives, limits, fight_limits), "scored-kills")
    rows = rows.join(_numbers(rows, lives, samples, limits, fight_limits), KILL)
    rows = rows.join(fights.select("game_id", "run", "kind", "lost_a", "lost_b"), ["game_id", "run"], "left")
    first = waves.where("t_contact IS NOT NULL").select("game_id", F.round(F.col("t_contact") * 1000).cast("long").alias("ms")).distinct().withColumn("wave", F.lit(True))
    rows = rows.withColumn("ms", F.round(F.col("t") * 1000).cast("long")).join(first, ["game_id", "ms"], "left").join(_points(rows, line, captures, instances, limits), KILL, "left")
    outnumbers = F.col("matched") & (F.col("n_before") - F.col("trade").cast("int") > F.col("m_before") - 1)
    own = F.when(F.col("victim_slot") <= 4, F.col("lost_b") - F.col("lost_a")).otherwise(F.col("lost_a") - F.col("lost_b"))
    won = F.coalesce((F.col("kind") == "teamfight") & (own >= limits.margin), F.lit(False))
    shield = F.col("matched") & (F.col("pressure") >= limits.enemies) & (F.col("own_after") > F.col("their_after")) & won
    rows = rows.withColumns({"outnumbers": outnumbers, "shielded": shield, "wave": F.coalesce("wave", F.lit(False)), "point": F.coalesce("point", F.lit(False))})
    counts = lambda test, value: F.when(test, value).otherwise(0.0)
    impact = F.lit(limits.base) + counts(F.col("outnumbers"), limits.superiority) + counts(F.col("wave"), limits.first_of_wave) + counts(F.col("point") & F.col("outnumbers"), limits.point)
    death = F.when(F.col("trade"), limits.traded_death).otherwise(limits.death) + counts(F.col("shielded"), limits.shield)
    told = [("unmatched", ~F.col("matched")), ("superiority", F.col("outnumbers")), ("trade", F.col("trade")), ("first_of_wave", F.col("wave")), ("point", F.col("point") & F.col("outnumbers")), ("point_without_superiority", F.col("point") & ~F.col("outnumbers")),
            ("shield", F.col("shielded"))]
    reasons = F.filter(F.array(F.lit("threat"), *[F.when(test, name) for name, test in told]), lambda r: r.isNotNull())
    return rows.select("game_id", F.round("t", 3).alias("t"), "killer_slot", "victim_slot", F.greatest(F.lit(limits.lowest), F.least(F.lit(limits.highest), impact)).alias("impact"), death.alias("death_impact"), reasons.alias("reasons"))
