"""Duels: fights of two opponents, by a kill or by hit points alone.

A duel goes from the first loss of hit points to a death or to the moment one of both begins to recover. A kill by a
third player interrupts it; who has clearly more hit points left at the end wins it. Hit points are a frame (game_id,
slot, t, hp) with hp from 0 to 1, null where they cannot be read or the player is dead.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import metres
from matchlake.operators import combat as C
from matchlake.operators.combat import FightLimits
from matchlake.operators.joins import overlaps, points_in_intervals, within
from matchlake.operators.match import team_of
from matchlake.operators.series import trailing_max
from matchlake.scratch import written

TRACK = ["game_id", "slot"]


@dataclass(frozen=True)
class DuelLimits:
    """Seconds, metres and shares of hit points that decide what is a duel."""

    window: float = 0.4  # in which hit points must fall
    drop: float = 0.06 / 0.83  # by so much
    hit_gap: float = 2.0  # between two hits of one stretch
    flat: float = 0.015  # above the lowest value, still no recovery
    rise: float = 0.05  # above the lowest value, a recovery
    longest: float = 15.0  # after the last hit, no recovery is looked for
    observed: float = 1.0  # after the last hit, an earlier recovery is noise
    delay: float = 4.6  # to a recovery that is not seen
    before_end: float = 0.5  # a death so long before the last hit still belongs to it
    after_end: float = 2.5
    lookback: float = 6.0  # before a kill, for the first loss
    least: float = 1.0  # length of a duel without losses
    loss: float = 0.15  # of either player
    apart: float = 1.0  # between the losses of both
    metres: float = 14.0
    margin: float = 0.10  # of hit points that wins
    context: tuple[float, float] = (1.0, 3.0)  # around a stretch, kills of its player
    match: tuple[float, float] = (1.0, 3.0)  # around a death, its kill
    settle: float = 0.3  # before the end, hit points are read
    lead: float = 0.5  # before the start, hit points are read
    blank: float = 2.0  # at the end of a game nothing can be read


def damage_stretches(hp: DataFrame, lives: DataFrame, limits: DuelLimits = DuelLimits()) -> DataFrame:
    """game_id, slot, t0, t1, before, after, loss, death_t, regen_t of each stretch of hits.

    A hit is a value at least `drop` below the highest of the window before it; hits close in time are one stretch, which
    starts at the latest highest value of two windows before its first hit. after is 0 where a death follows. regen_t is
    the end of the flat values before the first rise, null where it is not seen.
    """
    rows = hp.select(*TRACK, "t", "hp", F.round(F.col("t") * 1000).cast("long").alias("ms"), F.when(F.col("hp").isNotNull(), F.struct("hp", "t")).alias("point"))
    by = Window.partitionBy(*TRACK).orderBy("t")
    width = round(limits.window * 1000)
    rows = trailing_max(rows, TRACK, "ms", width, "hp", "high")
    rows = trailing_max(rows, TRACK, "ms", 2 * width, "point", "top").drop("ms", "point")
    rows = rows.withColumn("hit_t", F.when(F.col("high") - F.col("hp") >= limits.drop - 1e-12, F.col("t")))
    last = F.last("hit_t", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", F.col("hit_t").isNotNull() & F.coalesce(F.col("t") - last > limits.hit_gap + 1e-9, F.lit(True)))
    rows = rows.withColumn("stretch", F.sum(F.col("first").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("stretch > 0")
    own = Window.partitionBy(*TRACK, "stretch")
    rows = rows.withColumn("t1", F.max("hit_t").over(own)).where((F.col("t") <= F.col("t1") + limits.longest + 1e-9))
    later = F.col("t") >= F.col("t1")
    low = F.min(F.when(later, F.col("hp"))).over(own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("low", low)
    stop = F.min(F.when(later & (F.col("hp").isNull() | (F.col("hp") >= F.col("low") + limits.rise)), F.struct("t", F.col("hp").isNotNull().alias("rises")))).over(own)
    rows = rows.withColumn("stop", stop)
    flat = later & (F.col("hp") <= F.col("low") + limits.flat) & (F.col("t") < F.col("stop.t"))
    found = rows.groupBy(*TRACK, "stretch").agg(
        F.min_by("top", F.when(F.col("first"), F.col("t"))).alias("top"), F.max("hit_t").alias("t1"), F.min(F.when(F.col("t") <= F.col("t1"), F.col("hp"))).alias("low"),
        F.when(F.first("stop.rises"), F.max(F.when(flat, F.col("t")))).alias("regen"))
    deaths = lives.where("ended = 'death'").select(*TRACK, F.col("t1").alias("death"))
    spans = found.select(*TRACK, "stretch", (F.col("t1") - limits.before_end).alias("a"), (F.col("t1") + limits.after_end).alias("b"))
    ended = points_in_intervals(deaths, spans, TRACK, "death", "a", "b", limits.before_end + limits.after_end).groupBy(*TRACK, "stretch").agg(F.min("death").alias("death_t"))
    found = found.join(ended, [*TRACK, "stretch"], "left")
    left = F.when(F.col("death_t").isNull(), F.col("low")).otherwise(0.0)
    seen = F.when(F.col("death_t").isNull() & (F.col("regen") - F.col("t1") >= limits.observed - 1e-9), F.col("regen"))
    return found.select(*TRACK, F.col("top.t").alias("t0"), "t1", F.round("top.hp", 2).alias("before"), F.round(left, 2).alias("after"), F.round(F.col("top.hp") - left, 2).alias("loss"), "death_t", seen.alias("regen_t"))


def _with_hit_points(duels: DataFrame, hp: DataFrame, limits: DuelLimits) -> DataFrame:
    """duels with hp_start and hp_end of a and b: the most just before t0, the least just before t1, 0 for who died."""
    spans = [F.struct(F.col(f"slot_{s}").alias("slot"), F.lit(f"{n}_{s}").alias("what"), (lo - 1e-6).alias("lo"), (hi + 1e-6).alias("hi"))
             for s in ("a", "b") for n, lo, hi in (("start", F.col("t0") - limits.lead, F.col("t0")), ("end", F.col("t1") - limits.settle, F.col("t1")))]
    asked = duels.select("game_id", "duel", F.explode(F.array(*spans)).alias("s")).select("game_id", "duel", "s.*")
    read = points_in_intervals(hp.where("hp IS NOT NULL").select(*TRACK, "t", "hp"), asked, TRACK, "t", "lo", "hi", 10 * (limits.lead + limits.settle))
    found = read.groupBy("game_id", "duel").agg(*[F.max(F.when(F.col("what") == f"start_{s}", F.col("hp"))).alias(f"hp_start_{s}") for s in ("a", "b")], *[F.min(F.when(F.col("what") == f"end_{s}", F.col("hp"))).alias(f"hp_end_{s}") for s in ("a", "b")])
    ends = {f"hp_end_{s}": F.when(F.array_contains("died", F.col(f"slot_{s}")), F.lit(0.0)).otherwise(F.col(f"hp_end_{s}")) for s in ("a", "b")}
    return duels.join(found, ["game_id", "duel"], "left").withColumns(ends)


def kill_duels(focused: DataFrame, foci: DataFrame, fights: DataFrame, stretches: DataFrame, limits: DuelLimits = DuelLimits(), fight_limits: FightLimits = FightLimits(), keep_helped: bool = False) -> DataFrame:
    """One row a pair of opponents of each series that is a duel and has a team with fewer than two engaged."""
    first = foci.join(focused.groupBy("game_id", "run").agg(F.min_by("focus", "nth").alias("focus")), ["game_id", "run", "focus"])
    rows = fights.where("kind = 'duel'").join(first.select("game_id", "run", F.col("engaged_a").alias("own_a"), F.col("engaged_b").alias("own_b")), ["game_id", "run"])
    rows = rows.select("game_id", "run", "n_kills", F.coalesce("both.engaged_a", "own_a").alias("engaged_a"), F.coalesce("both.engaged_b", "own_b").alias("engaged_b"))
    if not keep_helped:
        rows = rows.where(F.least("engaged_a", "engaged_b") < fight_limits.engaged)
    pairs = (focused.join(rows, ["game_id", "run"]).withColumn("slot_a", F.least("killer_slot", "victim_slot")).withColumn("slot_b", F.greatest("killer_slot", "victim_slot"))
             .groupBy("game_id", "run", "slot_a", "slot_b", "n_kills", "engaged_a", "engaged_b").agg(F.max("t").alias("t1"), F.collect_set("killer_slot").alias("killers"), F.collect_set("victim_slot").alias("died")))
    asked = pairs.select("game_id", "run", "slot_a", "slot_b", "t1", F.explode(F.array("slot_a", "slot_b")).alias("slot"))
    # a stretch that overlaps [t1 - lookback, t1 + 0.5]: its start is before the end, its end after the start
    hits = stretches.select(*TRACK, F.col("t0").alias("loss_t"), F.col("t1").alias("loss_end"))
    near = asked.join(hits, TRACK).where((F.col("loss_end") >= F.col("t1") - limits.lookback) & (F.col("loss_t") <= F.col("t1") + 0.5))
    starts = near.groupBy("game_id", "run", "slot_a", "slot_b").agg(F.min("loss_t").alias("loss_t"))
    pairs = pairs.join(starts, ["game_id", "run", "slot_a", "slot_b"], "left")
    trade = F.size("killers") == 2
    return pairs.select("game_id", F.lit("kill").alias("source"), F.least(F.coalesce("loss_t", F.col("t1") - limits.least), F.col("t1") - limits.least).alias("t0"), "t1", "slot_a", "slot_b",
                        F.when(~trade, F.element_at("killers", 1)).alias("winner"), F.when(trade, "trade").otherwise("kill").alias("outcome"), F.when(trade, "trade").otherwise("kill").alias("ended_by"), "engaged_a", "engaged_b",
                        F.col("n_kills").alias("series_kills"), "died")


def _largest_first(pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs of stretches by shared time, each stretch in one pair; ties by slots and ends."""
    pairs = pairs.assign(less=-pairs["shared"]).sort_values(["less", "slot_a", "a1", "slot_b", "b1"], kind="stable")
    used: set[tuple[int, float]] = set()
    keep = []
    for sa, a1, sb, b1 in pairs[["slot_a", "a1", "slot_b", "b1"]].itertuples(index=False):
        keep.append((sa, a1) not in used and (sb, b1) not in used)
        if keep[-1]:
            used |= {(sa, a1), (sb, b1)}
    return pairs[keep][["game_id", "slot_a", "a1", "slot_b", "b1"]]


def _unbusy(stretches: DataFrame, kills: DataFrame, limits: DuelLimits) -> DataFrame:
    """Stretches whose player neither kills around them nor dies otherwise than by their end."""
    parts = kills.select("game_id", "t", F.explode(F.array(F.struct(F.col("killer_slot").alias("slot"), F.lit(True).alias("kills")), F.struct(F.col("victim_slot").alias("slot"), F.lit(False).alias("kills")))).alias("p")).select("game_id", "p.slot", F.col("t").alias("at"), "p.kills")
    spans = stretches.select(*TRACK, "t1", "death_t", (F.col("t0") - limits.context[0]).alias("a"), (F.col("t1") + limits.context[1]).alias("b"))
    busy = points_in_intervals(parts, spans, TRACK, "at", "a", "b", 10 * limits.hit_gap).where("kills OR death_t IS NULL").select(*TRACK, "t1").distinct()
    return stretches.join(busy, [*TRACK, "t1"], "left_anti")


def hp_duels(stretches: DataFrame, windows: DataFrame, kills: DataFrame, lives: DataFrame, samples: DataFrame, games: DataFrame, limits: DuelLimits = DuelLimits(), fight_limits: FightLimits = FightLimits()) -> DataFrame:
    """Duels of which only the hit points tell; `windows` are those already found by kills, `games` has game_id and duration."""
    able = written(_unbusy(stretches.where(F.col("loss") >= limits.loss), kills, limits), "able-stretches")
    side = {s: able.where(team_of(F.col("slot")) == s.upper()).select("game_id", F.col("slot").alias(f"slot_{s}"), F.col("t0").alias(f"{s}0"), F.col("t1").alias(f"{s}1"), F.col("death_t").alias(f"{s}_death"), F.col("regen_t").alias(f"{s}_regen")) for s in ("a", "b")}
    key = ["game_id", "slot_a", "a1", "slot_b", "b1"]  # a slot's stretches differ in their end
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    wide = side["a"].withColumn("from", F.col("a0") - limits.apart).withColumn("to", F.col("a1") + limits.apart)
    pairs = overlaps(wide, side["b"], ["game_id"], 10 * limits.hit_gap, "from", "to", "b0", "b1", touching=True).drop("from", "to")
    pairs = pairs.withColumn("shared", hi - lo).withColumn("t0", F.least("a0", "b0")).withColumn("reach", F.greatest("a1", "b1"))
    done = windows.select("game_id", "slot_a", "slot_b", F.col("t0").alias("w0"), F.col("t1").alias("w1"))
    told = pairs.join(done, ["game_id", "slot_a", "slot_b"]).where((F.col("t0") - 1.0 <= F.col("w1")) & (F.col("w0") <= F.col("reach") + 1.0)).select(*key).distinct()
    pairs = pairs.join(told, key, "left_anti")
    pairs = written(pairs, "duel-pairs")
    # who is near in the middle
    asks = pairs.select(*key, ((lo + hi) / 2).alias("t"))
    each = C.positions(asks.withColumn("slot", C.slots()), samples, fight_limits.position)
    living = C.alive_only(asks.withColumn("slot", C.slots()), lives).select(*key, "slot", F.lit(True).alias("lives"))
    seen = each.join(living, [*key, "slot"], "left").groupBy(*key).agg(F.collect_list(F.struct("slot", "x", "y", "lives")).alias("players"))

    def spot(slot: str) -> Column:
        return F.get(F.filter("players", lambda p: p["slot"] == F.col(slot)), F.lit(0))

    seen = seen.withColumn("pa", spot("slot_a")).withColumn("pb", spot("slot_b")).where("pa.x IS NOT NULL AND pb.x IS NOT NULL")
    cx, cy = (F.col("pa.x") + F.col("pb.x")) / 2, (F.col("pa.y") + F.col("pb.y")) / 2

    def helpers(first: bool) -> Column:
        def near(p: Column) -> Column:
            return ((p["slot"] <= 4) == F.lit(first)) & (p["slot"] != F.col("slot_a")) & (p["slot"] != F.col("slot_b")) & p["lives"].isNotNull() & (metres(p["x"] - cx, p["y"] - cy) <= fight_limits.help)
        return 1 + F.size(F.filter("players", near))

    seen = seen.select(*key, metres(F.col("pa.x") - F.col("pb.x"), F.col("pa.y") - F.col("pb.y")).alias("dist"), helpers(True).cast("long").alias("engaged_a"), helpers(False).cast("long").alias("engaged_b"))
    pairs = pairs.join(seen.where((F.col("dist") <= limits.metres) & (F.least("engaged_a", "engaged_b") < fight_limits.engaged)), key)
    # the first death ends it; its killer is the nearest kill
    dead = F.array_min(F.filter(F.array(F.struct(F.col("a_death").alias("t"), F.col("slot_a").alias("slot")), F.struct(F.col("b_death").alias("t"), F.col("slot_b").alias("slot"))), lambda d: d["t"].isNotNull()))
    pairs = pairs.withColumn("dead", dead).withColumn("victim_slot", F.col("dead.slot")).withColumn("end", F.col("dead.t"))
    own = kills.select("game_id", "victim_slot", "t", "killer_slot")
    ended = pairs.where("dead IS NOT NULL").select("game_id", "victim_slot", "end").distinct()
    close = within(ended, own, ["game_id", "victim_slot"], "end", "t", -limits.match[0], limits.match[1]).groupBy("game_id", "victim_slot", "end").agg(F.min_by(F.struct("killer_slot", "t"), F.struct(F.abs(F.col("t") - F.col("end")), "t")).alias("by"))
    pairs = pairs.join(close, ["game_id", "victim_slot", "end"], "left").where("by IS NULL OR NOT by.killer_slot IN (slot_a, slot_b)")
    pairs = written(pairs, "duel-candidates")
    spans = C.islands(pairs, ["game_id"], "t0", "reach", key[1:])
    plain = spans.select(F.col("game_id").cast("long").alias("game_id"), "island", "shared", F.col("slot_a").cast("int").alias("slot_a"), "a1", F.col("slot_b").cast("int").alias("slot_b"), "b1")
    chosen = plain.groupBy("game_id", "island").applyInPandas(_largest_first, "game_id long, slot_a int, a1 double, slot_b int, b1 double")
    pairs = pairs.join(chosen, key).join(games.select("game_id", "duration"), "game_id")
    ta, tb = F.coalesce("a_regen", F.col("a1") + limits.delay), F.coalesce("b_regen", F.col("b1") + limits.delay)
    t1 = F.when(F.col("dead").isNotNull(), F.col("end")).otherwise(F.greatest("reach", F.least(ta, tb, F.col("duration") - limits.blank)))
    third = F.col("by").isNotNull()
    return pairs.select("game_id", F.lit("hp").alias("source"), "t0", t1.alias("t1"), "slot_a", "slot_b", F.when(F.col("dead").isNull(), "recovery").when(third, "third_kill").otherwise("unseen_death").alias("ended_by"),
                        "engaged_a", "engaged_b", F.lit(0).cast("long").alias("series_kills"), F.when(F.col("dead").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col("victim_slot").cast("int"))).alias("died"),
                        F.round("dist", 1).alias("dist_m"), F.col("by.killer_slot").alias("third_slot"), F.when(third, F.col("victim_slot")).alias("third_victim"), F.col("by.t").alias("third_t"),
                        *[F.when(F.col("dead").isNull(), F.round(t, 2)).alias(f"regen_{s}") for s, t in (("a", ta), ("b", tb))],
                        *[F.when(F.col("dead").isNull(), F.col(f"{s}_regen").isNotNull()).alias(f"regen_read_{s}") for s in ("a", "b")])


def find_duels(hp: DataFrame | None, kills: DataFrame, lives: DataFrame, samples: DataFrame, games: DataFrame, limits: DuelLimits = DuelLimits(), fight_limits: FightLimits = FightLimits(), keep_helped: bool = False) -> DataFrame:
    """All duels: game_id, source, t0, t1, slot_a, slot_b, winner, outcome, ended_by, engaged_a, engaged_b, series_kills,
    dist_m, third_slot, third_victim, third_t, regen_a, regen_b, regen_read_a, regen_read_b, hp_start_a, hp_start_b,
    hp_end_a, hp_end_b.

    outcome is kill, trade, interrupted (a third player killed one of both; no winner), hit_points or undecided. The kill
    of a third player who took no damage beside the victim is no duel of its own. Without hit points there are duels by
    kills only. `kills` are those of opponents.
    """
    focused, foci, rows = C.fight_tables(kills, lives, samples, fight_limits)
    spark = kills.sparkSession
    known = hp if hp is not None else spark.createDataFrame([], "game_id long, slot int, t double, hp double")
    stretches = written(damage_stretches(known, lives, limits), "stretches")
    by_kill = written(kill_duels(focused, foci, rows, stretches, limits, fight_limits, keep_helped), "kill-duels")
    if hp is not None:
        by_hp = written(hp_duels(stretches, by_kill, kills, lives, samples, games, limits, fight_limits), "hp-duels")
        # a kill from behind: its victim was in a duel with another, and the killer lost nothing beside it
        lost = stretches.select(*TRACK, F.col("t0").alias("s0"), F.col("t1").alias("s1"), "loss")
        behind = by_hp.where("third_slot IS NOT NULL").select("game_id", F.col("third_slot").alias("killer"), F.col("third_victim").alias("victim")).distinct()
        own = behind.join(lost.where(F.col("loss") >= limits.loss).select("game_id", F.col("slot").alias("killer"), F.col("s0").alias("k0"), F.col("s1").alias("k1")), ["game_id", "killer"])
        fought = own.join(lost.select("game_id", F.col("slot").alias("victim"), "s0", "s1"), ["game_id", "victim"]).where(F.least("k1", "s1") + limits.apart >= F.greatest("k0", "s0")).select("game_id", "killer", "victim").distinct()
        behind = behind.join(fought, ["game_id", "killer", "victim"], "left_anti").select("game_id", F.col("killer").alias("winner"), F.col("victim").alias("loser"))
        loser = F.when(F.col("winner") == F.col("slot_a"), F.col("slot_b")).otherwise(F.col("slot_a"))
        by_kill = by_kill.withColumn("loser", loser).join(behind, ["game_id", "winner", "loser"], "left_anti").drop("loser")
        by_kill = by_kill.unionByName(by_hp, allowMissingColumns=True)
    else:
        nothing = {"dist_m": "double", "third_slot": "int", "third_victim": "int", "third_t": "double", "regen_a": "double", "regen_b": "double", "regen_read_a": "boolean", "regen_read_b": "boolean"}
        by_kill = by_kill.withColumns({c: F.lit(None).cast(kind) for c, kind in nothing.items()})
    every = written(by_kill, "duels").withColumn("duel", F.struct("source", "t0", "t1", "slot_a", "slot_b"))
    every = _with_hit_points(every, known, limits)
    ahead = F.round("hp_end_a", 2) - F.round("hp_end_b", 2)
    by_points = F.when(F.abs(ahead) >= limits.margin, F.when(ahead > 0, F.col("slot_a")).otherwise(F.col("slot_b")))
    settled = F.col("ended_by") == "recovery"
    winner = F.when(settled, by_points).otherwise(F.col("winner"))
    outcome = F.coalesce("outcome", F.when(F.col("ended_by") == "third_kill", "interrupted").when(settled & by_points.isNotNull(), "hit_points").otherwise("undecided"))
    return every.select("game_id", "source", F.round("t0", 2).alias("t0"), F.round("t1", 2).alias("t1"), "slot_a", "slot_b", winner.alias("winner"), outcome.alias("outcome"), "ended_by", "engaged_a", "engaged_b", "series_kills", "dist_m",
                        "third_slot", "third_victim", "third_t", "regen_a", "regen_b", "regen_read_a", "regen_read_b", *[F.round(f"hp_{n}_{s}", 2).alias(f"hp_{n}_{s}") for n in ("start", "end") for s in ("a", "b")])
