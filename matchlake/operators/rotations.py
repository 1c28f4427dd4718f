"""Rotations: what both teams do when the active point changes.

Frames as in `combat`; besides, active (game_id, point, t0, t1, rect), the stretches in which a point counts, and games
(game_id, duration). A change is dealt to tasks by itself: its window is looked at in steps of half a second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import metres
from matchlake.operators import combat as C
from matchlake.scratch import written

KEYS = ["game_id", "switch"]
TEAM = [*KEYS, "team"]


@dataclass(frozen=True)
class RotationLimits:
    """Seconds and metres that decide who takes part in a rotation, and when."""

    on_point: float = 4.0  # metres from the rectangle of a point
    back: float = 4.0  # before the change, players at the old point start there
    before: float = 20.0
    after: float = 30.0
    step: float = 0.5
    hold: float = 2.0  # with `least` players, a presence
    least: int = 2
    early: float = 5.0
    late: float = 5.0
    gap: float = 20.0  # between two stretches that follow each other
    keys: tuple[float, ...] = (-20.0, -10.0, 0.0, 10.0, 20.0)
    position: float = 1.5
    merge: float = 6.0
    ignore: float = 2.0
    hold_owner: float = 30.0
    old_owner: float = 3.0  # before the old point ends, its holder is read
    first_owner: float = 10.0  # after the change, the new point's holder is read
    second_owner: float = 20.0  # and again, which decides
    last_owner: float = 5.0  # after the window, for the last time


def switches(active: DataFrame, limits: RotationLimits = RotationLimits(), fixed: DataFrame | None = None) -> DataFrame:
    """game_id, switch, t, old and new (point, t0, t1, rect): stretches of different points that follow each other.

    Stretches of a point with a short gap are one. Games in `fixed` have none.
    """
    by = Window.partitionBy("game_id").orderBy("t0", "point")
    same = (F.col("point") == F.lag("point").over(by)) & (F.col("t0") - F.lag("t1").over(by) <= limits.merge)
    runs = active.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("part", F.sum((~F.col("same")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("game_id", "part").agg(F.first("point").alias("point"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min_by("rect", "t0").alias("rect"))
    stretch = F.struct("point", "t0", "t1", "rect")
    w = Window.partitionBy("game_id").orderBy("t0")
    pairs = whole.withColumn("new", stretch).withColumn("old", F.lag("new").over(w)).where((F.col("old.point") != F.col("new.point")) & (F.col("new.t0") - F.col("old.t1") <= limits.gap))
    pairs = pairs.select("game_id", F.col("part").alias("switch"), F.col("new.t0").alias("t"), "old", "new")
    return pairs if fixed is None else pairs.join(fixed.select("game_id").distinct(), "game_id", "left_anti")


def leave_phase(was_on: Column, stays: Column, offset: Column, limits: RotationLimits = RotationLimits()) -> Column:
    """When a team leaves the old point, seen from the change: never (it was not there), stays, before, at_change or after."""
    return F.when(~was_on, "never").when(stays, "stays").when(offset < -limits.early, "before").when(offset <= limits.late, "at_change").otherwise("after")


def _spine(changes: DataFrame, games: DataFrame, lives: DataFrame, samples: DataFrame, limits: RotationLimits) -> DataFrame:
    """A row for each change, step of its window and living slot, with the distances to both points and whether it is near.

    The steps of the window start at its begin; those of arrivals and departures at the change and `back` before it.
    """
    spans = changes.join(games.select("game_id", "duration"), "game_id").withColumn("lo", F.greatest(F.lit(0.0), F.col("t") - limits.before)).withColumn("hi", F.least("duration", F.col("t") + limits.after))

    def steps(kind: str, a: Column, b: Column) -> Column:
        n = F.floor((b - a) / limits.step + 1e-9).cast("int")
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.lit(kind).alias("kind"), (a + i * limits.step).alias("t")))).otherwise(F.array().cast("array<struct<kind:string,t:double>>"))

    t = F.col("t")
    keys = F.filter(F.array(*[F.struct(F.lit("key").alias("kind"), (t + o).alias("t")) for o in limits.keys]), lambda k: (k["t"] >= 0) & (k["t"] <= F.col("duration")))
    asked = F.concat(steps("window", F.col("lo"), F.col("hi")), steps("arrive", t, t + limits.after), steps("leave", t - limits.back, t + limits.after), keys)
    each = spans.select(*KEYS, "t", "lo", "hi", "duration", F.col("old.rect").alias("old_rect"), F.col("new.rect").alias("new_rect"), F.explode(asked).alias("ask"))
    each = each.select("game_id", F.struct("switch", "t", "lo", "hi", F.col("ask.kind").alias("kind")).alias("of"), "old_rect", "new_rect", F.col("ask.t").alias("t"))
    there = C.players_at(each, lives, samples, limits.position)
    near = {f"d_{n}": C.rect_metres(F.col("x"), F.col("y"), F.col(f"{n}_rect")) for n in ("old", "new")}
    return there.withColumns(near).select("game_id", "of.switch", F.col("of.t").alias("at"), "of.lo", "of.hi", "of.kind", F.round("t", 3).alias("t"), "slot", "team", "x", "y", "d_old", "d_new",
                                         *[F.coalesce(F.col(f"d_{n}") <= limits.on_point, F.lit(False)).alias(f"on_{n}") for n in ("old", "new")])


def _presences(counts: DataFrame, name: str, limits: RotationLimits) -> DataFrame:
    """game_id, switch, team, at, hi, start, end of the runs of steps with `least` players or more that last `hold` or more."""
    by = Window.partitionBy(*TEAM).orderBy("t")
    full = F.col(name) >= limits.least
    runs = counts.withColumn("run", F.sum((~full).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where(full)
    return runs.groupBy(*TEAM, "at", "hi", "run").agg(F.min("t").alias("start"), F.max("t").alias("end")).where(F.col("end") - F.col("start") + limits.step >= limits.hold - 1e-9)


def team_flows(changes: DataFrame, games: DataFrame, lives: DataFrame, samples: DataFrame, limits: RotationLimits = RotationLimits()) -> tuple[DataFrame, DataFrame]:
    """What each team does about each change, and the spine of steps it was read from.

    game_id, switch, team, was_on_old, stays_on_old, leave_offset, leave_phase, alive_at_leave, concentrate_offset,
    already_on_new, arrivals and starters (slots with times), first_arrival, second_arrival, start_players, keys.
    """
    spine = written(_spine(changes, games, lives, samples, limits), "spine")
    bounds = changes.join(games.select("game_id", "duration"), "game_id")
    grid = bounds.select(*KEYS, F.col("t").alias("at"), F.greatest(F.lit(0.0), F.col("t") - limits.before).alias("lo"), F.least("duration", F.col("t") + limits.after).alias("hi"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("team"))
    steps = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / limits.step + 1e-9).cast("int")))).withColumn("t", F.round(F.col("lo") + F.col("i") * limits.step, 3))
    seen = spine.where("kind = 'window'").groupBy(*TEAM, "t").agg(F.count_if("on_old").alias("n_old"), F.count_if("on_new").alias("n_new"), F.count("*").alias("alive"))
    counts = written(steps.join(seen, [*TEAM, "t"], "left").fillna(0, ["n_old", "n_new", "alive"]), "presences")
    old = _presences(counts, "n_old", limits).where("start <= at + 1e-6").groupBy(*TEAM).agg(F.max("end").alias("end"))
    new = _presences(counts, "n_new", limits).groupBy(*TEAM).agg(F.min("start").alias("concentrate"))
    arrived = spine.where("kind = 'arrive' AND on_new").groupBy(*TEAM, "at", "hi", "slot").agg(F.round(F.min("t"), 1).alias("t"))
    arrivals = arrived.groupBy(*TEAM).agg(F.sort_array(F.collect_list(F.struct("t", "slot"))).alias("arrivals"), F.sort_array(F.collect_list(F.when(F.col("t") <= F.col("hi") + 1e-9, F.col("t") - F.col("at")))).alias("offsets"))
    begun = spine.where("kind = 'leave' AND on_old").where(F.abs(F.col("t") - F.col("at") + limits.back) < 1e-3).select(*TEAM, "slot", "d_old")
    left = spine.where("kind = 'leave'").where((F.col("d_old") > limits.on_point)).groupBy(*TEAM, "slot").agg(F.round(F.min("t"), 1).alias("leave_t"))
    starters = begun.join(left, [*TEAM, "slot"], "left").groupBy(*TEAM).agg(F.transform(F.sort_array(F.collect_list(F.struct("d_old", "slot", "leave_t"))), lambda s: F.struct(s["slot"].alias("slot"), s["leave_t"].alias("leave_t"))).alias("starters"))
    player = F.struct("slot", F.round("d_old", 1).alias("d_old"), F.round("d_new", 1).alias("d_new"))
    shots = spine.where("kind = 'key'").groupBy(*TEAM, (F.round(F.col("t") - F.col("at"), 1)).alias("offset")).agg(
        F.count("*").alias("alive"), F.count_if("on_old").alias("near_old"), F.count_if("on_new").alias("near_new"), F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"), F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), player))).alias("players"))
    keyed = shots.groupBy(*TEAM).agg(F.sort_array(F.collect_list(F.struct("offset", "alive", "near_old", "near_new", "cx", "cy", "players"))).alias("keys"))
    rows = grid
    for part in (old, new, arrivals, starters, keyed):
        rows = rows.join(part, TEAM, "left")
    was_on, stays = F.col("end").isNotNull(), F.coalesce(F.col("end") >= F.col("hi") - 1e-6, F.lit(False))
    rows = rows.withColumn("leave_offset", F.when(~stays, F.round(F.col("end") + limits.step - F.col("at"), 1)))
    at_leave = counts.select(*TEAM, F.round(F.col("t") - F.col("at"), 1).alias("leave_offset"), F.col("alive").alias("alive_at_leave"))
    rows = rows.join(at_leave, [*TEAM, "leave_offset"], "left")
    first = F.get("offsets", F.lit(0))
    flows = rows.select(*TEAM, F.col("at").alias("t"), was_on.alias("was_on_old"), stays.alias("stays_on_old"), "leave_offset", leave_phase(was_on, stays, F.col("leave_offset"), limits).alias("leave_phase"), "alive_at_leave",
                        F.round(F.col("concentrate") - F.col("at"), 1).alias("concentrate_offset"), F.coalesce((F.col("concentrate") <= F.col("lo") + 1e-6) & (F.col("lo") > 0), F.lit(False)).alias("already_on_new"),
                        F.round(first, 1).alias("first_arrival"), F.round(F.get("offsets", F.lit(1)), 1).alias("second_arrival"), F.coalesce("arrivals", F.array().cast("array<struct<t:double,slot:int>>")).alias("arrivals"),
                        F.coalesce("starters", F.array().cast("array<struct<slot:int,leave_t:double>>")).alias("starters"), F.coalesce("keys", F.array().cast("array<struct<offset:double,alive:long,near_old:long,near_new:long,cx:double,cy:double,players:array<struct<slot:int,d_old:double,d_new:double>>>>")).alias("keys"))
    return flows, spine


def _holders(changes: DataFrame, owners: DataFrame, limits: RotationLimits) -> DataFrame:
    """By change: old_owner, and of the new point new_owner_after, owner_10, owner_20 (by the limits' first and second moment) and owner_first.

    Only readings whose middle lies in the point's stretch count.
    """
    which = F.explode(F.array(*[F.struct(F.lit(n).alias("which"), F.col(f"{n}.point").alias("point"), (F.col(f"{n}.t0") - 1).alias("i0"), (F.col(f"{n}.t1") + 1).alias("i1")) for n in ("old", "new")]))
    spans = changes.select(*KEYS, "t", "old", "new", which.alias("s")).select(*KEYS, F.col("t").alias("at"), "old", "new", "s.*")
    read = owners.join(spans, ["game_id", "point"]).where(((F.col("t0") + F.col("t1")) / 2).between(F.col("i0"), F.col("i1")))
    line = C.holder_timeline(read.select(*KEYS, "which", "t0", "t1", "owner"), [*KEYS, "which"], limits.ignore, limits.hold_owner)
    line = line.join(changes.select(*KEYS, F.col("t").alias("at"), "old", "new"), KEYS)

    def at(which: str, moment: Column) -> Column:
        return F.max(F.when((F.col("which") == which) & (F.col("t0") - 1e-6 <= moment) & (moment < F.col("t1")), F.col("holder")))

    first = F.when((F.col("which") == "new") & F.col("holder").isNotNull() & (F.col("t0") >= F.col("at") - 1e-6), F.col("t0"))
    return line.groupBy(*KEYS).agg(at("old", F.col("old.t1") - limits.old_owner).alias("old_owner"), at("new", F.least(F.col("new.t1"), F.col("at") + limits.after + limits.last_owner)).alias("new_owner_after"), at("new", F.col("at") + limits.first_owner).alias("owner_10"),
                                   at("new", F.col("at") + limits.second_owner).alias("owner_20"), F.min_by("holder", first).alias("owner_first"))


def find_rotations(active: DataFrame, owners: DataFrame, lives: DataFrame, samples: DataFrame, games: DataFrame, limits: RotationLimits = RotationLimits(), fixed: DataFrame | None = None) -> DataFrame:
    """A row a change and team that takes part: the columns of team_flows, point, point_to, t0, t1, outcome, distance_m,
    deaths_en_route, the holders, first_team, winner and value.

    A team takes part with `least` players who start at the old point or arrive at the new one, or a presence before.
    outcome is arrived (two or more), partial or not_arrived; value is won, lost or undecided, by who holds the new
    point 20 s after, else first.
    """
    changes = written(switches(active, limits, fixed), "switches")
    flows, _ = team_flows(changes, games, lives, samples, limits)
    flows = written(flows, "flows").withColumn("score", F.coalesce("second_arrival", F.col("first_arrival") + 1000))
    scores = flows.groupBy(*KEYS).agg(*[F.max(F.when(F.col("team") == t, F.col("score"))).alias(f"score_{t.lower()}") for t in "AB"])
    a, b = F.col("score_a"), F.col("score_b")
    scores = scores.withColumn("first_team", F.when(a.isNotNull() & (b.isNull() | (a < b)), "A").when(b.isNotNull() & (a.isNull() | (b < a)), "B")).drop("score_a", "score_b")
    rows = flows.drop("score").join(changes.drop("t"), KEYS).join(games.select("game_id", "duration"), "game_id").join(scores, KEYS).join(_holders(changes, owners, limits), KEYS, "left")
    slots = F.array_union(F.transform("arrivals", lambda x: x["slot"]), F.transform("starters", lambda x: x["slot"]))
    rows = rows.where((F.size(slots) >= limits.least) | F.col("was_on_old"))
    lost = F.filter("starters", lambda s: ~F.exists("arrivals", lambda x: x["slot"] == s["slot"]))
    asked = rows.select(*TEAM, "t", F.explode(lost).alias("s")).select(*TEAM, F.col("t").alias("at"), "s.slot")
    deaths = lives.where("ended = 'death'").select("game_id", "slot", F.col("t1").alias("death"))
    died = asked.join(deaths, ["game_id", "slot"]).where((F.col("death") >= F.col("at") - limits.back) & (F.col("death") <= F.col("at") + limits.after)).groupBy(*TEAM, "slot").agg(F.round(F.min("death"), 1).alias("t"))
    died = died.groupBy(*TEAM).agg(F.sort_array(F.collect_list(F.struct("slot", "t"))).alias("deaths_en_route"))
    n = F.size("arrivals")
    winner = F.coalesce("owner_20", "owner_first")
    centre = {f"{n_}{c}": (F.col(f"{n_}.rect.{c}0") + F.col(f"{n_}.rect.{c}1")) / 2 for n_ in ("old", "new") for c in "xy"}
    rows = rows.join(died, TEAM, "left").withColumns(centre)
    return rows.select(*TEAM, "t", F.col("old.point").alias("point"), F.col("new.point").alias("point_to"), F.greatest(F.lit(0.0), F.col("t") - limits.before).alias("t0"), F.least("duration", F.col("t") + limits.after).alias("t1"),
                       F.when(n >= 2, "arrived").when(n == 1, "partial").otherwise("not_arrived").alias("outcome"), F.round(metres(F.col("oldx") - F.col("newx"), F.col("oldy") - F.col("newy")), 1).alias("distance_m"),
                       "starters", "arrivals", F.coalesce("deaths_en_route", F.array().cast("array<struct<slot:int,t:double>>")).alias("deaths_en_route"), "was_on_old", "stays_on_old", "leave_offset", "leave_phase", "alive_at_leave",
                       "concentrate_offset", "already_on_new", "first_arrival", "second_arrival", "keys", "old_owner", "new_owner_after", "owner_10", "owner_20", "owner_first", "first_team", winner.alias("winner"),
                       F.when(winner.isNull(), "undecided").when(winner == F.col("team"), "won").otherwise("lost").alias("value"))
