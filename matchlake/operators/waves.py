"""Waves, departures of a team from its starting zone, and what becomes of them: retakes of points.

Frames as in `combat`; besides, zones (game_id, team, zone struct of x0, y0, x1, y1), games (game_id, duration) and
instances (game_id, point, inst, t0, t1, rect), a point while it can be taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import metres
from matchlake.operators import combat as C
from matchlake.operators.combat import FightLimits
from matchlake.operators.joins import asof, points_in_intervals
from matchlake.operators.match import team_of
from matchlake.operators.series import sessions
from matchlake.scratch import written
from matchlake.sources.match_view import ARENA_M

WAVE = ["game_id", "team", "wave"]
BUCKET = 300.0  # seconds of a game in which moments meet the holdings of a point


@dataclass(frozen=True)
class WaveLimits:
    """Seconds and metres that decide what is a wave and what it achieves."""

    least: int = 2  # players
    join: float = 8.0  # from the first exit to the last
    margin: float = 1.0  # metres around a zone
    contact: float = 60.0  # from the start, for the first kill
    step: float = 0.5
    half: float = 1.0  # of the time over which speed is measured
    stop_speed: float = 0.5  # metres a second
    stop_s: float = 3.0
    stops: int = 1  # that make a wave gradual
    after_life: float = 1.0  # a kill may be read so long after the life it ends
    success: float = 15.0  # after the last kill, a capture belongs to the wave
    fail_dead: int = 2
    retreat_m: float = 7.0
    retreat_s: float = 3.0
    adjacent: float = 3.0
    ignore: float = 2.0
    hold: float = 30.0


def zone_exits(lives: DataFrame, samples: DataFrame, zones: DataFrame, limits: WaveLimits = WaveLimits()) -> DataFrame:
    """game_id, slot, idx, t, died, life_end: the first row of a life outside the zones it began in.

    Lives that begin outside all zones, or never leave, have none.
    """
    mx, my = limits.margin / ARENA_M[0], limits.margin / ARENA_M[1]

    def inside(zone: Column, x: Column, y: Column) -> Column:
        return x.between(zone["x0"] - mx, zone["x1"] + mx) & y.between(zone["y0"] - my, zone["y1"] + my)

    began = lives.where("x0 IS NOT NULL").withColumn("team", team_of(F.col("slot"))).join(zones.groupBy("game_id", "team").agg(F.collect_list("zone").alias("zones")), ["game_id", "team"])
    began = began.withColumn("zones", F.filter("zones", lambda z: inside(z, F.col("x0"), F.col("y0")))).where(F.size("zones") > 0)
    life = F.struct("idx", "t1", (F.col("ended") == "death").alias("died"), "zones")
    rows = samples.where("alive AND x IS NOT NULL AND y IS NOT NULL").select("game_id", "slot", "t", "x", "y")
    held = asof(rows, began.select("game_id", "slot", F.col("t0").alias("t"), life.alias("life")), ["game_id", "slot"], "t", ["life"], direction="backward").where("t <= life.t1")
    out = held.where(~F.exists("life.zones", lambda z: inside(z, F.col("x"), F.col("y"))))
    return out.groupBy("game_id", "slot", F.col("life.idx").alias("idx")).agg(F.min("t").alias("t"), F.first("life.died").alias("died"), F.first("life.t1").alias("life_end"))


def clustered_exits(exits: DataFrame, limits: WaveLimits = WaveLimits()) -> DataFrame:
    """exits (game_id, slot, idx, t, died, life_end) with `anchor`, when the first exit of their wave is: those at most
    `join` after it; where they are too few, the first is left out.

    Exits farther apart than `join` cannot share a wave, so a team's exits are dealt to tasks by such stretches.
    """
    span, least = limits.join, limits.least

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "slot", "idx"], kind="stable")
        t = rows["t"].tolist()
        anchor, i = [float("nan")] * len(t), 0
        while i < len(t):
            j = i
            while j < len(t) and t[j] - t[i] <= span:
                j += 1
            if j - i >= least:
                anchor[i:j] = [t[i]] * (j - i)
                i = j
            else:
                i += 1
        return rows.assign(anchor=anchor).dropna(subset="anchor")

    near = sessions(exits.withColumn("side", (F.col("slot") > 4).cast("int")), ["game_id", "side"], ["t", "slot"], span)
    typed = near.select(F.col("game_id").cast("long").alias("game_id"), "side", "run", F.col("slot").cast("int").alias("slot"), F.col("idx").cast("int").alias("idx"), "t", "died", "life_end")
    kind = "game_id long, side int, run long, slot int, idx int, t double, died boolean, life_end double, anchor double"
    return typed.groupBy("game_id", "side", "run").applyInPandas(of, kind).drop("side", "run")


def find_waves(lives: DataFrame, samples: DataFrame, zones: DataFrame, games: DataFrame, limits: WaveLimits = WaveLimits()) -> DataFrame:
    """game_id, team, wave, t_start, t_full, size, members, limit: members have slot, idx, t_exit, t_death and life_end.

    `limit`, up to which a wave is followed, is the end of the game, of the time for contact, or the team's next start.
    """
    rows = clustered_exits(zone_exits(lives, samples, zones, limits), limits)
    member = F.struct(F.col("t").alias("t_exit"), "slot", "idx", F.when(F.col("died"), F.col("life_end")).alias("t_death"), "life_end")
    waves = rows.groupBy("game_id", team_of(F.col("slot")).alias("team"), "anchor").agg(F.min("t").alias("t_start"), F.max("t").alias("t_full"), F.count("*").alias("size"), F.sort_array(F.collect_list(member)).alias("members"))
    of_team = Window.partitionBy("game_id", "team").orderBy("t_start")
    waves = waves.withColumn("wave", F.row_number().over(of_team)).withColumn("next", F.lead("t_start").over(of_team)).join(games.select("game_id", "duration"), "game_id")
    return waves.select(*WAVE, "t_start", "t_full", "size", "members", F.least(F.col("t_start") + limits.contact, "duration", "next").alias("limit"))


def contacts(waves: DataFrame, focused: DataFrame, fights: DataFrame, limits: WaveLimits = WaveLimits()) -> DataFrame:
    """waves with t_contact, the first kill of or by a member in its life, and run, focus and n_fights.

    The run is the first series met that is a teamfight, else the first; focus is that of the first kill met in it.
    """
    members = waves.select(*WAVE, "t_start", "limit", F.explode("members").alias("m")).select(*WAVE, F.greatest(F.col("t_start"), F.col("m.t_exit")).alias("a"), F.least("limit", F.col("m.life_end") + limits.after_life).alias("b"), "m.slot")
    sides = focused.select("game_id", "t", "run", "focus", "nth", F.explode(F.array("killer_slot", "victim_slot")).alias("slot"))
    met = points_in_intervals(sides, members, ["game_id", "slot"], "t", "a", "b", limits.contact / 60, 1e-6)
    series = met.groupBy(*WAVE, "run").agg(F.min("t").alias("t"), F.min(F.struct("nth", "focus")).alias("first")).join(fights.select("game_id", "run", "kind"), ["game_id", "run"])
    listed = series.groupBy(*WAVE).agg(F.min("t").alias("t_contact"), F.sort_array(F.collect_list(F.struct("first", "run", "kind"))).alias("met"))
    teamfight = F.filter("met", lambda x: x["kind"] == "teamfight")
    chosen = F.coalesce(F.get(teamfight, F.lit(0)), F.get("met", F.lit(0)))
    upto = F.when(F.size(teamfight) > 0, F.size(F.filter("met", lambda x: x["first"]["nth"] <= F.get(teamfight, F.lit(0))["first"]["nth"]))).otherwise(F.size("met"))
    listed = listed.select(*WAVE, "t_contact", chosen["run"].alias("run"), chosen["first"]["focus"].alias("focus"), upto.cast("long").alias("n_fights"))
    return waves.join(listed, WAVE, "left").fillna(0, ["n_fights"])


def centroids(asks: DataFrame, waves: DataFrame, samples: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """keys, t, cx, cy: the mean position of a wave's members in the lives they left in, at moments of it; null without one."""
    members = waves.select(*WAVE, F.explode("members").alias("m")).select(*WAVE, "m.slot", "m.t_exit", "m.life_end")
    each = asks.select(*keys, "t").join(members, WAVE).where("t >= t_exit - 1e-6 AND t <= life_end + 1e-6")
    placed = C.positions(each, samples, gap).groupBy(*keys, "t").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return asks.select(*keys, "t").join(placed, [*keys, "t"], "left")


def motions(waves: DataFrame, samples: DataFrame, limits: WaveLimits = WaveLimits(), gap: float = 1.5) -> DataFrame:
    """By wave: n_stops, stop_s, mean_speed, path_m and speed ('fast' or 'gradual') until t_contact, or the limit without one."""
    until = F.greatest(F.coalesce("t_contact", "limit"), F.col("t_start") + limits.step)
    spans = waves.select(*WAVE, "t_start", until.alias("until"))
    steps = F.sequence(F.lit(0), F.floor((F.col("until") - F.col("t_start")) / limits.step + 1e-9).cast("int"))
    asks = spans.select(*WAVE, "t_start", "until", F.explode(steps).alias("i")).withColumn("t", F.col("t_start") + F.col("i") * limits.step)
    trace = centroids(asks, waves, samples, [*WAVE, "t_start", "until", "i"], gap)
    k = round(limits.half / limits.step)
    w = Window.partitionBy(*WAVE).orderBy("i")
    around = w.rowsBetween(-k, k)
    ends = [F.first(F.struct("t", "cx", "cy")).over(around), F.last(F.struct("t", "cx", "cy")).over(around)]
    trace = trace.withColumn("p", ends[0]).withColumn("q", ends[1]).withColumn("v", metres(F.col("q.cx") - F.col("p.cx"), F.col("q.cy") - F.col("p.cy")) / F.when(F.col("q.t") > F.col("p.t"), F.col("q.t") - F.col("p.t")))
    seen = F.when(F.col("cx").isNotNull(), F.struct("cx", "cy"))
    trace = trace.withColumn("back", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("moved", metres(F.col("cx") - F.col("back.cx"), F.col("cy") - F.col("back.cy")))
    still = F.coalesce(F.col("v") < limits.stop_speed, F.lit(False))
    # stretches of rest: rows in rest with as many rows in motion before them
    trace = trace.withColumn("still", still).withColumn("stretch", F.sum((~F.col("still")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rests = trace.where("still").groupBy(*WAVE, "stretch").agg((F.max("t") - F.min("t") + limits.step).alias("rest")).where(F.col("rest") >= limits.stop_s - 1e-9).groupBy(*WAVE).agg(F.count("*").alias("n_stops"), F.sum("rest").alias("stop_s"))
    path = trace.groupBy(*WAVE).agg(F.coalesce(F.sum("moved"), F.lit(0.0)).alias("path"), (F.first("until") - F.first("t_start")).alias("length"))
    both = path.join(rests, WAVE, "left").fillna(0, ["n_stops", "stop_s"])
    return both.select(*WAVE, "n_stops", F.round("stop_s", 1).alias("stop_s"), F.round(F.col("path") / F.greatest("length", F.lit(1e-6)), 2).alias("mean_speed"), F.round("path", 1).alias("path_m"), F.when(F.col("n_stops") >= limits.stops, "gradual").otherwise("fast").alias("speed"))


def axis_fraction(lives: DataFrame, fights: DataFrame) -> DataFrame:
    """fights (game_id, team, cx, cy, ...) with axis_frac: 0 where the team's lives begin on average, 1 where the others' do."""
    begin = lives.groupBy("game_id").agg(*[F.avg(F.when((F.col("slot") <= 4) == F.lit(t == "a"), F.col(c))).alias(f"{t}{c[0]}") for t in "ab" for c in ("x0", "y0")])
    own, them = [[F.when(F.col("team") == "A", F.col(f"{p}{c}")).otherwise(F.col(f"{q}{c}")) for c in "xy"] for p, q in (("a", "b"), ("b", "a"))]
    ux, uy = (them[0] - own[0]) * ARENA_M[0], (them[1] - own[1]) * ARENA_M[1]
    n2 = ux * ux + uy * uy
    part = ((F.col("cx") - own[0]) * ARENA_M[0] * ux + (F.col("cy") - own[1]) * ARENA_M[1] * uy) / F.when(n2 >= 1e-9, n2)
    return fights.join(begin, "game_id", "left").withColumn("axis_frac", F.round(part, 2)).drop("ax", "ay", "bx", "by")


def described_waves(lives: DataFrame, samples: DataFrame, kills: DataFrame, zones: DataFrame, games: DataFrame, limits: WaveLimits = WaveLimits(), fight_limits: FightLimits = FightLimits()) -> DataFrame:
    """Waves with their contact, fight and motion: those of find_waves, contacts and motions, and t_first, t_last, n_kills,
    lost_a, lost_b, alive_a, alive_b, winner, kind, heavy, n_foci, engaged_a, engaged_b, cx, cy, to_contact_s, to_fight_s and axis_frac."""
    focused, foci, fights = C.fight_tables(kills, lives, samples, fight_limits)
    found = written(find_waves(lives, samples, zones, games, limits), "waves")
    waves = written(contacts(found, focused, fights, limits), "contacts")
    own = foci.select("game_id", "run", "focus", "cx", "cy", F.col("engaged_a").alias("own_a"), F.col("engaged_b").alias("own_b"))
    rows = waves.join(fights, ["game_id", "run"], "left").join(own, ["game_id", "run", "focus"], "left")
    for s in ("a", "b"):
        rows = rows.withColumn(f"engaged_{s}", F.coalesce(f"both.engaged_{s}", f"own_{s}"))
    neutral = zones.groupBy("game_id").agg(F.collect_set(F.when(F.col("team") == "A", F.col("zone"))).alias("za"), F.collect_set(F.when(F.col("team") == "B", F.col("zone"))).alias("zb"))
    neutral = neutral.select("game_id", (F.sort_array("za") == F.sort_array("zb")).alias("neutral"))
    rows = axis_fraction(lives, rows.drop("both", "own_a", "own_b")).join(neutral, "game_id", "left")
    rows = rows.withColumn("axis_frac", F.when(~F.col("neutral"), F.col("axis_frac"))).drop("neutral")
    rows = rows.withColumn("to_contact_s", F.round(F.col("t_contact") - F.col("t_start"), 1)).withColumn("to_fight_s", F.round(F.greatest(F.lit(0.0), F.col("t_first") - F.col("t_start")), 1))
    rows = rows.withColumn("to_fight_s", F.when(F.col("run").isNotNull(), F.col("to_fight_s")))
    return written(rows.join(motions(waves, samples, limits, fight_limits.position), WAVE), "described-waves")


def point_tables(instances: DataFrame, owners: DataFrame, limits: WaveLimits = WaveLimits()) -> tuple[DataFrame, DataFrame]:
    """instance_owners and the captures of it, each written once."""
    line = written(instance_owners(instances, owners, limits), "instance-owners")
    return line, written(C.captures_of(line, ["game_id", "inst"], limits.adjacent), "captures")


def classify(team: Column, holder: Column, taken: Column, before: Column, kind: Column, won_by: Column, lost: Column, fail_dead: int = 2) -> Column:
    """What became of a wave: a capture first, then who held the point, then how the fight went and what it cost.

    initial, success, defense, no_contact, duel, won_no_capture, initial_lost, fail or undecided. `kind` is null without
    a fight, `holder` and `before` are null for a neutral point.
    """
    capture = F.when(before.isNull(), "initial").otherwise("success")
    lost_fight = F.when(lost >= fail_dead, F.when(holder.isNull(), "initial_lost").otherwise("fail")).otherwise("undecided")
    return (F.when(taken, capture).when(F.coalesce(holder == team, F.lit(False)), "defense").when(kind.isNull(), "no_contact").when(kind == "duel", "duel")
            .when(F.coalesce(won_by == team, F.lit(False)), "won_no_capture").otherwise(lost_fight))


def instance_owners(instances: DataFrame, owners: DataFrame, limits: WaveLimits = WaveLimits()) -> DataFrame:
    """game_id, inst, t0, t1, holder: who holds each instance, of the readings whose middle lies in it; none where no team was ever read."""
    spans = instances.select("game_id", "point", "inst", (F.col("t0") - 1).alias("i0"), (F.col("t1") + 1).alias("i1"))
    read = owners.join(spans, ["game_id", "point"]).where(((F.col("t0") + F.col("t1")) / 2).between(F.col("i0"), F.col("i1")))
    line = C.holder_timeline(read.select("game_id", "inst", "t0", "t1", "owner"), ["game_id", "inst"], limits.ignore, limits.hold)
    known = line.where("holder IS NOT NULL").select("game_id", "inst").distinct()
    return line.join(known, ["game_id", "inst"], "left_semi")


def _first_unused(rows: pd.DataFrame) -> pd.DataFrame:
    """Each wave takes the earliest capture in its reach that no wave before it took."""
    used: set[tuple[int, float]] = set()
    kept = []
    rows = rows.sort_values(["t_start", "wave", "cap_t", "inst"], kind="stable").reset_index(drop=True)
    for _, own in rows.groupby(["t_start", "wave"], sort=True):
        for at, inst, t in zip(own.index, own["inst"], own["cap_t"], strict=True):
            if (inst, t) not in used:
                used.add((inst, t))
                kept.append(at)
                break
    return rows.iloc[kept]


def allotted_captures(waves: DataFrame, captures: DataFrame, instances: DataFrame, limits: WaveLimits = WaveLimits()) -> DataFrame:
    """game_id, team, wave, inst, cap_t, before: a capture by the wave's team from its start to `success` after its fight.

    A capture serves one wave, in the order of their starts. Waves whose reaches share no time cannot want the same one,
    so they are dealt to tasks by such stretches.
    """
    reach = F.coalesce("t_last", "limit") + limits.success
    spans = C.islands(waves.select(*WAVE, "t_start", reach.alias("reach")), ["game_id", "team"], "t_start", "reach", ["wave"])
    live = instances.select("game_id", "inst", F.col("t0").alias("i0"), F.col("t1").alias("i1"))
    own = captures.select("game_id", "team", "inst", F.col("t").alias("cap_t"), "before")
    met = points_in_intervals(own, spans, ["game_id", "team"], "cap_t", "t_start", "reach", limits.contact)
    met = met.join(live, ["game_id", "inst"]).where((F.col("i1") >= F.col("t_start") - 1) & (F.col("i0") <= F.col("reach") + 1))
    typed = met.select(F.col("game_id").cast("long").alias("game_id"), (F.col("team") == "B").cast("int").alias("side"), "island", F.col("wave").cast("int").alias("wave"), "t_start", F.col("inst").cast("int").alias("inst"), "cap_t")
    kind = "game_id long, side int, island long, wave int, t_start double, inst int, cap_t double"
    taken = typed.groupBy("game_id", "side", "island").applyInPandas(_first_unused, kind).withColumn("team", F.when(F.col("side") == 0, "A").otherwise("B"))
    return taken.select(*WAVE, "inst", "cap_t").join(own, ["game_id", "team", "inst", "cap_t"]).select(*WAVE, "inst", "cap_t", "before")


def _held_at(asked: DataFrame, line: DataFrame, name: str) -> DataFrame:
    """Of the asks (wave, inst, t), who holds the instance then, as `name`; no row where nothing is read."""
    spans = line.select("game_id", "inst", (F.col("t0") - 1e-6).alias("h0"), F.col("t1").alias("h1"), F.col("holder").alias(name))
    return points_in_intervals(asked.where("inst IS NOT NULL"), spans, ["game_id", "inst"], "t", "h0", "h1", BUCKET).where("t < h1").groupBy(*WAVE).agg(F.min_by(name, "h0").alias(name))


def _aims(waves: DataFrame, taken: DataFrame, instances: DataFrame, line: DataFrame, samples: DataFrame, limits: WaveLimits, gap: float) -> DataFrame:
    """waves with the instance they aim at and its rect: the one captured, else the nearest whose holder is known at t_ref."""
    rows = waves.join(taken.withColumnRenamed("inst", "cap_inst"), WAVE, "left").withColumn("t_ref", F.coalesce("t_contact", "t_start"))
    centre = centroids(rows.where("cap_inst IS NULL").select(*WAVE, F.col("t_ref").alias("t")), waves, samples, WAVE, gap)
    near = centre.join(instances.select("game_id", "inst", "rect", F.col("t0").alias("i0"), F.col("t1").alias("i1")), "game_id").where((F.col("t") >= F.col("i0") - 1) & (F.col("t") <= F.col("i1") + 1))
    read = line.select("game_id", "inst", (F.col("t0") - limits.adjacent).alias("k0"), (F.col("t1") + limits.adjacent).alias("k1"))
    near = points_in_intervals(near, read, ["game_id", "inst"], "t", "k0", "k1", BUCKET).withColumn("far", F.coalesce(C.rect_metres(F.col("cx"), F.col("cy"), F.col("rect")), F.lit(0.0)))
    aimed = near.groupBy(*WAVE).agg(F.min(F.struct("far", "inst")).alias("n")).select(*WAVE, F.col("n.inst").alias("near_inst"))
    rows = rows.join(aimed, WAVE, "left").withColumn("inst", F.coalesce("cap_inst", "near_inst")).drop("cap_inst", "near_inst")
    return rows.join(instances.select("game_id", "inst", "point", "rect"), ["game_id", "inst"], "left")


def _sides(rows: DataFrame, lives: DataFrame, samples: DataFrame, limits: WaveLimits, gap: float) -> DataFrame:
    """By wave that aims at a point: attackers, defenders, survivors and retreated."""
    moments = F.array(F.struct(F.lit("ref").alias("what"), F.col("t_ref").alias("t")), F.struct(F.lit("after").alias("what"), F.col("t_after").alias("t")))
    aimed = rows.where("inst IS NOT NULL").select(*WAVE, F.transform("members", lambda m: m["slot"]).alias("slots"), F.coalesce("victims", F.array().cast("array<int>")).alias("victims"), "rect", F.explode(moments).alias("m"))
    asks = aimed.select("game_id", F.struct("team", "wave", "slots", "victims", F.col("m.what").alias("what")).alias("of"), "rect", F.col("m.t").alias("t"))
    there = C.players_at(asks, lives, samples, gap).withColumn("far", C.rect_metres(F.col("x"), F.col("y"), F.col("rect")))
    player = F.struct("slot", F.col("team").alias("side"), "far")
    seen = there.groupBy("game_id", F.col("of.team").alias("team"), F.col("of.wave").alias("wave"), F.col("of.slots").alias("slots"), F.col("of.victims").alias("victims")).agg(
        *[F.collect_list(F.when(F.col("of.what") == what, player)).alias(what) for what in ("ref", "after")])

    def of(name: str, slot: Column) -> Column:
        return F.get(F.filter(name, lambda p: p["slot"] == slot), F.lit(0))

    alive = F.filter("after", lambda p: F.array_contains("slots", p["slot"]))
    back = F.filter(alive, lambda p: F.coalesce(p["far"], F.lit(0.0)) > limits.retreat_m)
    attackers = F.transform(F.sort_array("slots"), lambda s: F.struct(s.alias("slot"), F.round(of("ref", s)["far"], 1).alias("dist_m")))
    fate = lambda slot: F.when(F.array_contains("victims", slot), "dead").when(F.coalesce(of("after", slot)["far"] > limits.retreat_m, F.lit(False)), "back").otherwise("there")
    opponents = F.filter("ref", lambda p: p["side"] != F.col("team"))
    defenders = F.sort_array(F.transform(opponents, lambda p: F.struct(p["slot"].alias("slot"), F.round(p["far"], 1).alias("dist_m"), fate(p["slot"]).alias("fate"))))
    return seen.select(*WAVE, attackers.alias("attackers"), defenders.alias("defenders"), F.sort_array(F.transform(alive, lambda p: p["slot"])).alias("survivors"), F.size(back).cast("long").alias("retreated"))


def find_retakes(waves: DataFrame, instances: DataFrame, owners: DataFrame, lives: DataFrame, samples: DataFrame, limits: WaveLimits = WaveLimits(), fight_limits: FightLimits = FightLimits()) -> DataFrame:
    """described_waves with inst, point, captured_t, capture_from, holder_before, holder_after, outcome, opening, t_end,
    attackers, defenders, survivors and retreated.

    A wave aims at the point it captures, else at the nearest one that can be taken at its contact; outcome and what
    follows are null where there is none. Members that live `retreat_s` after the fight survive. defenders are the
    opponents alive at contact, with their distance to the point and their fate: dead in the fight, back or there.
    """
    line, captures = point_tables(instances, owners, limits)
    taken = written(allotted_captures(waves, captures, instances, limits), "allotted")
    rows = written(_aims(waves, taken, instances, line, samples, limits, fight_limits.position), "aims")
    captured = F.col("cap_t").isNotNull()
    then = _held_at(rows.select(*WAVE, "inst", F.col("t_ref").alias("t")), line, "then")
    rows = rows.join(then, WAVE, "left").withColumn("holder_before", F.when(captured, F.col("before")).otherwise(F.col("then")))
    lost = F.when(F.col("team") == "A", F.col("lost_a")).otherwise(F.col("lost_b"))
    outcome = classify(F.col("team"), F.col("holder_before"), captured, F.col("before"), F.col("kind"), F.col("winner"), lost, limits.fail_dead)
    rows = rows.withColumn("outcome", F.when(F.col("inst").isNotNull(), outcome))
    end = F.coalesce("t_last", F.least("limit", F.array_max(F.transform("members", lambda m: m["life_end"]))))
    rows = rows.withColumn("t_end", F.greatest(end, F.col("cap_t"))).withColumn("t_after", F.coalesce("t_last", "t_end") + limits.retreat_s)
    first = F.row_number().over(Window.partitionBy("game_id").orderBy(captured.desc(), "t_start", "team", "wave")) == 1
    rows = rows.withColumn("opening", captured & F.col("before").isNull() & first)
    rows = written(rows, "outcomes")
    rows = rows.join(_held_at(rows.select(*WAVE, "inst", (F.col("t_end") + 1.0).alias("t")), line, "holder_after"), WAVE, "left")
    rows = rows.join(_sides(rows, lives, samples, limits, fight_limits.position), WAVE, "left")
    return rows.withColumnsRenamed({"cap_t": "captured_t", "before": "capture_from"}).drop("then", "t_after", "rect")
