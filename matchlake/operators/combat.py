"""Who is where at a moment, series of kills and their foci, and owners of points: what episodes are made of.

Frames: samples (game_id, slot, t, x, y, alive), lives (game_id, slot, idx, t0, t1, x0, y0, x1, y1, ended), kills
(game_id, t, killer_slot, victim_slot) by opponents, point_owner (game_id, point, t0, t1, owner). Slots 1-4 are team A,
5-8 team B; times are seconds of the game. Every step is keyed by game, or by a part of one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from matchlake.functions.geometry import metres
from matchlake.operators import stateful
from matchlake.operators.joins import asof
from matchlake.operators.match import team_of
from matchlake.operators.series import sessions, with_runs
from matchlake.scratch import written

BUCKET_ROWS = 50_000
PLAYER = StructType([StructField("slot", IntegerType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("living", BooleanType())])


@dataclass(frozen=True)
class FightLimits:
    """Seconds and metres that decide what belongs to one fight."""

    wipe: float = 10.0  # between two kills of a series
    engaged: int = 2  # players of a team that make it engaged
    heavy: int = 3  # losses of either team that make a fight heavy
    help: float = 10.0  # metres from the centre at which a player helps
    after: float = 2.5  # after the last kill, survivors are counted
    death: float = 2.0  # between a kill and the end of the victim's life
    position: float = 1.5  # between a moment and the row that gives a position
    lost_position: float = 3.0  # the same for a victim without an end of life


def slots() -> Column:
    """The slots of a game, as rows to explode."""
    return F.explode(F.sequence(F.lit(1), F.lit(8)))


def other(team: Column) -> Column:
    return F.when(team == "A", "B").otherwise("A")


def rect_metres(x: Column, y: Column, rect: Column) -> Column:
    """Metres from a position to a rectangle (x0, y0, x1, y1); 0 inside, null without a position."""
    return F.when(x.isNotNull(), metres(F.greatest(rect["x0"] - x, F.lit(0.0), x - rect["x1"]), F.greatest(rect["y0"] - y, F.lit(0.0), y - rect["y1"])))


def islands(df: DataFrame, keys: list[str], t0: str, t1: str, order: list[str], name: str = "island") -> DataFrame:
    """df with a number by keys that changes where no span is open: spans of different numbers share no time."""
    w = Window.partitionBy(*keys).orderBy(t0, *order)
    reach = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return with_runs(df.withColumn("__reach", reach), keys, [t0, *order], F.col("__reach").isNull() | (F.col(t0) > F.col("__reach")), name).drop("__reach")


def positions(asks: DataFrame, samples: DataFrame, gap: float) -> DataFrame:
    """asks (game_id, slot, t, ...) with x and y of the slot's nearest living row, null beyond `gap` seconds."""
    spots = samples.where("alive AND x IS NOT NULL AND y IS NOT NULL").select("game_id", "slot", "t", "x", "y")
    return asof(asks, spots, ["game_id", "slot"], "t", ["x", "y"], gap).drop("found_t")


def with_living(asks: DataFrame, lives: DataFrame) -> DataFrame:
    """asks (game_id, slot, t, ...) with `living`: whether the slot's last life, both ends included, is not over."""
    begun = lives.select("game_id", "slot", (F.col("t0") - 1e-6).alias("t"), F.col("t1").alias("life_end"))
    held = asof(asks, begun, ["game_id", "slot"], "t", ["life_end"], direction="backward")
    return held.withColumn("living", F.coalesce(F.col("t") <= F.col("life_end") + 1e-6, F.lit(False))).drop("found_t", "life_end")


def alive_only(asks: DataFrame, lives: DataFrame) -> DataFrame:
    """The asks (game_id, slot, t, ...) at which the slot lives."""
    return with_living(asks, lives).where("living").drop("living")


def _in_buckets(samples: DataFrame, gap: float, width: float) -> DataFrame:
    """Living rows by bucket of a game's time, and in each bucket the last row of every slot before it and the first after it that `gap` reaches."""
    spots = samples.where("alive AND x IS NOT NULL AND y IS NOT NULL").select("game_id", F.floor(F.col("t") / width).alias("__bucket"), "slot", F.struct("t", "x", "y").alias("s"))
    ends = spots.groupBy("game_id", "__bucket", "slot").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    here, low, high = F.col("__bucket"), F.floor((F.col("first.t") - gap) / width), F.floor((F.col("last.t") + gap) / width)
    before = ends.where(low < here).select("game_id", F.explode(F.sequence(low, here - 1)).alias("__bucket"), "slot", F.col("first").alias("s"))
    after = ends.where(high > here).select("game_id", F.explode(F.sequence(here + 1, high)).alias("__bucket"), "slot", F.col("last").alias("s"))
    return spots.unionByName(before).unionByName(after).select("game_id", "__bucket", F.lit(0).alias("__side"), F.col("slot").cast("int").alias("__slot"), F.col("s.t").cast("double").alias("__t"), F.col("s.x").cast("double").alias("__x"), F.col("s.y").cast("double").alias("__y"))


def _players(rows: pa.Table, names: list[str], gap: float) -> pa.Table:
    """The asks of one bucket with the eight slots; a row of side 0 is a place, one of side 1 a life, one of side 2 an ask."""
    side, slot, t, x, y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("__side", "__slot", "__t", "__x", "__y"))
    asks = rows.filter(pa.array(side == 2))
    at = asks.column("__t").to_numpy(zero_copy_only=False)
    found: dict[str, list[np.ndarray]] = {"x": [], "y": [], "far": [], "living": []}
    for n in range(1, 9):
        own = np.nonzero((side == 0) & (slot == n))[0]
        own = own[np.lexsort((y[own], x[own], t[own]))]
        times = np.concatenate([[-np.inf], t[own], [np.inf]])
        after = np.searchsorted(times[1:-1], at, side="left") + 1
        best = np.where(at - times[after - 1] <= times[after] - at, after - 1, after)
        place = np.clip(best - 1, 0, max(0, len(own) - 1))
        for c, v in (("x", x), ("y", y)):
            found[c].append(v[own][place] if len(own) else np.zeros(len(at)))
        found["far"].append(~(np.abs(times[best] - at) <= gap))
        life = np.nonzero((side == 1) & (slot == n))[0]
        life = life[np.argsort(t[life], kind="stable")]
        until = np.concatenate([[-np.inf], np.maximum.accumulate(x[life])])  # of a life, x is its end
        found["living"].append(at <= until[np.searchsorted(t[life], at, side="right")] + 1e-6)
    flat = {c: np.stack(v, axis=1).ravel() for c, v in found.items()}
    player = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1, 9, dtype=np.int32), len(at))), pa.array(flat["x"], mask=flat["far"]), pa.array(flat["y"], mask=flat["far"]), pa.array(flat["living"])], ["slot", "x", "y", "living"])
    players = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 8), player)
    mine = asks.column("__ask").combine_chunks()
    return pa.Table.from_arrays([*(mine.chunk(0) if isinstance(mine, pa.ChunkedArray) else mine).flatten(), players], [*names, "players"])


def around(asks: DataFrame, lives: DataFrame, samples: DataFrame, gap: float = 1.5) -> DataFrame:
    """asks (game_id, t, ...) with players, the eight slots in order: slot, x and y of its nearest living row within `gap`, null beyond, and whether it lives.

    An ask is one row for all slots. Games are cut into buckets of time with about BUCKET_ROWS living rows each, so what is
    looked at together does not grow with the rows of a game.
    """
    size = samples.agg(F.count("*").alias("n"), F.count_distinct("game_id").alias("games"), F.min("t").alias("a"), F.max("t").alias("b")).first()
    width = max(1.0, ((size["b"] or 0.0) - (size["a"] or 0.0) + 1.0) / max(1, -(-size["n"] // (BUCKET_ROWS * max(1, size["games"])))))
    begin, end = F.col("t0") - 1e-6, F.greatest(F.col("t0"), F.col("t1")) + 1e-6
    begun = lives.select("game_id", F.explode(F.sequence(F.floor(begin / width), F.floor(end / width))).alias("__bucket"), F.lit(1).alias("__side"), F.col("slot").cast("int").alias("__slot"), begin.cast("double").alias("__t"), F.col("t1").cast("double").alias("__x"))
    mine = asks.select("game_id", F.floor(F.col("t") / width).alias("__bucket"), F.lit(2).alias("__side"), F.col("t").cast("double").alias("__t"), F.struct(*[F.col(c) for c in asks.columns]).alias("__ask"))
    both = mine.unionByName(_in_buckets(samples, gap, width), allowMissingColumns=True).unionByName(begun, allowMissingColumns=True)
    names = asks.columns

    def of(rows: pa.Table) -> pa.Table:
        return _players(rows, names, gap)

    schema = StructType([*[StructField(f.name, f.dataType) for f in asks.schema.fields], StructField("players", ArrayType(PLAYER))])
    return both.groupBy("game_id", "__bucket").applyInArrow(of, schema)


def players_at(asks: DataFrame, lives: DataFrame, samples: DataFrame, gap: float = 1.5) -> DataFrame:
    """A row for each ask (game_id, t, ...) and living slot: slot, team, x, y; positions may be null."""
    each = around(asks, lives, samples, gap).select(*asks.columns, F.explode(F.filter("players", lambda p: p["living"])).alias("p"))
    return each.select(*asks.columns, "p.slot", "p.x", "p.y").withColumn("team", team_of(F.col("slot")))


def death_positions(kills: DataFrame, lives: DataFrame, samples: DataFrame, limits: FightLimits = FightLimits()) -> DataFrame:
    """kills with x and y of the victim: where its life ended, else its nearest living row."""
    ends = lives.where("ended = 'death' AND x1 IS NOT NULL").select("game_id", F.col("slot").alias("victim_slot"), F.col("t1").alias("t"), F.col("x1").alias("dx"), F.col("y1").alias("dy"))
    ended = asof(kills, ends, ["game_id", "victim_slot"], "t", ["dx", "dy"], limits.death).drop("found_t")
    spots = samples.where("alive AND x IS NOT NULL AND y IS NOT NULL").select("game_id", F.col("slot").alias("victim_slot"), "t", F.col("x").alias("sx"), F.col("y").alias("sy"))
    seen = asof(ended, spots, ["game_id", "victim_slot"], "t", ["sx", "sy"], limits.lost_position).drop("found_t")
    return seen.withColumn("x", F.coalesce("dx", "sx")).withColumn("y", F.when(F.col("dx").isNotNull(), F.col("dy")).otherwise(F.col("sy"))).drop("dx", "dy", "sx", "sy")


def focused_kills(kills: DataFrame, lives: DataFrame, samples: DataFrame, limits: FightLimits = FightLimits()) -> DataFrame:
    """kills with the number of their series in the game, of their focus in the series, and their place in time, nth."""
    order = ["t", "killer_slot", "victim_slot"]
    series = sessions(kills.select("game_id", "t", "killer_slot", "victim_slot"), ["game_id"], order, limits.wipe)
    placed = death_positions(series, lives, samples, limits).withColumn("event_id", F.col("killer_slot") * 10 + F.col("victim_slot"))
    placed = placed.select(F.col("game_id").cast("long").alias("game_id"), "t", F.col("killer_slot").cast("int").alias("killer_slot"), F.col("victim_slot").cast("int").alias("victim_slot"), "run", "x", "y", F.col("event_id").cast("int").alias("event_id"))
    radius = limits.help

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        return stateful.foci(rows, radius)

    found = placed.groupBy("game_id", "run").applyInPandas(of, "game_id long, t double, killer_slot int, victim_slot int, run long, x double, y double, event_id int, focus int").drop("event_id")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("game_id").orderBy(*order)))


def engaged_foci(focused: DataFrame, lives: DataFrame, samples: DataFrame, limits: FightLimits = FightLimits()) -> DataFrame:
    """game_id, run, focus, cx, cy, engaged_a, engaged_b: killers, victims and living players near the centre at a kill."""
    keys = ["game_id", "run", "focus"]
    centres = focused.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    asks = focused.select(*keys, "t").join(centres, keys)
    near = players_at(asks, lives, samples, limits.position).where(metres(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= limits.help).select(*keys, "slot")
    fought = focused.select(*keys, F.explode(F.array("killer_slot", "victim_slot")).alias("slot"))
    counted = fought.unionByName(near).distinct().groupBy(*keys).agg(F.count_if(F.col("slot") <= 4).alias("engaged_a"), F.count_if(F.col("slot") > 4).alias("engaged_b"))
    return counted.join(centres, keys)


def winner(lost_a: Column, lost_b: Column, alive_a: Column, alive_b: Column) -> Column:
    """The team that loses fewer players, then the one with more of them alive; null if equal."""
    return F.when(lost_a != lost_b, F.when(lost_a < lost_b, "A").otherwise("B")).when(alive_a != alive_b, F.when(alive_a > alive_b, "A").otherwise("B"))


def fights(focused: DataFrame, foci: DataFrame, lives: DataFrame, limits: FightLimits = FightLimits()) -> DataFrame:
    """A row a series: game_id, run, t_first, t_last, n_kills, lost_a, lost_b, alive_a, alive_b, winner, n_foci, victims, kind, heavy, both.

    A teamfight has two kills or more and both teams engaged in one focus, or two foci; else it is a duel. `both` is the
    first focus in which both teams are engaged, null without one.
    """
    keys = ["game_id", "run"]
    rows = focused.groupBy(*keys).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count("*").alias("n_kills"), F.count_if(F.col("victim_slot") <= 4).alias("lost_a"),
                                      F.count_if(F.col("victim_slot") > 4).alias("lost_b"), F.count_distinct("focus").alias("n_foci"), F.sort_array(F.collect_set("victim_slot")).alias("victims"))
    asks = rows.select(*keys, (F.col("t_last") + limits.after).alias("t")).withColumn("slot", slots())
    alive = alive_only(asks, lives).groupBy(*keys).agg(F.count_if(F.col("slot") <= 4).alias("alive_a"), F.count_if(F.col("slot") > 4).alias("alive_b"))
    good = foci.where(F.least("engaged_a", "engaged_b") >= limits.engaged).groupBy(*keys).agg(F.min_by(F.struct("focus", "engaged_a", "engaged_b"), "focus").alias("both"))
    rows = rows.join(alive, keys, "left").join(good, keys, "left").fillna(0, ["alive_a", "alive_b"])
    together = (F.col("both").isNotNull() | (F.col("n_foci") >= 2)) & (F.col("n_kills") >= 2)
    rows = rows.withColumn("winner", winner(*map(F.col, ("lost_a", "lost_b", "alive_a", "alive_b")))).withColumn("kind", F.when(together, "teamfight").otherwise("duel"))
    return rows.withColumn("heavy", (F.col("kind") == "teamfight") & (F.least("lost_a", "lost_b") >= limits.heavy))


def fight_tables(kills: DataFrame, lives: DataFrame, samples: DataFrame, limits: FightLimits = FightLimits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """focused_kills, engaged_foci and fights, each written once."""
    focused = written(focused_kills(kills, lives, samples, limits), "focused-kills")
    foci = written(engaged_foci(focused, lives, samples, limits), "foci")
    return focused, foci, written(fights(focused, foci, lives, limits), "fights")


def holder_timeline(owners: DataFrame, keys: list[str], ignore: float = 2.0, hold: float = 30.0) -> DataFrame:
    """keys, t0, t1, holder: who holds a point, kept through neutral time for at most `hold` seconds, null beyond.

    Readings of less than `ignore` seconds do not count.
    """
    w = Window.partitionBy(*keys).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    read = owners.where(F.col("t1") - F.col("t0") >= ignore).withColumn("known", F.when(F.col("owner").isin("A", "B"), F.struct("owner", F.col("t1").alias("until"))))
    read = read.withColumn("last", F.last("known", ignorenulls=True).over(w))
    until = F.when(F.col("last").isNull(), F.col("t0")).otherwise(F.least("t1", F.col("last.until") + hold))
    neutral = F.array(F.struct("t0", until.alias("t1"), F.col("last.owner").alias("holder")), F.struct(F.greatest("t0", until).alias("t0"), "t1", F.lit(None).cast("string").alias("holder")))
    held = F.array(F.struct("t0", "t1", F.col("owner").alias("holder")))
    parts = F.when(F.col("known").isNotNull(), held).otherwise(F.filter(neutral, lambda p: p["t1"] > p["t0"]))
    return read.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")


def captures_of(timeline: DataFrame, keys: list[str], adjacent: float = 3.0) -> DataFrame:
    """keys, t, before, team: when a point changes hands.

    The first holding counts, with a null before, only if neutral time ends at most `adjacent` seconds before it.
    """
    w = Window.partitionBy(*keys).orderBy("t0", "t1")
    steps = timeline.withColumn("before", F.last("holder", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("gap", F.col("t0") - F.lag("t1").over(w))
    taken = F.col("holder").isNotNull() & ((F.col("before") != F.col("holder")) | (F.col("before").isNull() & (F.col("gap") <= adjacent)))
    return steps.where(taken).select(*keys, F.col("t0").alias("t"), "before", F.col("holder").alias("team"))
