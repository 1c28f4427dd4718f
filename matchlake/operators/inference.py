"""Values that were not read, inferred from what else is known: a kill's author, the point of a calendar period, a life's equipment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.joins import points_in_intervals


def infer_killers(kills: DataFrame, opponents: DataFrame, near: float = 0.6) -> DataFrame:
    """kills (game_id, t, victim_slot, weapon) with `killer_slot`, by elimination among the opponents alive at the time.

    opponents: game_id, t, victim_slot, slot, dist, weapon; dist and weapon may be null. A known weapon leaves those who
    hold it; if nobody does and all weapons are known, or several are left of whom the nearest is not clearly nearer
    (its distance over `near` of the next one's), the killer stays null. Of equal distances
    none is clearly nearer, unless both are zero; then the lower slot counts as the nearer one. A kill has few opponents, so they meet in one array.
    """
    keys = ["game_id", "t", "victim_slot"]
    listed = opponents.groupBy(*keys).agg(F.collect_list(F.struct("dist", "slot", "weapon")).alias("all"))
    none = F.array().cast("array<struct<dist:double,slot:int,weapon:string>>")
    rows = kills.join(listed, keys, "left").withColumn("all", F.coalesce("all", none))
    rows = rows.withColumn("same", F.expr("filter(all, c -> c.weapon = weapon)"))
    rows = rows.withColumn("pool", F.expr("""CASE WHEN weapon IS NULL THEN all WHEN size(same) > 0 THEN same
        WHEN forall(all, c -> c.weapon IS NOT NULL) THEN slice(all, 1, 0) ELSE all END"""))
    rows = rows.withColumn("known", F.expr("array_sort(filter(pool, c -> c.dist IS NOT NULL))"))
    killer = F.expr(f"CASE WHEN size(pool) = 1 THEN pool[0].slot WHEN size(known) >= 2 AND known[0].dist <= {near}D * known[1].dist THEN known[0].slot END")
    return rows.select(*kills.columns, killer.alias("killer_slot"))


def calendar_votes(periods: DataFrame, readings: DataFrame, lag: float = 1.0, margin: float = 1.0, min_votes: int = 3, min_share: float = 0.2, width: float = 60.0) -> DataFrame:
    """The point of each period (game_id, k, t0, t1), by votes of the readings (game_id, t, point, lit) in its window.

    The window is the period, later by `lag` and shorter by `margin` at both ends. A point needs min_votes lit readings
    and min_share of the window. The point of the period before is left out if another qualifies, or if it never went
    out around the change. Ties go to the lesser name; a period without a vote has null, after which any point may follow.
    """
    keys = ["game_id", "k"]
    wide = periods.select(*keys, "t0", "t1", (F.col("t0") - 1).alias("from"), F.greatest(F.col("t1") + lag - margin, F.col("t0") + lag + 2).alias("to"))
    met = points_in_intervals(readings, wide, ["game_id"], "t", "from", "to", width)
    inside = (F.col("t") >= F.col("t0") + lag + margin) & (F.col("t") < F.col("t1") + lag - margin)
    dark = (F.col("t") <= F.col("t0") + lag + 2) & ~F.col("lit")
    counted = (met.groupBy(*keys, "point").agg(F.count_if(inside & F.col("lit")).alias("votes"), F.count_if(inside).alias("n"), (F.count_if(dark) == 0).alias("steady"))
               .where((F.col("votes") >= min_votes) & (F.col("votes") >= min_share * F.col("n"))))
    ranked = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "point", "steady"))).alias("c"))
    games = (periods.select(*keys).join(ranked, keys, "left").groupBy("game_id")
             .agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("all")))
    # a fold over a game's few periods, as each depends on the one before
    chosen = "get(filter(coalesce(x.c, array()), y -> NOT (y.point <=> a.prev AND (size(x.c) > 1 OR y.steady))), 0).point"
    folded = games.select("game_id", F.expr(f"""aggregate(all, named_struct('prev', CAST(NULL AS STRING), 'out', CAST(array() AS array<string>)),
        (a, x) -> named_struct('prev', {chosen}, 'out', concat(a.out, array({chosen})))).out""").alias("points"), F.col("all.k").alias("ks"))
    voted = folded.select("game_id", F.explode(F.arrays_zip("ks", "points")).alias("z")).select("game_id", F.col("z.ks").alias("k"), F.col("z.points").alias("point"))
    return periods.join(voted, keys)


def voted_loadouts(reads: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """weapon1, weapon2, gadget and held of each life (game_id, slot, life_idx), by votes of its images.

    reads: the life's keys, `at` (order), `late` (from the life's end), place (1 or 2), weapon, pale (is it the one not
    held?), gadget; place, weapon and gadget may be null. A held weapon goes before a pale one; equal votes go to what
    was seen first; a weapon in both places stays where it has more votes, the first place if equal. `fallback`
    (game_id, slot, weapon1, weapon2, gadget) fills what is missing, but never with the weapon of the other place.
    """
    keys = ["game_id", "slot", "life_idx"]
    ballot = F.concat_ws("_", F.when(F.col("pale"), "pale").otherwise("held"), F.col("place").cast("string"))
    votes = F.array(F.struct(F.lit("life").alias("ballot"), F.lit("").alias("icon")), F.struct(ballot.alias("ballot"), F.col("weapon").alias("icon")),
                    F.struct(F.lit("gadget").alias("ballot"), F.col("gadget").alias("icon")), F.struct(F.when(F.col("late") & ~F.col("pale"), "last").alias("ballot"), F.col("weapon").alias("icon")))
    cast = reads.select(*keys, "late", "at", F.explode(votes).alias("v")).select(*keys, "late", "at", "v.*").where("ballot IS NOT NULL AND icon IS NOT NULL")
    counted = cast.groupBy(*keys, "ballot", "icon").agg(F.count("*").alias("n"), F.min(F.struct("late", "at")).alias("first"))
    won = counted.groupBy(*keys, "ballot").agg(F.min_by(F.struct("icon", "n"), F.struct(-F.col("n"), "first")).alias("w"))
    names = ("held_1", "held_2", "pale_1", "pale_2", "gadget", "last")
    life = won.groupBy(*keys).agg(*[F.max(F.when(F.col("ballot") == b, F.col("w"))).alias(b) for b in names])
    life = life.select(*keys, F.coalesce("held_1", "pale_1").alias("a"), F.coalesce("held_2", "pale_2").alias("b"), F.col("gadget.icon").alias("gadget"), F.col("last.icon").alias("held"))
    twice = F.coalesce(F.col("a.icon") == F.col("b.icon"), F.lit(False))
    first = F.when(~(twice & (F.col("a.n") < F.col("b.n"))), F.col("a.icon"))
    second = F.when(~(twice & (F.col("a.n") >= F.col("b.n"))), F.col("b.icon"))
    found = life.select(*keys, first.alias("weapon1"), second.alias("weapon2"), "gadget", "held")
    if fallback is None:
        return found
    spare = fallback.select("game_id", "slot", *[F.col(c).alias(f"spare_{c}") for c in ("weapon1", "weapon2", "gadget")])
    both = found.join(spare, ["game_id", "slot"], "left")
    both = both.withColumn("weapon1", F.coalesce("weapon1", F.when(~F.col("spare_weapon1").eqNullSafe(F.col("weapon2")), F.col("spare_weapon1"))))
    both = both.withColumn("weapon2", F.coalesce("weapon2", F.when(~F.col("spare_weapon2").eqNullSafe(F.col("weapon1")), F.col("spare_weapon2"))))
    return both.select(*keys, "weapon1", "weapon2", F.coalesce("gadget", "spare_gadget").alias("gadget"), "held")
