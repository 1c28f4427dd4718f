"""What holds at a moment: states, notes and plans looked up by time, labels by slope, rides, captures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.operators import joins as J
from matchlake.operators import match as M
from matchlake.operators import series as S
from matchlake.plans.registry import query
from matchlake.sources.match_view import ARENA_M, samples

TRACK = ["game_id", "slot"]


@query("state_at_moment", """, seg AS (SELECT game_id, slot, event_id, t AS t0, t + value * 30 AS t1, CASE WHEN value > 50 THEN 'ready' ELSE 'used' END AS state FROM ev WHERE kind = 'click'),
  held AS (SELECT game_id, slot, event_id, t AS t0, t + value * 60 AS t1, 'item' || CAST(floor(y * 5) AS INT) AS item FROM ev WHERE kind = 'signup'),
  s AS (SELECT p.event_id, arg_max(state, (t0, seg.event_id)) AS state FROM ev p JOIN seg ON p.game_id = seg.game_id AND p.slot = seg.slot AND p.t BETWEEN t0 AND t1 WHERE p.kind = 'view' GROUP BY p.event_id),
  i AS (SELECT p.event_id, arg_min(item, (t0, held.event_id)) AS item FROM ev p JOIN held ON p.game_id = held.game_id AND p.slot = held.slot AND p.t BETWEEN t0 AND t1 WHERE p.kind = 'view' GROUP BY p.event_id)
SELECT event_id, coalesce(state, 'unknown') AS state, coalesce(item, state) AS name FROM ev LEFT JOIN s USING (event_id) LEFT JOIN i USING (event_id) WHERE kind = 'view'""")
def state_at_moment(spark, d):
    """The latest segment that holds the moment, 'unknown' outside all; the name comes from the first holding, then from the segment."""
    ev = samples(spark, d)
    asked = ev.where("kind = 'view'").select(*TRACK, F.col("event_id").alias("asked"), "t")
    segments = ev.where("kind = 'click'").select(*TRACK, "event_id", F.col("t").alias("t0"), (F.col("t") + F.col("value") * 30).alias("t1"), F.when(F.col("value") > 50, "ready").otherwise("used").alias("state"))
    held = ev.where("kind = 'signup'").select(*TRACK, "event_id", F.col("t").alias("t0"), (F.col("t") + F.col("value") * 60).alias("t1"), F.concat(F.lit("item"), F.floor(F.col("y") * 5).cast("int")).alias("item"))
    state = J.points_in_intervals(asked, segments, TRACK, "t", "t0", "t1", 3600.0).groupBy("asked").agg(F.max_by("state", F.struct("t0", "event_id")).alias("state"))
    item = J.points_in_intervals(asked, held, TRACK, "t", "t0", "t1", 3600.0).groupBy("asked").agg(F.min_by("item", F.struct("t0", "event_id")).alias("item"))
    return (asked.join(state, "asked", "left").join(item, "asked", "left")
            .select(F.col("asked").alias("event_id"), F.coalesce("state", F.lit("unknown")).alias("state"), F.coalesce("item", "state").alias("name")))


@query("notes_shown", """, n AS (SELECT event_id AS note, game_id, t - CASE WHEN value > 100 THEN 0 ELSE 20 END AS a, t + CASE WHEN value > 100 THEN 100 ELSE 50 END AS b, t AS noted FROM ev WHERE kind = 'purchase')
SELECT p.event_id, note, row_number() OVER (PARTITION BY p.event_id ORDER BY noted, note) AS place FROM ev p JOIN n ON n.game_id = p.game_id AND p.t BETWEEN a AND b WHERE p.kind = 'view'""")
def notes_shown(spark, d):
    """Notes on show at a moment: a stretch about their time, or from it on for those that last; in order of time, then number."""
    ev = samples(spark, d)
    lasting = F.col("value") > 100
    notes = ev.where("kind = 'purchase'").select("game_id", F.col("event_id").alias("note"), F.col("t").alias("at"), (F.col("t") - F.when(lasting, 0).otherwise(20)).alias("a"), (F.col("t") + F.when(lasting, 100).otherwise(50)).alias("b"))
    shown = J.points_in_intervals(ev.where("kind = 'view'").select("game_id", "event_id", "t"), notes, ["game_id"], "t", "a", "b", 120.0)
    return shown.select("event_id", "note", F.row_number().over(Window.partitionBy("event_id").orderBy("at", "note")).alias("place"))


_NEAREST = """SELECT p.event_id, r.t, r.alive, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(r.t - p.t), r.t, r.event_id DESC) AS nth
  FROM ev p JOIN ev r ON r.game_id = p.game_id AND r.slot = p.slot AND r.kind IN ('view', 'error') WHERE p.kind = 'click'"""


@query("nearest_then_alive", f""", n AS ({_NEAREST}), a AS ({_NEAREST.replace("WHERE p.kind", "AND r.alive WHERE p.kind")})
SELECT event_id, n.t AS any_t, CASE WHEN n.alive AND abs(n.t - ev.t) <= 900 THEN n.t END AS checked_t, CASE WHEN abs(a.t - ev.t) <= 900 THEN a.t END AS alive_t
FROM ev LEFT JOIN (SELECT * FROM n WHERE nth = 1) n USING (event_id) LEFT JOIN (SELECT * FROM a WHERE nth = 1) a USING (event_id) WHERE kind = 'click'""")
def nearest_then_alive(spark, d):
    """The nearest frame whatever its distance; the same only if it is alive and near; the nearest alive frame if near."""
    ev = samples(spark, d)
    frames = ev.where("kind IN ('view', 'error')").select(*TRACK, "t", "alive", F.col("event_id").alias("__tie"))
    asked = ev.where("kind = 'click'").select(*TRACK, "event_id", "t")
    nearest = J.asof(asked, frames, TRACK, "t", ["alive"]).withColumnRenamed("found_t", "any_t")
    checked = nearest.withColumn("checked_t", F.when(F.col("alive") & (F.abs(F.col("any_t") - F.col("t")) <= 900), F.col("any_t"))).drop("alive")
    return J.asof(checked, frames.where("alive"), TRACK, "t", [], 900.0).select("event_id", "any_t", "checked_t", F.col("found_t").alias("alive_t"))


_RANGES = ", rg AS (SELECT event_id AS range_id, game_id, t - value * 20 AS r0, t + value * 20 AS r1 FROM ev WHERE kind = 'signup'), sp AS (SELECT event_id, game_id, t AS s0, t + value * 10 AS s1 FROM ev WHERE kind = 'click')"


@query("midpoint_ranges", f"""{_RANGES}, m AS (SELECT sp.event_id, max(range_id) AS last_id, min(range_id) AS first_id FROM sp JOIN rg ON sp.game_id = rg.game_id AND (s0 + s1) / 2 BETWEEN r0 AND r1 GROUP BY sp.event_id)
SELECT event_id, last_id AS overwritten, CASE WHEN event_id % 3 = 0 THEN -1 ELSE first_id END AS only_empty FROM sp LEFT JOIN m USING (event_id)""")
def midpoint_ranges(spark, d):
    """The range that holds a span's middle: the last one written, or the first one where nothing stood before."""
    ev = samples(spark, d)
    ranges = ev.where("kind = 'signup'").select("game_id", F.col("event_id").alias("range_id"), (F.col("t") - F.col("value") * 20).alias("r0"), (F.col("t") + F.col("value") * 20).alias("r1"))
    spans = ev.where("kind = 'click'").select("game_id", "event_id", ((F.col("t") + (F.col("t") + F.col("value") * 10)) / 2).alias("middle"))
    found = J.points_in_intervals(spans, ranges, ["game_id"], "middle", "r0", "r1", 3600.0).groupBy("event_id").agg(F.max("range_id").alias("last_id"), F.min("range_id").alias("first_id"))
    stood = F.when(F.col("event_id") % 3 == 0, F.lit(-1))
    return spans.join(found, "event_id", "left").select("event_id", F.col("last_id").alias("overwritten"), F.coalesce(stood, "first_id").alias("only_empty"))


@query("replaced_overlaps", f"""{_RANGES} SELECT event_id, s0 AS t0, s1 AS t1, 'kept' AS origin FROM sp WHERE NOT EXISTS (SELECT 1 FROM rg WHERE rg.game_id = sp.game_id AND r0 < s1 AND r1 > s0)
UNION ALL SELECT range_id, r0, r1, 'new' FROM rg""")
def replaced_overlaps(spark, d):
    """New ranges, and of the old ones those that share no time with a new one."""
    ev = samples(spark, d)
    new = ev.where("kind = 'signup'").select("game_id", F.col("event_id").alias("range_id"), (F.col("t") - F.col("value") * 20).alias("b0"), (F.col("t") + F.col("value") * 20).alias("b1"))
    old = ev.where("kind = 'click'").select("game_id", "event_id", F.col("t").alias("a0"), (F.col("t") + F.col("value") * 10).alias("a1"))
    # an old one is gone where a new one that begins before its end ends after its start: the latest such end decides
    both = old.withColumn("at", F.col("a1")).unionByName(new.select("game_id", F.col("b0").alias("at"), "b1"), allowMissingColumns=True)
    order = Window.partitionBy("game_id").orderBy("at", F.col("b1").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    kept = both.withColumn("reach", F.max("b1").over(order)).where("event_id IS NOT NULL AND (reach IS NULL OR reach <= a0)")
    kept = kept.select("event_id", F.col("a0").alias("t0"), F.col("a1").alias("t1"), F.lit("kept").alias("origin"))
    return kept.unionByName(new.select(F.col("range_id").alias("event_id"), F.col("b0").alias("t0"), F.col("b1").alias("t1"), F.lit("new").alias("origin")))


@query("captures_by_point", """, o AS (SELECT game_id, CAST(slot % 3 AS INT) AS point, t AS t0, coalesce(lead(t) OVER w, t + 60) - CASE WHEN event_id % 4 = 0 THEN 5 ELSE 0 END AS t1, CASE WHEN kind = 'error' THEN 'none' ELSE team END AS owner FROM ev WINDOW w AS (PARTITION BY game_id, slot % 3 ORDER BY t)),
  b AS (SELECT *, last_value(CASE WHEN owner <> 'none' THEN owner END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(owner) OVER w AS was, t0 - lag(t1) OVER w AS gap FROM o WINDOW w AS (PARTITION BY game_id, point ORDER BY t0))
SELECT game_id, point, owner AS team, count(*) AS captures, min(t0) AS first_t FROM b WHERE owner <> 'none' AND (before <> owner OR (before IS NULL AND was = 'none' AND gap <= 3)) GROUP BY ALL""")
def captures_by_point(spark, d):
    point = (F.col("slot") % 3).cast("int")
    w = Window.partitionBy("game_id", "point").orderBy("t0")
    owners = samples(spark, d).select("game_id", point.alias("point"), F.col("t").alias("t0"), F.when(F.col("kind") == "error", "none").otherwise(F.col("team")).alias("owner"), "event_id")
    owners = owners.withColumn("t1", F.coalesce(F.lead("t0").over(w), F.col("t0") + 60) - F.when(F.col("event_id") % 4 == 0, 5).otherwise(0))
    return M.captures(owners).groupBy("game_id", "point", "team").agg(F.count("*").alias("captures"), F.min("t").alias("first_t"))


@query("score_slope", """, sc AS (SELECT game_id, CAST(floor(t / 600) AS BIGINT) AS b, sum(CASE WHEN team = 'A' THEN value ELSE 0 END) AS a, sum(CASE WHEN team = 'B' THEN value ELSE 0 END) AS z FROM ev GROUP BY ALL),
  l AS (SELECT game_id, b, CASE WHEN ra >= 100 AND rb < 100 THEN 'A' WHEN rb >= 100 AND ra < 100 THEN 'B' END AS label FROM (SELECT game_id, b, coalesce(sum(a) OVER w, 0) AS ra, coalesce(sum(z) OVER w, 0) AS rb FROM sc WINDOW w AS (PARTITION BY game_id ORDER BY b RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING))),
  e AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY game_id ORDER BY b)),
  r AS (SELECT game_id, run, any_value(label) AS label, min(b) AS t0, max(b) AS t1 FROM (SELECT *, sum(s) OVER (PARTITION BY game_id ORDER BY b) AS run FROM e) GROUP BY game_id, run)
SELECT game_id, t0, t1, CASE WHEN label IS NULL AND t1 - t0 < 6 AND lag(label) OVER w = lead(label) OVER w THEN lag(label) OVER w ELSE label END AS label FROM r WINDOW w AS (PARTITION BY game_id ORDER BY t0)""")
def score_slope(spark, d):
    """Who holds a point by which score rises about each step, if one alone does; short gaps between equal labels are filled."""
    value = {team: F.sum(F.when(F.col("team") == team, F.col("value")).otherwise(0.0)) for team in "AB"}
    steps = samples(spark, d).groupBy("game_id", F.floor(F.col("t") / 600).alias("b")).agg(value["A"].alias("a"), value["B"].alias("z"))
    w = Window.partitionBy("game_id").orderBy("b").rangeBetween(-2, 3)
    rise_a, rise_b = F.sum("a").over(w), F.sum("z").over(w)
    labels = steps.select("game_id", "b", F.when((rise_a >= 100) & (rise_b < 100), "A").when((rise_b >= 100) & (rise_a < 100), "B").alias("label"))
    runs = S.label_runs(labels, ["game_id"], ["b"], "label")
    by = Window.partitionBy("game_id").orderBy("t0")
    left, right = F.lag("label").over(by), F.lead("label").over(by)
    return runs.select("game_id", "t0", "t1", F.when(F.col("label").isNull() & (F.col("t1") - F.col("t0") < 6) & (left == right), left).otherwise(F.col("label")).alias("label"))


@query("capture_rise", """, r AS (SELECT game_id, team, t, event_id, floor(value) AS v FROM ev WHERE kind IN ('view', 'click')),
  u AS (SELECT game_id, team, t, event_id, CASE WHEN t - lag(t) OVER w > 1800 THEN 0 ELSE greatest(0, v - lag(v) OVER w) END AS rise, t - lag(t) OVER (PARTITION BY game_id ORDER BY t, event_id) AS gap FROM r WINDOW w AS (PARTITION BY game_id, team ORDER BY t, event_id))
SELECT event_id, CASE WHEN coalesce(gap, 0) <= 1200 THEN last_value(CASE WHEN rise > 0 THEN team END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY t, event_id) END AS holder FROM u""")
def capture_rise(spark, d):
    """Whose score rose last; nobody's colour after a long silence, and no rise over one."""
    reads = samples(spark, d).where("kind IN ('view', 'click')").select("game_id", "team", "t", "event_id", F.floor("value").alias("v"))
    own, all_ = Window.partitionBy("game_id", "team").orderBy("t", "event_id"), Window.partitionBy("game_id").orderBy("t", "event_id")
    rise = F.when(F.col("t") - F.lag("t").over(own) > 1800, 0).otherwise(F.greatest(F.lit(0), F.col("v") - F.lag("v").over(own)))
    risen = reads.withColumn("rise", rise).withColumn("gap", F.col("t") - F.lag("t").over(all_))
    return risen.select("event_id", F.when(F.coalesce("gap", F.lit(0.0)) <= 1200, F.last(F.when(F.col("rise") > 0, F.col("team")), ignorenulls=True).over(all_)).alias("holder"))


_FAST = """, p AS (SELECT game_id, slot, t, event_id, x, y, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) >= 0.3 AND lead(t) OVER w - t <= 3600 AS fast, lead(t) OVER w AS nt, lead(x) OVER w AS nx FROM ev WHERE alive WINDOW w AS (PARTITION BY game_id, slot ORDER BY t, event_id)),
  q AS (SELECT *, sum(CASE WHEN coalesce(fast, false) THEN 0 ELSE 1 END) OVER (PARTITION BY game_id, slot ORDER BY t, event_id) AS isle FROM p),
  rides AS (SELECT game_id, slot, isle, max(nt) AS t, arg_min(x, (t, event_id)) AS x0, arg_max(nx, (t, event_id)) AS x1 FROM q WHERE fast GROUP BY ALL)"""


@query("rides_without_bounces", f"""{_FAST}, s AS (SELECT *, x1 > x0 AS up FROM rides WHERE abs(x1 - x0) >= 0.2),
  b AS (SELECT *, up <> lag(up) OVER w AND t - lag(t) OVER w <= 7200 AS back, up <> lead(up) OVER w AND lead(t) OVER w - t <= 7200 AS next FROM s WINDOW w AS (PARTITION BY game_id, slot ORDER BY t))
SELECT game_id, slot, t, up FROM b WHERE NOT coalesce(back, false) AND NOT coalesce(next, false)""")
def rides_without_bounces(spark, d):
    """Islands of fast steps that lead from one side to the other; rides there and straight back are both dropped."""
    w = Window.partitionBy(*TRACK).orderBy("t", "event_id")
    step = F.sqrt(F.pow(F.lead("x").over(w) - F.col("x"), F.lit(2)) + F.pow(F.lead("y").over(w) - F.col("y"), F.lit(2)))
    rows = samples(spark, d).where("alive").withColumn("fast", F.coalesce((step >= 0.3) & (F.lead("t").over(w) - F.col("t") <= 3600), F.lit(False)))
    rows = rows.withColumn("nt", F.lead("t").over(w)).withColumn("nx", F.lead("x").over(w))
    isles = rows.withColumn("isle", F.sum((~F.col("fast")).cast("int")).over(w)).where("fast").groupBy(*TRACK, "isle").agg(
        F.max("nt").alias("t"), F.min_by("x", F.struct("t", "event_id")).alias("x0"), F.max_by("nx", F.struct("t", "event_id")).alias("x1"))
    rides = isles.where("abs(x1 - x0) >= 0.2").withColumn("up", F.col("x1") > F.col("x0"))
    by = Window.partitionBy(*TRACK).orderBy("t")
    back = (F.col("up") != F.lag("up").over(by)) & (F.col("t") - F.lag("t").over(by) <= 7200)
    ahead = (F.col("up") != F.lead("up").over(by)) & (F.lead("t").over(by) - F.col("t") <= 7200)
    marked = rides.select(*TRACK, "t", "up", F.coalesce(back, F.lit(False)).alias("back"), F.coalesce(ahead, F.lit(False)).alias("ahead"))
    return marked.where("NOT back AND NOT ahead").drop("back", "ahead")


@query("axis_fraction", f""", c AS (SELECT game_id, team, avg(x) AS cx, avg(y) AS cy FROM ev WHERE kind = 'signup' GROUP BY ALL),
  a AS (SELECT own.game_id, own.team, own.cx, own.cy, (foe.cx - own.cx) * {ARENA_M[0]} AS ux, (foe.cy - own.cy) * {ARENA_M[1]} AS uy FROM c own JOIN c foe ON foe.game_id = own.game_id AND foe.team <> own.team),
  f AS (SELECT event_id, CASE WHEN ux * ux + uy * uy >= 1e-9 THEN ((x - cx) * {ARENA_M[0]} * ux + (y - cy) * {ARENA_M[1]} * uy) / (ux * ux + uy * uy) END AS f FROM ev LEFT JOIN a USING (game_id, team) WHERE kind = 'error')
SELECT event_id, round(f, 5) AS along, CASE WHEN f IS NOT NULL THEN round(greatest(0, least(1, f)), 5) END AS clamped FROM f""")
def axis_fraction(spark, d):
    """Where a position lies on the line from its team's own start (0) to the other's (1), and the same kept within it."""
    ev = samples(spark, d)
    starts = ev.where("kind = 'signup'").groupBy("game_id", "team").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    foes = starts.select("game_id", F.when(F.col("team") == "A", "B").otherwise("A").alias("team"), F.col("cx").alias("fx"), F.col("cy").alias("fy"))
    ux, uy = (F.col("fx") - F.col("cx")) * ARENA_M[0], (F.col("fy") - F.col("cy")) * ARENA_M[1]
    axes = starts.join(foes, ["game_id", "team"]).select("*", ux.alias("ux"), uy.alias("uy")).withColumn("n2", F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy"))
    along = F.when(F.col("n2") >= 1e-9, ((F.col("x") - F.col("cx")) * ARENA_M[0] * F.col("ux") + (F.col("y") - F.col("cy")) * ARENA_M[1] * F.col("uy")) / F.col("n2"))
    placed = ev.where("kind = 'error'").join(axes, ["game_id", "team"], "left").select("event_id", along.alias("f"))
    return placed.select("event_id", F.round("f", 5).alias("along"), F.when(F.col("f").isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f"))), 5)).alias("clamped"))


@query("plan_positions", """, s AS (SELECT game_id, slot, event_id, value * 30 AS len, x, y, coalesce(sum(value * 30) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ev WHERE kind = 'purchase' WINDOW w AS (PARTITION BY game_id, slot ORDER BY t, event_id)),
  asked AS (SELECT event_id, game_id, slot, t % 3600 AS moment FROM ev WHERE kind = 'view'),
  h AS (SELECT a.event_id, moment, start, len, x, y, nx, ny, row_number() OVER (PARTITION BY a.event_id ORDER BY start DESC, s.event_id DESC) AS nth FROM asked a JOIN s ON s.game_id = a.game_id AND s.slot = a.slot AND start <= moment)
SELECT event_id, round(x + coalesce((nx - x) * least(1, (moment - start) / nullif(len, 0)), 0), 6) AS x, round(y + coalesce((ny - y) * least(1, (moment - start) / nullif(len, 0)), 0), 6) AS y FROM h WHERE nth = 1""")
def plan_positions(spark, d):
    """Steps of a plan start when those before them end; at a moment a pawn stands between its step's place and the next one's."""
    ev = samples(spark, d)
    w = Window.partitionBy(*TRACK).orderBy("t", "event_id")
    steps = ev.where("kind = 'purchase'").select(*TRACK, "event_id", (F.col("value") * 30).alias("len"), "x", "y",
                                                  F.coalesce(F.sum(F.col("value") * 30).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("t"), F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))
    asked = ev.where("kind = 'view'").select(*TRACK, "event_id", (F.col("t") % 3600).alias("t"))
    found = J.asof(asked, steps.withColumn("__tie", F.col("event_id")), TRACK, "t", ["len", "x", "y", "nx", "ny"], direction="backward").where("found_t IS NOT NULL")
    share = F.least(F.lit(1.0), F.try_divide(F.col("t") - F.col("found_t"), F.col("len")))
    return found.select("event_id", *[F.round(F.col(c) + F.coalesce((F.col(f"n{c}") - F.col(c)) * share, F.lit(0.0)), 6).alias(c) for c in ("x", "y")])


@query("observed_stretches", """, e AS (SELECT *, CASE WHEN lag(slot) OVER w IS DISTINCT FROM slot THEN 1 ELSE 0 END AS s FROM ev WINDOW w AS (PARTITION BY game_id ORDER BY t, event_id)),
  r AS (SELECT game_id, slot, min(t) AS t0, max(t) AS t1 FROM (SELECT *, sum(s) OVER (PARTITION BY game_id ORDER BY t, event_id) AS run FROM e) GROUP BY game_id, slot, run)
SELECT game_id, slot, count(*) AS stretches, round(sum(t1 - t0), 3) AS seconds, (SELECT count(*) FROM ev u WHERE u.game_id = r.game_id AND u.slot = r.slot AND u.value > 200) AS doubtful FROM r WHERE t1 - t0 >= 120 GROUP BY game_id, slot""")
def observed_stretches(spark, d):
    """How long each player is watched, stretches under two minutes left out, with how many doubtful positions."""
    ev = samples(spark, d)
    runs = S.label_runs(ev, ["game_id"], ["t", "event_id"], "slot").where("t1 - t0 >= 120")
    watched = runs.groupBy(*TRACK).agg(F.count("*").alias("stretches"), F.round(F.sum(F.col("t1") - F.col("t0")), 3).alias("seconds"))
    doubts = ev.where("value > 200").groupBy(*TRACK).agg(F.count("*").alias("doubtful"))
    return watched.join(doubts, TRACK, "left").fillna(0, ["doubtful"])
