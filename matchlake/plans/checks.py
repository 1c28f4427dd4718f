"""Small rules and control counts: filters, corrections, cadences, agreement, top groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.operators import joins as J
from matchlake.operators import series as S
from matchlake.plans.registry import query
from matchlake.plans.statistics import _KILLS, kills_of
from matchlake.sources.match_view import samples
from matchlake.sources.tables import table

KEYS, ORDER = ["game_id", "slot"], ["t", "event_id"]


@query("sample_cadence", """, s AS (SELECT DISTINCT game_id, t FROM ev) SELECT game_id, count(*) AS frames, round((max(t) - min(t)) / nullif(count(*) - 1, 0), 6) AS cadence FROM s GROUP BY game_id""")
def sample_cadence(spark, d):
    times = samples(spark, d).select("game_id", "t").distinct()
    return times.groupBy("game_id").agg(F.count("*").alias("frames"), F.round(F.try_divide(F.max("t") - F.min("t"), F.count("*") - 1), 6).alias("cadence"))


@query("distinct_counts", ", x AS (SELECT 1) SELECT kind, count(DISTINCT game_id) AS games, count(DISTINCT slot) AS slots, count(DISTINCT game_id * 10 + slot) AS tracks FROM ev GROUP BY kind")
def distinct_counts(spark, d):
    return samples(spark, d).groupBy("kind").agg(F.count_distinct("game_id").alias("games"), F.count_distinct("slot").alias("slots"), F.count_distinct("game_id", "slot").alias("tracks"))


@query("success_rate_with_verdict", """SELECT o_orderpriority, count(*) FILTER (o IN ('won', 'lost')) AS decided, CASE WHEN count(*) FILTER (o IN ('won', 'lost')) >= 5 THEN round(count(*) FILTER (o = 'won') / count(*) FILTER (o IN ('won', 'lost')), 4) END AS rate
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN 'series' WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'won' ELSE 'lost' END WHEN o_orderstatus = 'F' THEN 'won' WHEN o_orderstatus = 'O' THEN 'lost' END AS o FROM orders) GROUP BY ALL""")
def success_rate_with_verdict(spark, d):
    verdict = F.when(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 2 == 0, "won").otherwise("lost"))
    outcome = F.when(F.col("o_orderkey") % 7 == 0, "series").otherwise(F.coalesce(verdict, F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "O", "lost")))
    decided = F.count_if(F.col("o").isin("won", "lost"))
    return (table(spark, d, "orders").select("o_orderpriority", outcome.alias("o")).groupBy("o_orderpriority")
            .agg(decided.alias("decided"), F.when(decided >= 5, F.round(F.count_if(F.col("o") == "won") / decided, 4)).alias("rate")))


@query("sustained_presence", """, b AS (SELECT game_id, team, CAST(floor(t / 600) AS BIGINT) AS b, count(DISTINCT slot) AS n FROM ev WHERE alive GROUP BY ALL),
  i AS (SELECT *, b - row_number() OVER (PARTITION BY game_id, team ORDER BY b) AS isle FROM b WHERE n >= 2)
SELECT game_id, team, min(b) * 600 AS t0, (max(b) + 1) * 600 AS t1 FROM i GROUP BY game_id, team, isle HAVING count(*) >= 2""")
def sustained_presence(spark, d):
    steps = samples(spark, d).where("alive").groupBy("game_id", "team", F.floor(F.col("t") / 600).alias("b")).agg(F.count_distinct("slot").alias("n")).where("n >= 2")
    isles = steps.withColumn("isle", F.col("b") - F.row_number().over(Window.partitionBy("game_id", "team").orderBy("b")))
    return isles.groupBy("game_id", "team", "isle").agg((F.min("b") * 600).alias("t0"), ((F.max("b") + 1) * 600).alias("t1"), F.count("*").alias("n")).where("n >= 2").drop("isle", "n")


_STEPS = """, p AS (SELECT *, sqrt(pow((x - lag(x) OVER w) * 31.0, 2) + pow((y - lag(y) OVER w) * 16.5, 2)) AS dm, t - lag(t) OVER w AS dt FROM ev WINDOW w AS (PARTITION BY game_id, slot ORDER BY t, event_id))"""


def _steps(spark, d):
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    dm = F.sqrt(F.pow((F.col("x") - F.lag("x").over(w)) * 31.0, F.lit(2)) + F.pow((F.col("y") - F.lag("y").over(w)) * 16.5, F.lit(2)))
    return samples(spark, d).select("*", dm.alias("dm"), (F.col("t") - F.lag("t").over(w)).alias("dt"))


@query("stop_runs", f"""{_STEPS}, s AS (SELECT *, coalesce(dm / nullif(dt, 0) < 0.005, false) AS still FROM p),
  g AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY game_id, slot ORDER BY t, event_id) AS run FROM s)
SELECT game_id, slot, count(*) AS stops, round(max(len), 3) AS longest FROM (SELECT game_id, slot, run, sum(dt) AS len FROM g WHERE still GROUP BY ALL) WHERE len >= 3600 GROUP BY ALL""")
def stop_runs(spark, d):
    still = F.coalesce(F.try_divide(F.col("dm"), F.col("dt")) < 0.005, F.lit(False))
    runs = S.with_runs(_steps(spark, d).withColumn("still", still), KEYS, ORDER, ~F.col("still"))
    return runs.where("still").groupBy(*KEYS, "run").agg(F.sum("dt").alias("len")).where("len >= 3600").groupBy(*KEYS).agg(F.count("*").alias("stops"), F.round(F.max("len"), 3).alias("longest"))


@query("impossible_jumps", f"{_STEPS} SELECT game_id, count(*) FILTER (dm > 25) AS jumps, count(dm) AS steps FROM p GROUP BY game_id")
def impossible_jumps(spark, d):
    return _steps(spark, d).groupBy("game_id").agg(F.count_if(F.col("dm") > 25).alias("jumps"), F.count("dm").alias("steps"))


@query("spike_repair", """, n AS (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ev WINDOW w AS (PARTITION BY game_id, slot ORDER BY t, event_id))
SELECT event_id, round(CASE WHEN abs(value - a) > 200 AND abs(value - b) > 200 AND abs(a - b) < 100 THEN (a + b) / 2 ELSE value END, 4) AS value FROM n""")
def spike_repair(spark, d):
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    rows = samples(spark, d).select("event_id", "value", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"))
    spike = (F.abs(F.col("value") - F.col("a")) > 200) & (F.abs(F.col("value") - F.col("b")) > 200) & (F.abs(F.col("a") - F.col("b")) < 100)
    return rows.select("event_id", F.round(F.when(spike, (F.col("a") + F.col("b")) / 2).otherwise(F.col("value")), 4).alias("value"))


@query("circular_bridge", """, a AS (SELECT event_id, t, CASE WHEN kind <> 'view' THEN x * 360 END AS a, game_id, slot FROM ev),
  f AS (SELECT *, max(CASE WHEN a IS NOT NULL THEN t END) OVER b AS ta, arg_max(a, t) FILTER (a IS NOT NULL) OVER b AS va, min(CASE WHEN a IS NOT NULL THEN t END) OVER c AS tb, arg_min(a, t) FILTER (a IS NOT NULL) OVER c AS vb FROM a
   WINDOW b AS (PARTITION BY game_id, slot ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY game_id, slot ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  g AS (SELECT *, (vb - va + 540) % 360 - 180 AS arc FROM f)
SELECT event_id, round(CASE WHEN a IS NOT NULL THEN a WHEN tb > ta AND tb - ta <= 7200 THEN (va + arc * (t - ta) / (tb - ta) + 360) % 360 END, 4) AS angle FROM g""")
def circular_bridge(spark, d):
    rows = samples(spark, d).select("event_id", *KEYS, "t", F.when(F.col("kind") != "view", F.col("x") * 360).alias("a"))
    known, w = F.when(F.col("a").isNotNull(), F.struct("t", "a")), Window.partitionBy(*KEYS)
    # both ways from the start of an order, as a frame that is open at its end is read again for every row
    ahead, back = (w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (ORDER, [F.desc(c) for c in ORDER]))
    both = rows.withColumn("b", F.last(known, ignorenulls=True).over(ahead)).withColumn("c", F.last(known, ignorenulls=True).over(back))
    span, arc = F.col("c.t") - F.col("b.t"), (F.col("c.a") - F.col("b.a") + 540) % 360 - 180
    bridged = F.when((span > 0) & (span <= 7200), (F.col("b.a") + arc * (F.col("t") - F.col("b.t")) / span + 360) % 360)
    return both.select("event_id", F.round(F.coalesce("a", bridged), 4).alias("angle"))


@query("label_agreement", """, m AS (SELECT game_id, CAST(floor(t / 1800) AS BIGINT) AS b, max(CASE WHEN kind = 'click' THEN team END) AS a, max(CASE WHEN kind = 'purchase' THEN team END) AS p FROM ev GROUP BY ALL)
SELECT game_id, count(*) FILTER (a = p) AS agree, count(*) FILTER (a <> p) AS differ, count(*) FILTER (a IS NULL OR p IS NULL) AS unknown FROM m GROUP BY game_id""")
def label_agreement(spark, d):
    def label(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("team")))

    both = samples(spark, d).groupBy("game_id", F.floor(F.col("t") / 1800).alias("b")).agg(label("click").alias("a"), label("purchase").alias("p"))
    return both.groupBy("game_id").agg(F.count_if(F.col("a") == F.col("p")).alias("agree"), F.count_if(F.col("a") != F.col("p")).alias("differ"), F.count_if(F.col("a").isNull() | F.col("p").isNull()).alias("unknown"))


@query("kill_near_use", f"""{_KILLS}, u AS (SELECT game_id, slot, t FROM ev WHERE kind = 'purchase') SELECT event_id FROM kills k WHERE EXISTS (SELECT 1 FROM u WHERE u.game_id = k.game_id AND u.slot = k.killer AND abs(u.t - k.t) <= 1800)""")
def kill_near_use(spark, d):
    ev = samples(spark, d)
    kills = kills_of(ev).where("killer IS NOT NULL").select("event_id", "game_id", F.col("killer").alias("slot"), F.col("t").alias("ta"))
    uses = ev.where("kind = 'purchase'").select("game_id", "slot", F.col("t").alias("ta"))
    near = J.asof(kills.distinct(), uses, KEYS, "ta", [], 1800.0).where("found_t IS NOT NULL")
    return kills.join(near, ["event_id", "slot"], "left_semi").select("event_id")


@query("top_groups", "SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS nth FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) WHERE nth <= 2")
def top_groups(spark, d):
    counted = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return counted.withColumn("nth", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment"))).where("nth <= 2").drop("nth")


@query("absent_values_last", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END, c_acctbal DESC, c_custkey) AS place FROM customer")
def absent_values_last(spark, d):
    shown = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    order = [F.when(shown.isNull(), 1).otherwise(0), F.col("c_acctbal").desc(), F.col("c_custkey")]
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order)).alias("place"))


@query("common_prefix", "SELECT c_nationkey, lo[1:CAST((SELECT count(*) FROM (SELECT unnest(range(1, 30)) AS k) WHERE k <= length(lo) AND left(lo, k) = left(hi, k)) AS INT)] AS prefix FROM (SELECT c_nationkey, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_nationkey)")
def common_prefix(spark, d):
    # the prefix common to the least and the greatest name is common to all
    ends = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("lo"), F.max("c_name").alias("hi"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.length("lo")), lambda k: F.left("lo", k) == F.left("hi", k)))
    return ends.select("c_nationkey", F.left("lo", same).alias("prefix"))


@query("slot_corrections", """, c AS (SELECT event_id, game_id, t, slot, CASE WHEN t BETWEEN 10000 AND 40000 AND slot IN (1, 2) THEN 3 - slot ELSE slot END AS s1 FROM ev)
SELECT event_id, CAST(CASE WHEN t BETWEEN 30000 AND 60000 AND s1 IN (2, 3) THEN 5 - s1 ELSE s1 END AS INT) AS slot FROM c""")
def slot_corrections(spark, d):
    """Corrections (first, second, from, to) swap two slots in a stretch of time, one after the other."""
    slot = F.col("slot")
    for a, b, t0, t1 in ((1, 2, 10_000, 40_000), (2, 3, 30_000, 60_000)):
        slot = F.when(F.col("t").between(t0, t1) & slot.isin(a, b), F.lit(a + b) - slot).otherwise(slot)
    return samples(spark, d).select("event_id", slot.cast("int").alias("slot"))


@query("clipped_intervals", ", i AS (SELECT event_id, greatest(0, t - value * 20) AS a, least(80000, t + value * 20) AS b FROM ev) SELECT event_id, round(a, 3) AS t0, round(b, 3) AS t1 FROM i WHERE b > a")
def clipped_intervals(spark, d):
    spans = samples(spark, d).select("event_id", F.greatest(F.lit(0.0), F.col("t") - F.col("value") * 20).alias("a"), F.least(F.lit(80_000.0), F.col("t") + F.col("value") * 20).alias("b"))
    return spans.where("b > a").select("event_id", F.round("a", 3).alias("t0"), F.round("b", 3).alias("t1"))


@query("ok_games", """SELECT o_custkey, count(*) AS n, bool_and(o_orderstatus <> 'P' AND o_totalprice > 1000) AS ok FROM orders GROUP BY o_custkey HAVING count(*) > 0""")
def ok_games(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_and((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 1000)).alias("ok"))


@query("deaths_in_window", f"""{_KILLS} SELECT event_id, t - 3600 AS shown_from, EXISTS (SELECT 1 FROM kills q WHERE q.game_id = kills.game_id AND q.victim = kills.killer AND q.t > kills.t AND q.t <= kills.t + 3600) AS avenged FROM kills WHERE killer IS NOT NULL""")
def deaths_in_window(spark, d):
    kills = kills_of(samples(spark, d)).where("killer IS NOT NULL")
    a = kills.select("event_id", "game_id", F.col("killer").alias("who"), F.col("t").alias("ta"))
    b = kills_of(samples(spark, d)).select("game_id", F.col("victim").alias("who"), F.col("t").alias("tb"))
    # an elimination of several killers has a row for each, avenged or not by itself
    paid = J.within(a, b, ["game_id", "who"], "ta", "tb", 0.0, 3600.0).where("tb > ta").select("event_id", "who", F.lit(True).alias("paid")).distinct()
    return a.join(paid, ["event_id", "who"], "left").select("event_id", (F.col("ta") - 3600).alias("shown_from"), F.coalesce("paid", F.lit(False)).alias("avenged"))
