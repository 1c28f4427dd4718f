"""Votes, clipped windows, reconciliations, merged labels and lookups over runs and marks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.operators import joins as J
from matchlake.operators import series as S
from matchlake.plans.registry import query
from matchlake.sources.match_view import samples
from matchlake.sources.tables import table

KEYS, ORDER = ["game_id", "slot"], ["t", "event_id"]

_TEAM_RUNS = """, r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY game_id, team ORDER BY t, event_id) AS run FROM ev)"""


def _team_runs(spark, d):
    """Rows numbered by runs of equal team within a game."""
    before = F.lag("team").over(Window.partitionBy("game_id").orderBy(*ORDER))
    rows = samples(spark, d).withColumn("before", before)
    return S.with_runs(rows, ["game_id"], ORDER, ~F.col("team").eqNullSafe(F.col("before")))


@query("short_runs_dropped", f"{_TEAM_RUNS} SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY game_id, team, run) >= 2 THEN team END AS label FROM r")
def short_runs_dropped(spark, d):
    n = F.count("*").over(Window.partitionBy("game_id", "run"))
    return _team_runs(spark, d).select("event_id", F.when(n >= 2, F.col("team")).alias("label"))


@query("majority_source", f"""{_TEAM_RUNS}, c AS (SELECT game_id, team, run, kind, count(*) AS n, min(t) AS first FROM r GROUP BY ALL)
SELECT game_id, team, round(t0, 3) AS t0, kind AS source FROM (SELECT *, min(first) OVER (PARTITION BY game_id, team, run) AS t0, row_number() OVER (PARTITION BY game_id, team, run ORDER BY n DESC, kind) AS nth FROM c) WHERE nth = 1""")
def majority_source(spark, d):
    counted = _team_runs(spark, d).groupBy("game_id", "run", "team", "kind").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    return (counted.groupBy("game_id", "run", "team").agg(F.round(F.min("first"), 3).alias("t0"), F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("source")).drop("run"))


@query("clipped_windows", """, c AS (SELECT event_id, t, lag(t) OVER w AS a, lead(t) OVER w AS b FROM ev WHERE kind = 'purchase' WINDOW w AS (PARTITION BY game_id, slot ORDER BY t, event_id))
SELECT event_id, round(greatest(t - 3600, coalesce(a, t - 3600)), 3) AS t0, round(least(t + 3600, coalesce(b, t + 3600)), 3) AS t1 FROM c""")
def clipped_windows(spark, d):
    """A window of an hour around each change ends at the changes beside it."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    changes = samples(spark, d).where("kind = 'purchase'")
    return changes.select("event_id", F.round(F.greatest(F.col("t") - 3600, F.lag("t").over(w)), 3).alias("t0"), F.round(F.least(F.col("t") + 3600, F.lead("t").over(w)), 3).alias("t1"))


@query("offset_vote", """, m AS (SELECT game_id, median(value) AS mid, count(*) AS n FROM ev GROUP BY game_id)
SELECT game_id, n, CASE WHEN n >= 12 AND avg(CASE WHEN abs(value - mid) <= 150 THEN 1.0 ELSE 0 END) >= 0.5 THEN round(mid, 4) END AS shift FROM ev JOIN m USING (game_id) GROUP BY game_id, n, mid""")
def offset_vote(spark, d):
    """A median counts where at least 12 readings exist and half of them lie near it."""
    rows = samples(spark, d).select("game_id", "value")
    mid = rows.groupBy("game_id").agg(F.median("value").alias("mid"), F.count("*").alias("n"))
    near = F.avg((F.abs(F.col("value") - F.col("mid")) <= 150).cast("double"))
    return (rows.join(mid, "game_id").groupBy("game_id", "n", "mid").agg(near.alias("near"))
            .select("game_id", "n", F.when((F.col("n") >= 12) & (F.col("near") >= 0.5), F.round("mid", 4)).alias("shift")))


@query("run_delta_ratio", """, r AS (SELECT *, sum(CASE WHEN alive THEN 0 ELSE 1 END) OVER (PARTITION BY game_id, slot ORDER BY t, event_id) AS run FROM ev),
  d AS (SELECT *, t - min(t) OVER (PARTITION BY game_id, slot, run) AS age, value - lag(value) OVER w AS dv, t - lag(t) OVER w AS dt FROM r WHERE alive WINDOW w AS (PARTITION BY game_id, slot, run ORDER BY t, event_id))
SELECT game_id, slot, count(*) AS steps, round(sum(dv) / nullif(sum(dt), 0), 6) AS ratio FROM d WHERE age > 600 AND dt IS NOT NULL GROUP BY ALL""")
def run_delta_ratio(spark, d):
    """Change of value by time over steps inside a life, after ten minutes to settle."""
    rows = S.with_runs(samples(spark, d), KEYS, ORDER, ~F.col("alive")).where("alive")
    run = Window.partitionBy(*KEYS, "run")
    w = run.orderBy(*ORDER)
    steps = rows.select(*KEYS, (F.col("t") - F.min("t").over(run)).alias("age"), (F.col("value") - F.lag("value").over(w)).alias("dv"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    return (steps.where("age > 600 AND dt IS NOT NULL").groupBy(*KEYS)
            .agg(F.count("*").alias("steps"), F.round(F.try_divide(F.sum("dv"), F.sum("dt")), 6).alias("ratio")))


@query("weighted_rollup", """, g AS (SELECT coalesce(kind, 'all') AS kind, coalesce(team, 'all') AS team, count(*) AS n, count(DISTINCT slot) AS slots, round(sum(value * x) / nullif(sum(x), 0), 4) AS weighted, round(min(value), 4) AS low, round(max(value), 4) AS high, count(DISTINCT game_id) < 5 AS thin
  FROM ev GROUP BY GROUPING SETS ((kind, team), (kind), ())) SELECT * FROM g""")
def weighted_rollup(spark, d):
    rows = samples(spark, d).select("kind", "team", "slot", "game_id", "value", "x")
    sets = rows.groupingSets([["kind", "team"], ["kind"], []], "kind", "team").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.round(F.try_divide(F.sum(F.col("value") * F.col("x")), F.sum("x")), 4).alias("weighted"),
        F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), (F.count_distinct("game_id") < 5).alias("thin"))
    return sets.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("kind", "team")})


@query("nearest_lag_errors", """, c AS (SELECT c.game_id, c.t, (SELECT max(p.t) FROM ev p WHERE p.kind = 'purchase' AND p.game_id = c.game_id AND p.slot = c.slot AND p.t <= c.t) AS b,
   (SELECT min(p.t) FROM ev p WHERE p.kind = 'purchase' AND p.game_id = c.game_id AND p.slot = c.slot AND p.t >= c.t) AS a FROM ev c WHERE c.kind = 'click'),
  l AS (SELECT game_id, CASE WHEN a IS NULL OR t - b <= a - t THEN b - t ELSE a - t END AS lag FROM c)
SELECT game_id, count(*) AS marks, count(*) FILTER (abs(lag) <= 7200) AS matched, round(median(CASE WHEN abs(lag) <= 7200 THEN lag END), 3) AS median_lag FROM l GROUP BY game_id""")
def nearest_lag_errors(spark, d):
    ev = samples(spark, d)
    marks, seen = ev.where("kind = 'click'").select(*KEYS, "t"), ev.where("kind = 'purchase'").select(*KEYS, "t")
    met = J.asof(marks, seen, KEYS, "t", [], tolerance=7200.0)
    return met.groupBy("game_id").agg(F.count("*").alias("marks"), F.count("found_t").alias("matched"), F.round(F.median(F.col("found_t") - F.col("t")), 3).alias("median_lag"))


@query("near_at_step", """, s AS (SELECT game_id, CAST(floor(t / 1800) AS BIGINT) AS step, slot, team, arg_max(x, t) AS x, arg_max(y, t) AS y FROM ev WHERE alive GROUP BY ALL)
SELECT a.game_id, a.step, a.slot AS slot_a, b.slot AS slot_b FROM s a JOIN s b ON a.game_id = b.game_id AND a.step = b.step AND a.team = 'A' AND b.team = 'B' WHERE sqrt(pow((a.x - b.x) * 31.0, 2) + pow((a.y - b.y) * 16.5, 2)) <= 8""")
def near_at_step(spark, d):
    """Opponents within eight metres at a step of half an hour; a step has one row a slot, so eight at most."""
    steps = samples(spark, d).where("alive").groupBy("game_id", F.floor(F.col("t") / 1800).alias("step"), "slot", "team").agg(F.max_by("x", "t").alias("x"), F.max_by("y", "t").alias("y"))

    def side(team):
        return steps.where(F.col("team") == team).select("game_id", "step", F.col("slot").alias(f"slot_{team.lower()}"), F.col("x").alias(f"x{team}"), F.col("y").alias(f"y{team}"))

    apart = F.sqrt(F.pow((F.col("xA") - F.col("xB")) * 31.0, F.lit(2)) + F.pow((F.col("yA") - F.col("yB")) * 16.5, F.lit(2)))
    return side("A").join(side("B"), ["game_id", "step"]).where(apart <= 8).select("game_id", "step", "slot_a", "slot_b")


@query("reconcile_intervals", """, f AS (SELECT event_id, game_id, slot, kind, t AS t0, t + value * 10 AS t1 FROM ev)
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM f c WHERE c.kind = 'purchase' AND c.game_id = f.game_id AND c.slot = f.slot AND least(c.t1, f.t1) > greatest(c.t0, f.t0)) THEN 'skipped' ELSE 'new' END AS state FROM f WHERE kind = 'click'""")
def reconcile_intervals(spark, d):
    """Found intervals that share time with a confirmed one are skipped, the rest are new."""
    spans = samples(spark, d).select("event_id", *KEYS, "kind", F.col("t").alias("t0"), (F.col("t") + F.col("value") * 10).alias("t1"))
    found = spans.where("kind = 'click'").select("event_id", *KEYS, F.col("t0").alias("a0"), F.col("t1").alias("a1"))
    sure = spans.where("kind = 'purchase'").select(*KEYS, F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    known = J.overlaps(found, sure, KEYS, 3600.0).select("event_id", F.lit("skipped").alias("state")).distinct()
    return found.select("event_id").join(known, "event_id", "left").select("event_id", F.coalesce("state", F.lit("new")).alias("state"))


@query("tolerance_lookup", """, e AS (SELECT * FROM ev WHERE kind = 'click') SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM ev p WHERE p.kind = 'purchase' AND p.game_id = e.game_id AND p.slot = e.slot AND abs(p.t - e.t) < 900)""")
def tolerance_lookup(spark, d):
    ev = samples(spark, d)
    a, b = ev.where("kind = 'click'").select("event_id", *KEYS, F.col("t").alias("ta")), ev.where("kind = 'purchase'").select(*KEYS, F.col("t").alias("tb"))
    return J.within(a, b, KEYS, "ta", "tb", -900.0, 900.0).where(F.abs(F.col("tb") - F.col("ta")) < 900).select("event_id").distinct()


@query("prefix_filter", "SELECT p_brand, count(*) AS n FROM part WHERE p_type LIKE 'S%' GROUP BY p_brand")
def prefix_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_type").startswith("S")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("conditional_reset", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def conditional_reset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))


@query("array_involves", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_suppkey <= 3)")
def array_involves(spark, d):
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))
    return held.where(F.exists("suppliers", lambda s: s <= 3)).select("l_orderkey")


@query("priority_merge", """, m AS (SELECT game_id, CAST(floor(t / 3600) AS BIGINT) AS step, max(CASE WHEN kind = 'purchase' THEN team END) AS p, max(CASE WHEN kind = 'click' THEN team END) AS c, max(CASE WHEN kind = 'view' THEN team END) AS v FROM ev GROUP BY ALL)
SELECT game_id, step, coalesce(p, c, v) AS label, CASE WHEN p IS NOT NULL THEN 'purchase' WHEN c IS NOT NULL THEN 'click' WHEN v IS NOT NULL THEN 'view' END AS source FROM m""")
def priority_merge(spark, d):
    ranked = ("purchase", "click", "view")
    steps = samples(spark, d).groupBy("game_id", F.floor(F.col("t") / 3600).alias("step")).agg(*[F.max(F.when(F.col("kind") == k, F.col("team"))).alias(k) for k in ranked])
    return steps.select("game_id", "step", F.coalesce(*ranked).alias("label"), F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in ranked]).alias("source"))


@query("brightest_per_step", """, b AS (SELECT game_id, CAST(floor(t / 1800) AS BIGINT) AS step, kind, row_number() OVER (PARTITION BY game_id, floor(t / 1800) ORDER BY alive DESC, value DESC, event_id DESC) AS nth FROM ev) SELECT game_id, step, kind FROM b WHERE nth = 1""")
def brightest_per_step(spark, d):
    return samples(spark, d).groupBy("game_id", F.floor(F.col("t") / 1800).alias("step")).agg(F.max_by("kind", F.struct("alive", "value", "event_id")).alias("kind"))


@query("longest_presence_run", """, v AS (SELECT *, t - lag(t) OVER (PARTITION BY game_id, slot ORDER BY t, event_id) AS since FROM ev WHERE value >= 50),
  s AS (SELECT *, sum(CASE WHEN since IS NULL OR since > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY game_id, slot ORDER BY t, event_id) AS run FROM v),
  l AS (SELECT game_id, slot, min(t) AS t0, max(t) AS t1, count(*) AS n FROM s GROUP BY game_id, slot, run)
SELECT game_id, slot, round(t0, 3) AS t0, round(t1, 3) AS t1, n FROM (SELECT *, row_number() OVER (PARTITION BY game_id, slot ORDER BY n DESC, t0) AS nth FROM l) WHERE nth = 1""")
def longest_presence_run(spark, d):
    runs = S.sessions(samples(spark, d).where("value >= 50"), KEYS, ORDER, 7200.0).groupBy(*KEYS, "run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    best = runs.groupBy(*KEYS).agg(F.max_by(F.struct("t0", "t1", "n"), F.struct("n", -F.col("t0"))).alias("b"))
    return best.select(*KEYS, F.round("b.t0", 3).alias("t0"), F.round("b.t1", 3).alias("t1"), "b.n")


@query("median_keep_previous", """, m AS (SELECT kind, game_id, CASE WHEN count(*) >= 6 THEN median(x) END AS m FROM ev GROUP BY ALL)
SELECT kind, game_id, round(last_value(m IGNORE NULLS) OVER (PARTITION BY kind ORDER BY game_id ROWS UNBOUNDED PRECEDING), 4) AS x FROM m""")
def median_keep_previous(spark, d):
    medians = samples(spark, d).groupBy("kind", "game_id").agg(F.when(F.count("*") >= 6, F.median("x")).alias("m"))
    w = Window.partitionBy("kind").orderBy("game_id").rowsBetween(Window.unboundedPreceding, 0)
    return medians.select("kind", "game_id", F.round(F.last("m", ignorenulls=True).over(w), 4).alias("x"))


@query("footer_totals", """, v AS (SELECT team, CASE WHEN team = 'A' OR alive THEN value END AS v, x FROM ev)
SELECT team, CASE WHEN count(v) = count(*) THEN round(sum(v), 3) END AS total, round(sum(v * x) / nullif(sum(CASE WHEN v IS NOT NULL THEN x END), 0), 4) AS weighted, round(median(v), 4) AS mid FROM v GROUP BY team""")
def footer_totals(spark, d):
    rows = samples(spark, d).select("team", "x", F.when((F.col("team") == "A") | F.col("alive"), F.col("value")).alias("v"))
    weight = F.sum(F.when(F.col("v").isNotNull(), F.col("x")))
    return rows.groupBy("team").agg(F.when(F.count("v") == F.count("*"), F.round(F.sum("v"), 3)).alias("total"),
                                    F.round(F.try_divide(F.sum(F.col("v") * F.col("x")), weight), 4).alias("weighted"), F.round(F.median("v"), 4).alias("mid"))


@query("substring_within_one_edit", """SELECT p_partkey FROM part WHERE len(list_filter(range(1, length(p_type) + 1), lambda i: levenshtein(substring(p_type, i, 4), 'PROMO') <= 1 OR levenshtein(substring(p_type, i, 5), 'PROMO') <= 1 OR levenshtein(substring(p_type, i, 6), 'PROMO') <= 1)) > 0""")
def substring_within_one_edit(spark, d):
    near = " OR ".join(f"levenshtein(substring(p_type, i, {k}), 'PROMO') <= 1" for k in (4, 5, 6))
    return table(spark, d, "part").where(F.expr(f"length(p_type) > 0 AND exists(sequence(1, length(p_type)), i -> {near})")).select("p_partkey")


@query("natural_order", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY regexp_replace(lower(c_name), '[0-9]+', '', 'g'), CAST(nullif(regexp_extract(c_name, '[0-9]+'), '') AS BIGINT) NULLS FIRST, c_custkey) AS place FROM customer""")
def natural_order(spark, d):
    """Names by their letters, then by their number as a number."""
    key = [F.regexp_replace(F.lower("c_name"), "[0-9]+", ""), F.expr("try_cast(regexp_extract(c_name, '[0-9]+', 0) AS bigint)").asc_nulls_first(), F.col("c_custkey")]
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*key)).alias("place"))


@query("next_to_check", """SELECT o_orderkey, coalesce(min(p) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(p) OVER (PARTITION BY o_custkey)) AS next
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS p FROM orders)""")
def next_to_check(spark, d):
    """The next open order of the same customer, from the start again after the last."""
    w = Window.partitionBy("o_custkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("p"))
    after = F.min("p").over(w.orderBy(F.desc("o_orderkey")).rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("o_orderkey", F.coalesce(after, F.min("p").over(w)).alias("next"))


@query("group_tag", """WITH c AS (SELECT c_mktsegment, left(c_name, 12) AS tag, count(*) AS n FROM customer GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, tag) AS nth, sum(n) OVER (PARTITION BY c_mktsegment) AS all_n FROM c)
SELECT c_mktsegment, tag, n FROM k WHERE nth = 1 AND 4 * n >= 3 * all_n""")
def group_tag(spark, d):
    """The beginning of a name that three quarters of a group share."""
    counted = table(spark, d, "customer").groupBy("c_mktsegment", F.left("c_name", F.lit(12)).alias("tag")).agg(F.count("*").alias("n"))
    best = counted.groupBy("c_mktsegment").agg(F.min_by(F.struct("tag", "n"), F.struct(-F.col("n"), "tag")).alias("b"), F.sum("n").alias("all_n"))
    return best.where("4 * b.n >= 3 * all_n").select("c_mktsegment", "b.tag", "b.n")


@query("ring_gap", ", a AS (SELECT event_id, (x * 360 + t * 6) % 360 AS a FROM ev) SELECT event_id, a < 30 OR (a >= 120 AND a < 150) AS open FROM a")
def ring_gap(spark, d):
    """Is a bearing in one of the gaps of a ring that turns by six degrees a second?"""
    a = (F.col("x") * 360 + F.col("t") * 6) % 360
    return samples(spark, d).select("event_id", ((a < 30) | ((a >= 120) & (a < 150))).alias("open"))


@query("falloff_range", """, b AS (SELECT kind, CAST(floor(y * 10) AS BIGINT) AS b, avg(value) AS v FROM ev GROUP BY ALL), m AS (SELECT *, max(v) OVER (PARTITION BY kind) AS most FROM b)
SELECT kind, coalesce(min(CASE WHEN v < 0.9 * most THEN b END), median(b)) AS reach FROM m GROUP BY kind""")
def falloff_range(spark, d):
    """The first band where the mean falls below nine tenths of the highest, else the middle band."""
    bands = samples(spark, d).groupBy("kind", F.floor(F.col("y") * 10).alias("b")).agg(F.avg("value").alias("v"))
    most = bands.withColumn("most", F.max("v").over(Window.partitionBy("kind")))
    return most.groupBy("kind").agg(F.coalesce(F.min(F.when(F.col("v") < 0.9 * F.col("most"), F.col("b"))).cast("double"), F.median("b")).alias("reach"))


@query("common_item", """WITH i AS (SELECT o_custkey, l_linestatus, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), o AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, min(l_linestatus) AS item FROM i JOIN o USING (o_custkey, n) WHERE n >= 2 GROUP BY o_custkey HAVING count(*) = 1""")
def common_item(spark, d):
    """The one item all of at least two sets of a key have in common."""
    sets = (table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
            .groupBy("o_custkey", "o_orderkey").agg(F.collect_set("l_linestatus").alias("items")))
    counted = sets.select("o_custkey", F.explode("items").alias("item")).groupBy("o_custkey", "item").agg(F.count("*").alias("n"))
    total = sets.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 2")
    return counted.join(total, ["o_custkey", "n"]).groupBy("o_custkey").agg(F.min("item").alias("item"), F.count("*").alias("k")).where("k = 1").drop("k")


@query("cell_percentile", """, c AS (SELECT game_id, CAST(floor(x * 10) AS BIGINT) AS ix, CAST(floor(y * 10) AS BIGINT) AS iy, count(*) AS n FROM ev GROUP BY ALL)
SELECT game_id, list_sort(list(n))[CAST(floor(0.98 * (count(*) - 1)) AS BIGINT) + 1] AS top FROM c GROUP BY game_id""")
def cell_percentile(spark, d):
    """The value at rank 98 % of a grid's positive cells; a grid has a hundred cells."""
    cells = samples(spark, d).groupBy("game_id", F.floor(F.col("x") * 10).alias("ix"), F.floor(F.col("y") * 10).alias("iy")).agg(F.count("*").alias("n"))
    ranked = cells.groupBy("game_id").agg(F.array_sort(F.collect_list("n")).alias("all"))
    return ranked.select("game_id", F.expr("element_at(all, cast(floor(0.98D * (size(all) - 1)) AS int) + 1)").alias("top"))
