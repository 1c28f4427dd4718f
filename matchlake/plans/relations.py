"""As-of, interval, band, semi, anti and fuzzy joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.functions.text import similar
from matchlake.operators.names import alike_pairs
from matchlake.operators import joins as J
from matchlake.plans.registry import query
from matchlake.plans.statistics import _KILLS, kills_of
from matchlake.sources.match_view import samples
from matchlake.sources.tables import table

_SIDES = ", l AS (SELECT * FROM ev WHERE kind = 'error'), r AS (SELECT * FROM ev WHERE kind = 'click')"
_PICK = """SELECT event_id, found, dt FROM (SELECT l.event_id, r.event_id AS found, round(r.t - l.t, 3) AS dt, row_number() OVER (PARTITION BY l.event_id ORDER BY {order}) AS nth
FROM l JOIN r ON l.game_id = r.game_id AND l.slot = r.slot AND {on}) WHERE nth = 1"""


def _asof(spark, d, direction, tolerance):
    ev = samples(spark, d)
    left = ev.where("kind = 'error'").select("game_id", "slot", "t", "event_id")
    right = ev.where("kind = 'click'").select("game_id", "slot", "t", F.col("event_id").alias("found"))
    found = J.asof(left, right, ["game_id", "slot"], "t", ["found"], tolerance, direction).where("found IS NOT NULL")
    return found.select("event_id", "found", F.round(F.col("found_t") - F.col("t"), 3).alias("dt"))


@query("asof_nearest", f"{_SIDES} {_PICK.format(order='abs(r.t - l.t), r.t', on='abs(r.t - l.t) <= 3600')}")
def asof_nearest(spark, d):
    return _asof(spark, d, "nearest", 3600.0)


@query("asof_backward", f"{_SIDES} {_PICK.format(order='r.t DESC', on='r.t <= l.t AND l.t - r.t <= 3600')}")
def asof_backward(spark, d):
    return _asof(spark, d, "backward", 3600.0)


@query("asof_window_last", f"{_SIDES} SELECT l.event_id, max(r.t) AS last_t, arg_max(round(r.x, 2), r.t) AS x FROM l JOIN r ON l.game_id = r.game_id AND l.slot = r.slot AND r.t BETWEEN l.t - 1800 AND l.t + 1800 GROUP BY ALL")
def asof_window_last(spark, d):
    ev = samples(spark, d)
    left = ev.where("kind = 'error'").select("game_id", "slot", F.col("t").alias("ta"), "event_id")
    right = ev.where("kind = 'click'").select("game_id", "slot", F.col("t").alias("tb"), "x")
    return (J.within(left, right, ["game_id", "slot"], "ta", "tb", -1800.0, 1800.0).groupBy("event_id")
            .agg(F.max(F.struct("tb", "x")).alias("m")).select("event_id", F.col("m.tb").alias("last_t"), F.round("m.x", 2).alias("x")))


@query("point_in_interval", """, i AS (SELECT game_id, slot, t AS t0, lead(t) OVER (PARTITION BY game_id, slot ORDER BY t, event_id) AS t1 FROM ev WHERE kind = 'signup')
SELECT i.game_id, i.slot, round(t0, 3) AS t0, count(*) AS inside FROM i JOIN ev ON ev.game_id = i.game_id AND ev.slot = i.slot AND ev.t BETWEEN t0 AND t1 WHERE ev.kind = 'error' GROUP BY ALL""")
def point_in_interval(spark, d):
    ev = samples(spark, d)
    w = Window.partitionBy("game_id", "slot").orderBy("t", "event_id")
    spans = ev.where("kind = 'signup'").select("game_id", "slot", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"))
    found = J.points_in_intervals(ev.where("kind = 'error'").select("game_id", "slot", "t"), spans, ["game_id", "slot"], "t", "t0", "t1", 7200.0)
    return found.groupBy("game_id", "slot", F.round("t0", 3).alias("t0")).agg(F.count("*").alias("inside"))


_SPANS = """, a AS (SELECT game_id, slot, t AS a0, t + value * 10 AS a1 FROM ev WHERE kind = 'click'), b AS (SELECT game_id, slot, t AS b0, t + value * 10 AS b1, event_id FROM ev WHERE kind = 'view')"""


@query("interval_overlap_seconds", f"{_SPANS} SELECT a.game_id, a.slot, count(*) AS pairs, round(sum(least(a1, b1) - greatest(a0, b0)), 3) AS seconds FROM a JOIN b ON a.game_id = b.game_id AND a.slot = b.slot AND least(a1, b1) > greatest(a0, b0) GROUP BY ALL")
def interval_overlap_seconds(spark, d):
    ev = samples(spark, d)
    a = ev.where("kind = 'click'").select("game_id", "slot", F.col("t").alias("a0"), (F.col("t") + F.col("value") * 10).alias("a1"))
    b = ev.where("kind = 'view'").select("game_id", "slot", F.col("t").alias("b0"), (F.col("t") + F.col("value") * 10).alias("b1"))
    return J.overlaps(a, b, ["game_id", "slot"], 5000.0).groupBy("game_id", "slot").agg(F.count("*").alias("pairs"), F.round(F.sum("shared"), 3).alias("seconds"))


@query("longest_overlap_box", f"{_SPANS} SELECT game_id, slot, t0, box FROM (SELECT a.game_id, a.slot, round(a0, 3) AS t0, b.event_id AS box, row_number() OVER (PARTITION BY a.game_id, a.slot, a0 ORDER BY least(a1, b1) - greatest(a0, b0) DESC, b.event_id) AS nth FROM a JOIN b ON a.game_id = b.game_id AND a.slot = b.slot AND least(a1, b1) > greatest(a0, b0)) WHERE nth = 1")
def longest_overlap_box(spark, d):
    ev = samples(spark, d)
    a = ev.where("kind = 'click'").select("game_id", "slot", F.col("t").alias("a0"), (F.col("t") + F.col("value") * 10).alias("a1"))
    b = ev.where("kind = 'view'").select("game_id", "slot", F.col("t").alias("b0"), (F.col("t") + F.col("value") * 10).alias("b1"), "event_id")
    best = J.overlaps(a, b, ["game_id", "slot"], 5000.0).groupBy("game_id", "slot", "a0").agg(F.max(F.struct("shared", (-F.col("event_id")).alias("neg"))).alias("m"))
    return best.select("game_id", "slot", F.round("a0", 3).alias("t0"), (-F.col("m.neg")).alias("box"))


@query("overlap_exclusive_rule", """, s AS (SELECT game_id, team, slot, kind, t AS t0, t + value * 10 AS t1, event_id, CASE WHEN x < 0.3 THEN 0 WHEN x < 0.6 THEN 1 ELSE 2 END AS rank FROM ev WHERE kind IN ('click', 'purchase'))
SELECT p.event_id, bool_or(q.rank <= p.rank) AS cleared FROM s p JOIN s q ON p.game_id = q.game_id AND p.team = q.team AND p.kind = q.kind AND p.slot <> q.slot AND least(p.t1, q.t1) - greatest(p.t0, q.t0) > 1 GROUP BY ALL""")
def overlap_exclusive_rule(spark, d):
    rank = F.when(F.col("x") < 0.3, 0).when(F.col("x") < 0.6, 1).otherwise(2)
    spans = samples(spark, d).where("kind IN ('click', 'purchase')").select("game_id", "team", "kind", "slot", F.col("t").alias("a0"), (F.col("t") + F.col("value") * 10).alias("a1"), "event_id", rank.alias("rank"))
    other = spans.select("game_id", "team", "kind", F.col("slot").alias("slot_b"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("rank").alias("rank_b"))
    pairs = J.overlaps(spans, other, ["game_id", "team", "kind"], 5000.0).where("slot <> slot_b AND shared > 1")
    return pairs.groupBy("event_id").agg(F.bool_or(F.col("rank_b") <= F.col("rank")).alias("cleared"))


@query("mutual_pairs_band_join", f"""{_KILLS} SELECT p.event_id AS a, q.event_id AS b, round(q.t - p.t, 3) AS dt FROM kills p JOIN kills q ON p.game_id = q.game_id AND p.killer = q.victim AND p.victim = q.killer AND q.t - p.t BETWEEN 0 AND 1800 AND p.event_id <> q.event_id""")
def mutual_pairs_band_join(spark, d):
    kills = kills_of(samples(spark, d)).where("killer IS NOT NULL")
    a = kills.select("game_id", F.col("killer").alias("k1"), F.col("victim").alias("k2"), F.col("t").alias("ta"), F.col("event_id").alias("a"))
    b = kills.select("game_id", F.col("victim").alias("k1"), F.col("killer").alias("k2"), F.col("t").alias("tb"), F.col("event_id").alias("b"))
    return J.within(a, b, ["game_id", "k1", "k2"], "ta", "tb", 0.0, 1800.0).where("a <> b").select("a", "b", F.round(F.col("tb") - F.col("ta"), 3).alias("dt"))


@query("avenge_band_spatial_join", f"""{_KILLS} SELECT a, b, dt FROM (SELECT p.event_id AS a, q.event_id AS b, round(q.t - p.t, 3) AS dt, row_number() OVER (PARTITION BY q.event_id ORDER BY p.t DESC, p.event_id DESC) AS nth
FROM kills p JOIN kills q ON p.game_id = q.game_id AND p.killer = q.victim AND q.t - p.t BETWEEN 0 AND 3600 AND p.victim_team <> q.victim_team AND p.victim <> q.killer AND p.event_id <> q.event_id
 AND sqrt(pow((p.x - q.x) * 31.0, 2) + pow((p.y - q.y) * 16.5, 2)) <= 12) WHERE nth = 1""")
def avenge_band_spatial_join(spark, d):
    kills = kills_of(samples(spark, d)).where("killer IS NOT NULL")
    a = kills.select("game_id", F.col("killer").alias("target"), F.col("victim").alias("lost"), F.col("victim_team").alias("team_a"), F.col("t").alias("ta"), F.col("event_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = kills.select("game_id", F.col("victim").alias("target"), F.col("killer").alias("avenger"), F.col("victim_team").alias("team_b"), F.col("t").alias("tb"), F.col("event_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    near = F.sqrt(F.pow((F.col("xa") - F.col("xb")) * 31.0, F.lit(2)) + F.pow((F.col("ya") - F.col("yb")) * 16.5, F.lit(2))) <= 12
    pairs = J.within(a, b, ["game_id", "target"], "ta", "tb", 0.0, 3600.0).where((F.col("team_a") != F.col("team_b")) & (F.col("lost") != F.col("avenger")) & (F.col("a") != F.col("b")) & near)
    return pairs.groupBy("b", "tb").agg(F.max(F.struct("ta", "a")).alias("m")).select(F.col("m.a").alias("a"), "b", F.round(F.col("tb") - F.col("m.ta"), 3).alias("dt"))


@query("semi_anti_stale", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS stale FROM customer""")
def semi_anti_stale(spark, d):
    customers, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    keys = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("done"))
    return customers.join(keys, "c_custkey", "left").select("c_custkey", F.col("done").isNotNull().alias("has_orders"), (~F.coalesce("done", F.lit(False))).alias("stale"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_POINTS = "(VALUES ('north', 0.2, 0.2), ('south', 0.8, 0.8), ('mid', 0.5, 0.5), ('east', 0.8, 0.2), ('west', 0.2, 0.8))"


@query("nearest_dimension", f"""SELECT event_id, name FROM (WITH EVX AS (SELECT 1) SELECT event_id, p.name, sqrt(pow(x - p.px, 2) + pow(y - p.py, 2)) AS d, row_number() OVER (PARTITION BY event_id ORDER BY sqrt(pow(x - p.px, 2) + pow(y - p.py, 2)), p.name) AS nth
FROM (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 100 AS x, (floor(value * 100) % 100) / 100.0 AS y FROM events), {_POINTS} p(name, px, py)) WHERE nth = 1 AND d <= 0.12""")
def nearest_dimension(spark, d):
    # Five named points: a fixed dimension, held in the expression.
    points = {"north": (0.2, 0.2), "south": (0.8, 0.8), "mid": (0.5, 0.5), "east": (0.8, 0.2), "west": (0.2, 0.8)}
    far = F.array_min(F.array(*[F.struct(F.sqrt(F.pow(F.col("x") - px, F.lit(2)) + F.pow(F.col("y") - py, F.lit(2))).alias("d"), F.lit(n).alias("name")) for n, (px, py) in points.items()]))
    return samples(spark, d).select("event_id", far.alias("m")).where("m.d <= 0.12").select("event_id", "m.name")


@query("fuzzy_names", """SELECT p_brand AS brand, b.name, levenshtein(lower(p_brand), lower(b.name)) AS edits, count(*) AS n FROM part, (SELECT DISTINCT p_brand AS name FROM part) b
WHERE levenshtein(lower(p_brand), lower(b.name)) <= greatest(1, CAST(round_even(0.2 * greatest(length(p_brand), length(b.name)), 0) AS INT)) GROUP BY ALL""")
def fuzzy_names(spark, d):
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    lower = brands.select("brand", "n", F.lower("brand").alias("a"))
    pairs = alike_pairs(lower, "a").join(lower, "a").join(lower.select(F.col("brand").alias("name"), F.col("a").alias("b")), "b")
    edits = F.levenshtein("a", "b")
    return pairs.where(edits <= F.greatest(F.lit(1), F.bround(0.2 * F.greatest(F.length("a"), F.length("b"))).cast("int"))).select("brand", "name", edits.alias("edits"), "n")


@query("similar_prefix_names", "SELECT count(*) AS pairs FROM (SELECT DISTINCT p_type AS a FROM part) x, (SELECT DISTINCT p_type AS b FROM part) y WHERE a < b AND ((least(length(a), length(b)) >= 6 AND levenshtein(left(a, least(length(a), length(b))), left(b, least(length(a), length(b)))) <= 1) OR levenshtein(a, b) <= greatest(1, CAST(round_even(0.2 * greatest(length(a), length(b)), 0) AS INT)))")
def similar_prefix_names(spark, d):
    return alike_pairs(table(spark, d, "part"), "p_type").where("a < b").where(similar(F.col("a"), F.col("b"))).agg(F.count("*").alias("pairs"))


@query("json_extract_or_null", """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events""")
def json_extract_or_null(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("import_identity_match", """SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= 500 AND abs(datediff('day', a.o_orderdate, b.o_orderdate)) <= 60""")
def import_identity_match(spark, d):
    orders = table(spark, d, "orders")
    a = orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("pa"), F.col("o_orderdate").alias("da"))
    b = orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("pb"), F.col("o_orderdate").alias("db"))
    pairs = J.within(a, b, ["o_custkey"], "pa", "pb", -500.0, 500.0)
    return pairs.where((F.col("a") < F.col("b")) & (F.abs(F.datediff("da", "db")) <= 60)).select("a", "b")
