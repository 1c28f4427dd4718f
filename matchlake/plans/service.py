"""The service's read queries over the match view: every game or map of it, and the SQL that states the same rows.

Games are days; maps, team names, players and episodes follow from their numbers, with names that differ by case, accent
and spaces for one team, and malformed data among the episodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.plans import routes
from matchlake.plans.combats import _MATCH, active_points, match_frames
from matchlake.plans.registry import query

MAPS = ("Map 0", "Map 1", "Map 2", "Map 3")
OUTCOMES = ("success", "fail", "won_no_capture", "no_contact", "duel")


def _picked(number: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def service_tables(spark, d: str) -> dict[str, DataFrame]:
    """The tables of the service that the match view can give."""
    f = match_frames(spark, d)
    ev = f["ev"]
    games = f["games"].select(F.col("game_id").alias("id"), _picked(F.col("game_id"), MAPS).alias("map"), _picked(F.col("game_id"), ("Alpha Team", "ALPHA  team ", "Beta")).alias("team_a"),
                              _picked(F.col("game_id"), ("Équipe Éclair", "equipe  eclair")).alias("team_b"))
    made = f["kills"].groupBy("game_id", F.col("killer_slot").alias("slot")).agg(F.count("*").alias("kills"))
    seen = ev.groupBy("game_id", "slot").agg(F.count_if(~F.col("alive")).alias("deaths"), F.count_if("alive").alias("rows"), (F.avg("t") / 86_400).alias("v"))
    stats = seen.join(made, ["game_id", "slot"], "left")
    stats = stats.select("game_id", "slot", F.coalesce("kills", F.lit(0)).alias("kills"), "deaths", F.when(F.col("slot") % 4 != 3, F.col("rows") * 10.0).alias("alive_s"), (F.col("rows") * 2.0).alias("dist_m"), F.col("v").alias("v_mean"),
                         F.when(F.col("deaths") > 0, F.col("rows") % 5).alias("gadget_uses"), (F.col("rows") % 7).alias("gadget_possible"))
    players = stats.select("game_id", "slot", F.concat(F.when(F.col("game_id") % 2 == 0, "Núm").otherwise("NUM"), "slot").alias("name"))
    clicks = ev.where("kind = 'click'")
    data = F.when(F.col("event_id") % 7 == 0, "{broken").when(F.col("event_id") % 11 == 0, '{"wave":null}').otherwise(F.concat(F.lit('{"wave":{"speed":"fast","size":'), (F.col("event_id") % 3 + 2).cast("string"), F.lit("}}")))
    episodes = clicks.select(F.col("event_id").alias("id"), "game_id", "team", F.lit("retake").alias("kind"), F.col("t").alias("t0"), _picked(F.col("event_id"), OUTCOMES).alias("outcome"), F.when(F.col("event_id") % 9 == 0, "ko").alias("verdict"), data.alias("data"))
    scores = ev.where("kind = 'purchase'").select("game_id", "t", F.concat(F.lit("score_"), "team").alias("point"), F.floor("value").cast("double").alias("pct"))
    lives = f["lives"].join(f["kills"].select("game_id", F.col("victim_slot").alias("slot"), F.col("t").alias("t1"), "killer_slot"), ["game_id", "slot", "t1"], "left")
    return {"games": games, "samples": f["samples"], "players": players, "player_game_stats": stats, "episodes": episodes, "capture_state": scores, "lives": lives, "point_active": active_points(f)}


_TABLES = f"""{_MATCH},
  g AS (SELECT DISTINCT game_id, 'Map ' || (game_id % 4) AS map, CASE WHEN game_id % 3 = 2 THEN 'beta' ELSE 'alpha team' END AS key_a, ['Alpha Team', 'ALPHA  team ', 'Beta'][game_id % 3 + 1] AS team_a, 'equipe eclair' AS key_b, ['Équipe Éclair', 'equipe  eclair'][game_id % 2 + 1] AS team_b FROM ev),
  sd AS (SELECT game_id, map, 'A' AS team, key_a AS key, team_a AS name FROM g UNION ALL SELECT game_id, map, 'B', key_b, team_b FROM g),
  mk AS (SELECT game_id, killer AS slot, count(*) AS kills FROM kills WHERE killer IS NOT NULL GROUP BY ALL),
  s0 AS (SELECT game_id, slot, count(*) FILTER (NOT alive) AS deaths, count(*) FILTER (alive) AS rows, avg(t) / 86400 AS v_mean FROM ev GROUP BY ALL),
  st AS (SELECT s0.*, coalesce(kills, 0) AS kills, CASE WHEN slot % 4 <> 3 THEN rows * 10.0 END AS alive_s, rows * 2.0 AS dist_m, CASE WHEN deaths > 0 THEN rows % 5 END AS gadget_uses, rows % 7 AS gadget_possible, CASE WHEN slot <= 4 THEN 'A' ELSE 'B' END AS team FROM s0 LEFT JOIN mk USING (game_id, slot)),
  ep AS (SELECT event_id, game_id, team, ['success', 'fail', 'won_no_capture', 'no_contact', 'duel'][event_id % 5 + 1] AS outcome FROM ev WHERE kind = 'click' AND event_id % 9 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0)"""


def _tally(source: str, keys: str) -> str:
    """Waves, outcomes as text, decided ones and the success rate, by keys of a table with outcome."""
    return f"""SELECT {keys}, CAST(sum(n) AS BIGINT) AS waves, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes, CAST(coalesce(sum(n) FILTER (outcome IN ('success', 'fail', 'won_no_capture')), 0) AS BIGINT) AS decided,
  round(coalesce(sum(n) FILTER (outcome = 'success'), 0) / nullif(sum(n) FILTER (outcome IN ('success', 'fail', 'won_no_capture')), 0), 3) AS rate FROM (SELECT {keys}, outcome, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {keys}"""


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("outcomes", F.array_join(F.transform(F.array_sort(F.map_entries("outcomes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


def _by_map(read) -> DataFrame:
    """A route's rows for each map, with the map."""
    found = None
    for name in MAPS:
        rows = read(name).withColumn("map", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("route_presence", f"""{_TABLES}, tt AS (SELECT DISTINCT game_id, t FROM ev), gp AS (SELECT game_id, t - lag(t) OVER (PARTITION BY game_id ORDER BY t) AS gap FROM tt),
  rk AS (SELECT game_id, gap, row_number() OVER (PARTITION BY game_id ORDER BY gap) AS nth, count(*) OVER (PARTITION BY game_id) AS n FROM gp WHERE gap > 0), step AS (SELECT game_id, gap AS step FROM rk WHERE nth = n // 2 + 1)
SELECT map, greatest(0, least(31, CAST(floor(x * 32) AS INT))) AS ix, greatest(0, least(31, CAST(floor(y * 32) AS INT))) AS iy, round(sum(step), 3) AS seconds FROM ev JOIN step USING (game_id) JOIN g USING (game_id) WHERE alive GROUP BY ALL""")
def route_presence(spark, d):
    """Seconds by cell of each map."""
    tables = service_tables(spark, d)
    return _by_map(lambda name: routes.presence(tables, name))


@query("route_team_summary", f"""{_TABLES}, tot AS (SELECT map, key, count(DISTINCT game_id) AS games, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, CASE WHEN count(*) = count(gu) THEN CAST(sum(gu) AS BIGINT) END AS gadget_uses
    FROM sd LEFT JOIN (SELECT game_id, team, sum(kills) AS kills, sum(deaths) AS deaths, CASE WHEN count(*) = count(gadget_uses) THEN sum(gadget_uses) END AS gu FROM st GROUP BY ALL) USING (game_id, team) GROUP BY ALL),
  nm AS (SELECT map, key, arg_min(name, (-n, first)) AS name FROM (SELECT map, key, name, count(*) AS n, min(game_id) AS first FROM sd GROUP BY ALL) GROUP BY ALL),
  ev2 AS (SELECT map, key, outcome FROM ep JOIN sd USING (game_id, team)), wt AS ({_tally('ev2', 'map, key')})
SELECT map, key, games, kills, deaths, gadget_uses, name, waves, outcomes, decided, rate, round(kills / nullif(deaths, 0), 3) AS kd FROM tot JOIN nm USING (map, key) LEFT JOIN wt USING (map, key)""")
def route_team_summary(spark, d):
    """Games, totals and waves of the teams of each map."""
    tables = service_tables(spark, d)
    return _by_map(lambda name: _listed(routes.team_summary(tables, name)))


@query("route_players_summary", f"""{_TABLES}, pl AS (SELECT st.*, CASE WHEN game_id % 2 = 0 THEN 'Núm' ELSE 'NUM' END || slot AS name FROM st),
  nm AS (SELECT slot, arg_min(name, (-n, first)) AS name FROM (SELECT slot, name, count(*) AS n, min(game_id * 10 + slot) AS first FROM pl GROUP BY ALL) GROUP BY ALL)
SELECT name, count(DISTINCT game_id) AS games, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, sum(dist_m) AS dist_m, round(sum(v_mean * alive_s) FILTER (alive_s > 0) / sum(alive_s) FILTER (alive_s > 0), 3) AS v_mean, median(kills) AS median_kills, round(sum(kills) / nullif(sum(deaths), 0), 3) AS kd
FROM st JOIN nm USING (slot) GROUP BY slot, name""")
def route_players_summary(spark, d):
    """Games, totals and medians of each player, by folded identity."""
    return routes.players_summary(service_tables(spark, d)).drop("identity")


@query("route_teams_summary", f"""{_TABLES}, cs AS (SELECT game_id, team, CAST(floor(value) AS DOUBLE) AS pct, row_number() OVER (PARTITION BY game_id, team ORDER BY t DESC, floor(value) DESC) AS nth FROM ev WHERE kind = 'purchase'),
  nm AS (SELECT key, arg_min(name, (-n, first)) AS name FROM (SELECT key, name, count(*) AS n, min(game_id) AS first FROM sd GROUP BY ALL) GROUP BY ALL),
  tot AS (SELECT key, count(DISTINCT game_id) AS games, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, round(avg(pct), 2) AS capture FROM sd LEFT JOIN (SELECT game_id, team, sum(kills) AS kills, sum(deaths) AS deaths FROM st GROUP BY ALL) USING (game_id, team)
    LEFT JOIN (SELECT * FROM cs WHERE nth = 1) USING (game_id, team) GROUP BY ALL)
SELECT key, games, kills, deaths, capture, name, round(kills / nullif(deaths, 0), 3) AS kd FROM tot JOIN nm USING (key)""")
def route_teams_summary(spark, d):
    """Games, totals and mean capture of each team, by folded name."""
    return routes.teams_summary(service_tables(spark, d))


@query("route_game_summary", f"""{_TABLES}, wt AS ({_tally('ep', 'game_id, team')}),
  ac AS (SELECT game_id, CASE WHEN round(arg_min(x, t) * 100) % 2 = 0 THEN 'P' ELSE 'Q' END AS point, floor(t / 21600) AS b FROM ev WHERE kind = 'signup' GROUP BY game_id, floor(t / 21600)),
  ch AS (SELECT game_id, count(*) FILTER (point <> before) AS changes FROM (SELECT *, lag(point) OVER (PARTITION BY game_id ORDER BY b) AS before FROM ac) GROUP BY ALL)
SELECT game_id, team, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, CASE WHEN count(*) = count(alive_s) THEN sum(alive_s) END AS alive_s, CASE WHEN count(*) = count(dist_m) THEN sum(dist_m) END AS dist_m, round(sum(v_mean * alive_s) FILTER (alive_s > 0) / sum(alive_s) FILTER (alive_s > 0), 3) AS v_mean,
  CASE WHEN count(*) = count(gadget_possible) THEN CAST(sum(gadget_possible) AS BIGINT) END AS gadget_possible, CAST(sum(gadget_uses) AS BIGINT) AS gadget_uses, any_value(waves) AS waves, any_value(outcomes) AS outcomes, any_value(decided) AS decided, any_value(rate) AS rate, any_value(changes) AS changes
FROM st LEFT JOIN wt USING (game_id, team) LEFT JOIN ch USING (game_id) GROUP BY game_id, team""")
def route_game_summary(spark, d):
    """Totals, waves and changes of the active point of both teams of every game."""
    return _listed(routes.game_summary(service_tables(spark, d)))


@query("route_global_summary", f"""{_TABLES}, dd AS (SELECT l.game_id, l.slot, k.ks, greatest(0, least(31, CAST(floor(l.x1 * 32) AS INT))) AS ix, greatest(0, least(31, CAST(floor(l.y1 * 32) AS INT))) AS iy FROM lives l LEFT JOIN k0 k ON k.game_id = l.game_id AND k.vs = l.slot AND k.t = l.t1 WHERE l.died),
  both_sides AS (SELECT game_id, 'death' AS what, slot, ix, iy FROM dd UNION ALL SELECT game_id, 'kill', ks, ix, iy FROM dd WHERE (ks <= 4) <> (slot <= 4))
SELECT map, what, CASE WHEN slot <= 4 THEN 'A' ELSE 'B' END AS team, ix, iy, count(*) AS n FROM both_sides JOIN g USING (game_id) GROUP BY ALL""")
def route_global_summary(spark, d):
    """Deaths and kills by side and cell of each map."""
    tables = service_tables(spark, d)
    return _by_map(lambda name: routes.global_summary(tables, name))
