"""Lives, waves, fights, greedy trades and visibility: order-dependent rules by game."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matchlake.operators import series as S
from matchlake.operators import stateful
from matchlake.plans.registry import query
from matchlake.plans.statistics import _KILLS, kills_of
from matchlake.sources.match_view import samples

HOUR = 3600.0


_LIVES = f"""{_KILLS}, al AS (SELECT game_id, slot, t, CASE WHEN t - lag(t) OVER (PARTITION BY game_id, slot ORDER BY t) <= 3600 THEN 0 ELSE 1 END AS s FROM ev WHERE alive),
  rn AS (SELECT game_id, slot, run, min(t) AS a, max(t) AS b FROM (SELECT *, sum(s) OVER (PARTITION BY game_id, slot ORDER BY t) AS run FROM al) GROUP BY ALL),
  ends AS (SELECT game_id, slot, max(t) AS last FROM ev GROUP BY ALL), dead AS (SELECT game_id, victim AS slot, list(t ORDER BY t) AS ks FROM kills GROUP BY ALL),
  r AS (SELECT rn.*, row_number() OVER w AS i, lead(a) OVER w AS nxt, last, coalesce(ks, []) AS ks FROM rn JOIN ends USING (game_id, slot) LEFT JOIN dead USING (game_id, slot) WINDOW w AS (PARTITION BY rn.game_id, rn.slot ORDER BY a)),
  walk AS (SELECT DISTINCT game_id, slot, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS start, CAST(-1e9 AS DOUBLE) AS died, CAST([] AS BIGINT[]) AS used, CAST(NULL AS DOUBLE) AS t0, CAST(NULL AS DOUBLE) AS t1, CAST(NULL AS VARCHAR) AS ended FROM r
    UNION ALL SELECT game_id, slot, i, CASE WHEN skip THEN NULL WHEN gone THEN NULL ELSE s0 END, CASE WHEN gone AND NOT skip THEN b ELSE died END, CASE WHEN hit IS NOT NULL AND NOT skip THEN list_append(used, hit) ELSE used END,
      CASE WHEN NOT skip AND (gone OR nxt IS NULL) THEN s0 END, CASE WHEN NOT skip AND (gone OR nxt IS NULL) THEN b END, CASE WHEN skip THEN NULL WHEN gone THEN 'death' WHEN nxt IS NULL THEN 'end' END
    FROM (SELECT *, hit IS NOT NULL OR coalesce(nxt - b >= 1800, last - b > 900) AS gone FROM
      (SELECT r.*, walk.died, walk.used, walk.start IS NULL AND r.a - walk.died < 1800 AS skip, coalesce(walk.start, r.a) AS s0,
        list_sort(list_filter(list_transform(range(1, len(r.ks) + 1), lambda j: {{'d': abs(r.ks[j] - r.b), 'j': j}}), lambda z: z.d <= 600 AND NOT list_contains(walk.used, z.j)))[1].j AS hit
       FROM walk JOIN r ON r.game_id = walk.game_id AND r.slot = walk.slot AND r.i = walk.i + 1)))
SELECT game_id, slot, CAST(row_number() OVER (PARTITION BY game_id, slot ORDER BY i) - 1 AS INT) AS idx, t0, t1, ended FROM walk WHERE ended IS NOT NULL"""


@query("lives", _LIVES)
def lives(spark, d):
    ev = samples(spark, d).select("game_id", "slot", "t", "alive")
    kills = kills_of(samples(spark, d)).select("game_id", F.col("victim").alias("slot"), "t")
    schema = "game_id int, slot int, idx int, t0 double, t1 double, ended string"

    def of(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return stateful.lives(rows, own, gap=HOUR, respawn=HOUR / 2, tail=HOUR / 4, near=HOUR / 6) if len(rows) else stateful.lives(rows.assign(alive=False))

    return ev.groupBy("game_id", "slot").cogroup(kills.groupBy("game_id", "slot")).applyInPandas(of, schema)


@query("waves_anchored", """, x AS (SELECT game_id, team, slot, t, row_number() OVER (PARTITION BY game_id, team ORDER BY t, slot) AS i FROM ev WHERE kind = 'signup'),
  f AS (SELECT a.game_id, a.team, a.i, a.t AS t0, max(b.t) AS t1, max(b.i) AS last, count(DISTINCT b.slot) AS players FROM x a JOIN x b ON b.game_id = a.game_id AND b.team = a.team AND b.i >= a.i AND b.t <= a.t + 600 GROUP BY ALL),
  walk AS (SELECT DISTINCT game_id, team, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS wave FROM x
    UNION ALL SELECT f.game_id, f.team, CASE WHEN players >= 2 THEN last + 1 ELSE f.i + 1 END, wave + CASE WHEN players >= 2 THEN 1 ELSE 0 END FROM walk JOIN f ON f.game_id = walk.game_id AND f.team = walk.team AND f.i = walk.i)
SELECT game_id, team, CAST(wave AS INT) AS wave, t0, t1, CAST(players AS INT) AS players FROM walk JOIN f USING (game_id, team, i) WHERE players >= 2""")
def waves_anchored(spark, d):
    exits = samples(spark, d).where("kind = 'signup'").select("game_id", "team", "slot", "t")
    return exits.groupBy("game_id", "team").applyInPandas(lambda rows: stateful.anchored_waves(rows, span=600.0), "game_id int, team string, wave int, t0 double, t1 double, players int")


@query("lane_packing", """, o AS (SELECT game_id, event_id, t AS t0, t + value * 10 AS t1, row_number() OVER (PARTITION BY game_id ORDER BY t, t + value * 10, event_id) AS i FROM ev WHERE kind = 'click'),
  walk AS (SELECT game_id, i, [t1] AS ends, CAST(0 AS BIGINT) AS lane FROM o WHERE i = 1
    UNION ALL SELECT game_id, i, list_concat(ends[1:free], [t1], ends[free + 2:]), free FROM
      (SELECT o.*, walk.ends, coalesce(nullif(list_position(list_transform(walk.ends, lambda e: e <= o.t0), true), 0), len(walk.ends) + 1) - 1 AS free FROM walk JOIN o ON o.game_id = walk.game_id AND o.i = walk.i + 1))
SELECT game_id, event_id, t0, t1, CAST(lane AS INT) AS lane FROM walk JOIN o USING (game_id, i)""")
def lane_packing(spark, d):
    spans = samples(spark, d).where("kind = 'click'").select("game_id", "event_id", F.col("t").alias("t0"), (F.col("t") + F.col("value") * 10).alias("t1"))
    return spans.groupBy("game_id").applyInPandas(stateful.lanes, "game_id int, event_id long, t0 double, t1 double, lane int")


@query("fights_foci", f"""{_KILLS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY game_id ORDER BY t, event_id) <= 600 THEN 0 ELSE 1 END AS s FROM kills),
  k AS (SELECT *, row_number() OVER (PARTITION BY game_id, run ORDER BY t, event_id) AS i FROM (SELECT *, sum(s) OVER (PARTITION BY game_id ORDER BY t, event_id) AS run FROM g)),
  walk AS (SELECT game_id, run, i, victim_team, CAST(0 AS BIGINT) AS focus, [{{'x': x, 'y': y, 'f': CAST(0 AS BIGINT)}}] AS seen FROM k WHERE i = 1
    UNION ALL SELECT game_id, run, i, victim_team, focus, list_append(seen, {{'x': x, 'y': y, 'f': focus}}) FROM
      (SELECT k.*, walk.seen, coalesce(list_min(list_transform(list_filter(walk.seen, lambda m: sqrt(pow((k.x - m.x) * 31.0, 2) + pow((k.y - m.y) * 16.5, 2)) <= 10), lambda m: m.f)), list_max(list_transform(walk.seen, lambda m: m.f)) + 1) AS focus
       FROM walk JOIN k ON k.game_id = walk.game_id AND k.run = walk.run AND k.i = walk.i + 1))
SELECT game_id, CAST(run AS BIGINT) AS run, count(*) AS kills, count(DISTINCT focus) AS foci, count(*) FILTER (victim_team = 'A') AS lost_a, count(*) FILTER (victim_team = 'B') AS lost_b,
  CASE WHEN count(*) FILTER (victim_team = 'A') < count(*) FILTER (victim_team = 'B') THEN 'A' WHEN count(*) FILTER (victim_team = 'B') < count(*) FILTER (victim_team = 'A') THEN 'B' END AS winner
FROM walk GROUP BY game_id, run HAVING count(*) >= 2""")
def fights_foci(spark, d):
    series = S.sessions(kills_of(samples(spark, d)), ["game_id"], ["t", "event_id"], 600.0).select("game_id", "run", "t", "event_id", "victim_team", "x", "y")
    placed = series.groupBy("game_id", "run").applyInPandas(lambda rows: stateful.foci(rows), "game_id int, run long, t double, event_id long, victim_team string, x double, y double, focus int")
    fights = placed.groupBy("game_id", "run").agg(F.count("*").alias("kills"), F.count_distinct("focus").alias("foci"), F.count_if(F.col("victim_team") == "A").alias("lost_a"), F.count_if(F.col("victim_team") == "B").alias("lost_b"))
    return fights.where("kills >= 2").withColumn("winner", F.when(F.col("lost_a") < F.col("lost_b"), "A").when(F.col("lost_b") < F.col("lost_a"), "B"))


@query("trades_greedy", f"""{_KILLS}, p AS (SELECT x.game_id, x.event_id AS a, z.event_id AS b, z.t - x.t AS dt FROM kills x JOIN kills z ON z.game_id = x.game_id AND z.victim = x.killer AND z.killer = x.victim AND z.event_id <> x.event_id AND z.t - x.t BETWEEN 0 AND 3600),
  o AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY dt, a, b) AS i FROM p),
  walk AS (SELECT DISTINCT game_id, CAST(0 AS BIGINT) AS i, false AS keep, CAST([] AS BIGINT[]) AS used FROM o
    UNION ALL SELECT game_id, i, free, CASE WHEN free THEN list_concat(used, [a, b]) ELSE used END FROM
      (SELECT o.*, walk.used, NOT list_contains(walk.used, o.a) AND NOT list_contains(walk.used, o.b) AS free FROM walk JOIN o ON o.game_id = walk.game_id AND o.i = walk.i + 1))
SELECT game_id, a, b, dt FROM walk JOIN o USING (game_id, i) WHERE keep""")
def trades_greedy(spark, d):
    kills = kills_of(samples(spark, d)).where("killer IS NOT NULL").select("game_id", F.col("event_id").alias("id"), "t", "killer", "victim").distinct()
    pairs = kills.groupBy("game_id").applyInPandas(lambda rows: stateful.mutual_pairs(rows, HOUR), "game_id int, p int, q int, ta double, a long, tb double, b long, dt double")
    return pairs.select("game_id", "a", "b", "dt")


@query("visibility_counts")
def visibility_counts(spark, d):
    """How many alive rows of a team see each cell of an 8 * 8 map with a wall; positions are taken by cell of 32."""
    n = 8
    wall = np.zeros((n, n), bool)
    wall[4, 1:7] = True
    spots = (samples(spark, d).where("alive").groupBy("team", F.floor(F.col("x") * 32).alias("px"), F.floor(F.col("y") * 32).alias("py")).agg(F.count("*").alias("rows")))

    def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for team, px, py, rows in batch.itertuples(index=False):
                seen = stateful.visible(min(0.999, (px + 0.5) / 32), min(0.999, (py + 0.5) / 32), wall)
                out += [(team, int(i), int(j), int(rows)) for i, j in np.argwhere(seen)]
            yield pd.DataFrame(out, columns=["team", "ix", "iy", "rows"])

    return spots.mapInPandas(see, "team string, ix int, iy int, rows long").groupBy("team", "ix", "iy").agg(F.sum("rows").alias("seen"))
