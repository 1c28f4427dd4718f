"""Presence and heat-map queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from matchlake.functions.geometry import cell
from matchlake.operators import grids
from matchlake.operators.aggregates import upper_median
from matchlake.plans.registry import query
from matchlake.sources.match_view import samples

N = 16


def frame_steps(ev: DataFrame) -> DataFrame:
    """game_id, step: upper median of the positive gaps between distinct times of a game."""
    times = ev.select("game_id", "t").distinct()
    gaps = times.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("game_id").orderBy("t"))).where("gap > 0")
    return upper_median(gaps, ["game_id"], "gap", "step")


def cell_counts(ev: DataFrame, n: int = N) -> DataFrame:
    return ev.select("*", cell(F.col("x"), n).alias("ix"), cell(F.col("y"), n).alias("iy"))


_STEP = """, gaps AS (SELECT game_id, t - lag(t) OVER (PARTITION BY game_id ORDER BY t) AS gap FROM (SELECT DISTINCT game_id, t FROM ev)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY gap) - 1 AS nth, count(*) OVER (PARTITION BY game_id) AS n FROM gaps WHERE gap > 0),
  steps AS (SELECT game_id, gap AS step FROM ranked WHERE nth = n // 2)"""
_CELLS = f""", cells AS (SELECT *, CAST(greatest(0, least({N - 1}, trunc(x * {N}))) AS INT) AS ix, CAST(greatest(0, least({N - 1}, trunc(y * {N}))) AS INT) AS iy FROM ev)"""


@query("presence_grid", f"""{_STEP}{_CELLS}
SELECT ix, iy, round(sum(step), 3) AS seconds, count(DISTINCT game_id) AS games FROM cells JOIN steps USING (game_id) WHERE alive GROUP BY ix, iy""")
def presence_grid(spark, d):
    ev = samples(spark, d)
    return (cell_counts(ev).where("alive").join(frame_steps(ev), "game_id").groupBy("ix", "iy")
            .agg(F.round(F.sum("step"), 3).alias("seconds"), F.count_distinct("game_id").alias("games")))


@query("frame_step_upper_median", f"{_STEP} SELECT game_id, round(step, 6) AS step FROM steps")
def frame_step_upper_median(spark, d):
    return frame_steps(samples(spark, d)).select("game_id", F.round("step", 6).alias("step"))


@query("death_heat_by_team", f"{_CELLS} SELECT team, ix, iy, count(*) AS deaths FROM cells WHERE NOT alive GROUP BY ALL")
def death_heat_by_team(spark, d):
    return cell_counts(samples(spark, d)).where("NOT alive").groupBy("team", "ix", "iy").agg(F.count("*").alias("deaths"))


_SPARSE = f"{_CELLS}, g AS (SELECT ix, iy, CAST(count(*) AS DOUBLE) AS v FROM cells WHERE alive GROUP BY ALL)"


def _grid(ev: DataFrame, where: str) -> DataFrame:
    return cell_counts(ev).where(where).groupBy("ix", "iy").agg(F.count("*").cast("double").alias("v"))


@query("grid_gaussian_blur", f"""{_SPARSE}, taps AS (SELECT d, exp(-d * d / (2 * 1.5 * 1.5)) AS w FROM (SELECT unnest(range(-5, 6)) AS d)),
  mass AS (SELECT i, sum(w) AS m FROM (SELECT unnest(range(0, {N})) AS i) JOIN taps ON i + d BETWEEN 0 AND {N - 1} GROUP BY i),
  h AS (SELECT ix + d AS ix, iy, sum(v * w) AS v FROM g, taps WHERE ix + d BETWEEN 0 AND {N - 1} GROUP BY ALL),
  hn AS (SELECT ix, iy, v / m AS v FROM h JOIN mass ON i = ix),
  b AS (SELECT ix, iy + d AS iy, sum(v * w) AS v FROM hn, taps WHERE iy + d BETWEEN 0 AND {N - 1} GROUP BY ALL)
SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(v / m, 6) AS v FROM b JOIN mass ON i = iy""")
def grid_gaussian_blur(spark, d):
    return grids.blur(_grid(samples(spark, d), "alive"), N, 1.5).select("ix", "iy", F.round("v", 6).alias("v"))


_TOP = "top AS (SELECT v AS top FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS nth, count(*) OVER () AS n FROM {0} WHERE v > 0) WHERE nth = least(n - 1, CAST(floor(n * 0.98) AS BIGINT)))"


@query("grid_norm_p98", f"{_SPARSE}, {_TOP.format('g')} SELECT ix, iy, round(least(1.0, v / top), 6) AS v FROM g, top WHERE v > 0")
def grid_norm_p98(spark, d):
    return grids.scale_by_p98(_grid(samples(spark, d), "alive")).select("ix", "iy", F.round("v", 6).alias("v"))


@query("grid_diff_masked", f"""{_CELLS}, s AS (SELECT ix, iy, CAST(count(*) FILTER (team = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (team = 'B') AS DOUBLE) AS b FROM cells WHERE NOT alive GROUP BY ALL),
  sv AS (SELECT *, a + b AS v FROM s), {_TOP.format('sv')}, shown AS (SELECT ix, iy, a - b AS d FROM sv, top WHERE v >= top * 0.10)
SELECT ix, iy, d, round(coalesce(d / nullif((SELECT max(abs(d)) FROM shown), 0), 0), 6) AS signed FROM shown""")
def grid_diff_masked(spark, d):
    ev = samples(spark, d)
    return grids.masked_difference(_grid(ev, "NOT alive AND team = 'A'"), _grid(ev, "NOT alive AND team = 'B'")).select("ix", "iy", "d", F.round("signed", 6).alias("signed"))


@query("grid_merge", f"{_CELLS} SELECT ix, iy, CAST(count(*) AS DOUBLE) AS v FROM cells WHERE kind IN ('click', 'view') GROUP BY ALL")
def grid_merge(spark, d):
    ev = samples(spark, d)
    return grids.merge(_grid(ev, "kind = 'click'"), _grid(ev, "kind = 'view'"))


@query("grid_dense", f"""{_SPARSE} SELECT CAST(a.i AS INT) AS ix, CAST(b.i AS INT) AS iy, coalesce(v, 0) AS v
FROM (SELECT unnest(range(0, {N})) AS i) a, (SELECT unnest(range(0, {N})) AS i) b LEFT JOIN g ON g.ix = a.i AND g.iy = b.i""")
def grid_dense(spark, d):
    return grids.dense(_grid(samples(spark, d), "alive"), N)


@query("reliability_vs_global", f"""{_CELLS}, c AS (SELECT ix, iy, count(*) AS n, avg(CASE WHEN alive THEN 0.0 ELSE 1.0 END) AS rate FROM cells GROUP BY ALL)
SELECT ix, iy, n, round(rate, 6) AS rate, rate > 1.25 * (SELECT avg(CASE WHEN alive THEN 0.0 ELSE 1.0 END) FROM ev) AS unreliable FROM c WHERE n >= 20""")
def reliability_vs_global(spark, d):
    ev = samples(spark, d)
    bad = F.avg(F.when(F.col("alive"), 0.0).otherwise(1.0))
    cells = cell_counts(ev).groupBy("ix", "iy").agg(F.count("*").alias("n"), bad.alias("rate")).where("n >= 20")
    return cells.crossJoin(F.broadcast(ev.agg(bad.alias("all")))).select("ix", "iy", "n", F.round("rate", 6).alias("rate"), (F.col("rate") > 1.25 * F.col("all")).alias("unreliable"))
