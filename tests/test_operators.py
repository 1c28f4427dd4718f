"""Edge cases of the series, join, grid and order-dependent operators."""

import bisect
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlake.functions.geometry import cell, note
from matchlake.functions.text import clock, name_key, parse_clock, player_identity
from matchlake.operators import aggregates as A
from matchlake.operators import grids, stateful
from matchlake.operators import joins as J
from matchlake.operators import series as S


def test_asof_matches_bisect_with_ties(spark):
    rng = random.Random(1)
    right = sorted((rng.randrange(40), i) for i in range(60))
    left = [(rng.randrange(-3, 45), i) for i in range(80)]
    r = spark.createDataFrame([(1, float(t), i) for t, i in right], "k int, t double, v int").withColumn("__tie", F.col("v"))
    l = spark.createDataFrame([(1, float(t), i) for t, i in left], "k int, t double, id int")
    found = {x["id"]: x["found_t"] for x in J.asof(l, r, ["k"], "t", ["v"], 2.0, "nearest").collect()}
    times = [t for t, _ in right]
    for t, i in left:
        at = bisect.bisect_left(times, t)
        near = [(abs(times[j] - t), times[j]) for j in (at - 1, at) if 0 <= j < len(times)]
        best = min(near)
        assert found[i] == (best[1] if best[0] <= 2 else None)


def test_sessions_gap_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 20.5)], "k int, t double")
    assert [r["run"] for r in S.sessions(df, ["k"], ["t"], 10.0).orderBy("t").collect()] == [1, 1, 2]


def test_runs_treat_null_as_a_label(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, 1.0, None), (1, 2.0, "a")], "k int, t double, l string")
    assert S.label_runs(df, ["k"], ["t"], "l").count() == 2


def test_intervals_meet_once_across_buckets(spark):
    a = spark.createDataFrame([(1, 0.0, 100.0)], "k int, a0 double, a1 double")
    b = spark.createDataFrame([(1, 5.0, 95.0), (1, 100.0, 110.0)], "k int, b0 double, b1 double")
    assert [r["shared"] for r in J.overlaps(a, b, ["k"], 7.0).collect()] == [90.0]
    points = spark.createDataFrame([(1, 0.0), (1, 100.0), (1, 100.1)], "k int, t double")
    assert J.points_in_intervals(points, a, ["k"], "t", "a0", "a1", 7.0).count() == 2


def test_strict_sum_and_ratio(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(A.strict_sum(F.col("v")).alias("s")).collect()}
    assert got == {"a": None, "b": 2}
    assert spark.range(1).select(A.ratio(F.lit(1), F.lit(0)).alias("r")).first()["r"] is None


def test_upper_median_of_even_count(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    assert A.upper_median(df, ["k"], "v", "m").first()["m"] == 3.0


def test_blur_keeps_flat_grids_and_identity(spark):
    n = 6
    flat = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in range(n)], "ix int, iy int, v double")
    assert all(abs(r["v"] - 1) < 1e-9 for r in grids.blur(flat, n, 1.0).collect())
    assert grids.blur(flat, n, 0.0) is flat


def test_cells_and_notes(spark):
    row = spark.range(1).select(cell(F.lit(1.0), 32).alias("c"), cell(F.lit(-0.2), 32).alias("d"), note(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("n"), note(F.lit(2.5), F.lit(0.0), F.lit(5.0), F.lit(9.0)).alias("m")).first()
    assert (row["c"], row["d"], row["n"], row["m"]) == (31, 0, 5.0, 2.5)


def test_names_and_clocks(spark):
    row = spark.range(1).select(name_key(F.lit("  Équipe   ÉCLAIR ")).alias("a"), player_identity(F.lit("SoLiz")).alias("b"), clock(F.lit(125.9)).alias("c"), parse_clock(F.lit("1:02:03")).alias("d"),
                                parse_clock(F.lit("83,5")).alias("e"), parse_clock(F.lit("x")).alias("f")).first()
    assert tuple(row) == ("equipe eclair", "50112", "2:05", 3723.0, 83.5, None)


def track(states, step=0.1):
    return pd.DataFrame({"game_id": 1, "slot": 2, "t": [i * step for i in range(len(states))], "alive": states})


def test_lives_death_needs_kill_or_silence():
    rows = track([True] * 20 + [False] * 20 + [True] * 20)
    assert stateful.lives(rows)["ended"].tolist() == ["end"]
    killed = stateful.lives(rows, pd.DataFrame({"t": [1.95]}))
    assert killed["ended"].tolist() == ["death"]  # the run after it starts too early to be a new life
    later = track([True] * 20 + [False] * 130 + [True] * 20)
    assert stateful.lives(later)["ended"].tolist() == ["death", "end"]
    assert len(stateful.lives(track([False] * 5))) == 0


def test_waves_are_anchored_not_chained():
    exits = pd.DataFrame({"game_id": 1, "team": "A", "slot": [1, 2, 3, 4], "t": [0.0, 7.0, 14.0, 15.0]})
    assert stateful.anchored_waves(exits)[["t0", "t1", "players"]].values.tolist() == [[0.0, 7.0, 2], [14.0, 15.0, 2]]


def test_greedy_is_one_to_one():
    pairs = pd.DataFrame({"dt": [0.5, 0.1, 0.3], "a": [1, 1, 2], "b": [7, 8, 8]})
    assert stateful.greedy_pairs(pairs)[["a", "b"]].values.tolist() == [[1, 8]]


def test_mutual_pairs_are_the_greedy_ones_of_all_pairs():
    rng = random.Random(5)
    for _ in range(60):
        rows = {(i // 2 if rng.random() < 0.3 else 1000 + i, float(rng.randrange(25)), rng.randint(1, 3), rng.randint(5, 6), rng.random() < 0.5) for i in range(rng.randrange(2, 60))}
        times = {i: (t, back) for i, t, *_, back in rows}
        kills = pd.DataFrame([(1, i, times[i][0], *((v, k) if times[i][1] else (k, v))) for i, _, k, v, _ in rows], columns=["game_id", "id", "t", "killer", "victim"])
        x = kills.merge(kills, left_on=["game_id", "killer", "victim"], right_on=["game_id", "victim", "killer"], suffixes=("", "_b"))
        x = x.assign(a=x["id"], b=x["id_b"], dt=x["t_b"] - x["t"])
        x = x[x["dt"].between(0, 4) & (x["a"] != x["b"])]
        wanted = stateful.greedy_pairs(x) if len(x) else x
        assert stateful.mutual_pairs(kills, 4.0)[["a", "b", "dt"]].values.tolist() == wanted[["a", "b", "dt"]].values.tolist()


def test_mutual_pairs_of_a_dense_hour_are_not_all_held():
    """60,000 kills of two players within an hour have 900 million pairs."""
    n = 60_000
    side = np.random.default_rng(3).random(n) < 0.5
    kills = pd.DataFrame({"game_id": 1, "id": np.arange(n), "t": np.arange(n) * 0.05, "killer": np.where(side, 1, 5), "victim": np.where(side, 5, 1)})
    tracemalloc.start()
    found = stateful.mutual_pairs(kills, 3600.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and len(set(found["a"]) | set(found["b"])) == 2 * len(found) and len(found) == min(side.sum(), n - side.sum())


def test_lanes_never_overlap():
    rng = random.Random(3)
    spans = pd.DataFrame([(1, i, t, t + rng.random() * 5) for i, t in enumerate(rng.random() * 20 for _ in range(40))], columns=["game_id", "event_id", "t0", "t1"])
    for _, own in stateful.lanes(spans).groupby("lane"):
        assert (own["t0"].to_numpy()[1:] >= own["t1"].to_numpy()[:-1]).all()


def test_foci_first_fit():
    kills = pd.DataFrame({"t": [0.0, 1.0, 2.0], "event_id": [1, 2, 3], "x": [0.0, 0.9, np.nan], "y": [0.0, 0.9, np.nan]})
    assert stateful.foci(kills)["focus"].tolist() == [0, 1, 0]


def test_walls_hide_what_is_behind():
    wall = np.zeros((8, 8), bool)
    wall[4, :] = True
    seen = stateful.visible(0.1, 0.5, wall)
    assert seen[4, 4] and not seen[6].any() and seen[2].all()
    assert stateful.visible(0.1, 0.5, np.zeros((8, 8), bool)).all()


@pytest.mark.parametrize("x,y,tx,ty", [(0.1, 0.1, 0.9, 0.9), (0.9, 0.2, 0.1, 0.2), (0.5, 0.9, 0.5, 0.05)])
def test_rays_are_connected(x, y, tx, ty):
    cells = stateful.ray_cells(x, y, tx, ty, 16)
    assert cells[-1] == (int(tx * 16), int(ty * 16))
    assert all(math.dist(a, b) == 1 for a, b in zip(cells, cells[1:]))
