"""Duels on hand-made matches: by kills and by hit points, interruptions, recoveries and ends of games."""

import random
import time

import pytest
from match_frames import DURATION, FAR_A, FAR_B, MID, Matches, dying, stay, whole
from pyspark.sql import functions as F

from matchlake.operators import series as S
from matchlake.operators.duels import DuelLimits, damage_stretches, find_duels

ALONE = {1: whole(stay(FAR_A)), 6: whole(stay(FAR_A))}
BOTH_LOSE = {1: [(30.0, 1.0), (31.0, 0.5)], 6: [(31.0, 1.0), (32.0, 0.8)]}
DOWN = {1: [(30.0, 1.0), (31.0, 0.5)], 6: [(30.0, 1.0), (33.0, 0.0)]}


@pytest.fixture(scope="module")
def found(spark):
    m = Matches()
    third = {1: whole(stay(FAR_A)), 2: whole(stay(FAR_A)), 6: dying(6, 33.0, stay(FAR_A))}
    m.add("kill", {1: whole(stay(FAR_A)), 5: dying(5, 40.0, stay(FAR_A))}, [(40, 1, 5)], {5: [(37.0, 1.0), (40.0, 0.0)], 1: [(38.0, 1.0), (39.0, 0.6)]})
    m.add("trade", {1: dying(1, 40.5, stay(FAR_A)), 5: dying(5, 40.0, stay(FAR_A))}, [(40, 1, 5), (40.5, 5, 1)])
    m.add("teamfight", {s: whole(stay(MID)) for s in (1, 2, 3, 5, 6, 7)}, [(40, 1, 5), (42, 2, 6), (44, 7, 3), (46, 2, 7)])
    m.add("helped", {1: whole(stay(MID)), 2: whole(stay(MID)), 5: dying(5, 40.0, stay(MID)), 6: whole(stay(MID))}, [(40, 1, 5)])
    m.add("hit points", ALONE, hp=BOTH_LOSE)
    m.add("within the margin", ALONE, hp={1: [(30.0, 1.0), (31.0, 0.5)], 6: [(31.0, 1.0), (32.0, 0.55)]})
    m.add("small losses", ALONE, hp={1: [(30.0, 1.0), (31.0, 0.92)], 6: [(30.0, 1.0), (31.0, 0.5)]})
    m.add("far apart", {1: whole(stay(FAR_A)), 6: whole(stay(FAR_B))}, hp={1: [(30.0, 1.0), (31.0, 0.5)], 6: [(30.0, 1.0), (31.0, 0.5)]})
    m.add("not together", ALONE, hp={1: [(30.0, 1.0), (31.0, 0.5)], 6: [(60.0, 1.0), (61.0, 0.5)]})
    m.add("recovery read", ALONE, hp={1: [(30.0, 1.0), (31.0, 0.5), (36.0, 0.5), (37.0, 1.0)], 6: [(31.0, 1.0), (32.0, 0.8)]})
    m.add("third player", third, [(33, 2, 6)], DOWN)
    m.add("third player fought too", third, [(33, 2, 6)], {**DOWN, 2: [(31.0, 1.0), (32.0, 0.6)]})
    m.add("unseen death", {1: whole(stay(FAR_A)), 6: dying(6, 33.0, stay(FAR_A))}, hp=DOWN)
    m.add("kill of the other", {1: whole(stay(FAR_A)), 6: dying(6, 33.0, stay(FAR_A))}, [(33, 1, 6)], DOWN)
    m.add("end of the game", ALONE, hp={1: [(194.0, 1.0), (195.0, 0.5)], 6: [(194.0, 1.0), (195.0, 0.6)]})
    m.add("one in two pairs", {1: whole(stay(FAR_A)), 5: whole(stay((0.3, 0.1))), 6: whole(stay(FAR_A))}, hp={1: [(30.0, 1.0), (32.0, 0.5)], 5: [(31.5, 1.0), (32.5, 0.6)], 6: [(30.0, 1.0), (31.8, 0.62)]}, spawn=False)
    m.add("nobody", {}, spawn=False)
    f = m.frames(spark)
    kills = f["kills"].select("game_id", "t", "killer_slot", "victim_slot")
    return {"with": m.rows(find_duels(f["hp"], kills, f["lives"], f["samples"], f["games"])),
            "helped": m.rows(find_duels(f["hp"], kills, f["lives"], f["samples"], f["games"], keep_helped=True)),
            "without": m.rows(find_duels(None, kills, f["lives"], f["samples"], f["games"])),
            "stretches": m.rows(damage_stretches(f["hp"], f["lives"]))}


def brief(rows):
    return sorted((r["slot_a"], r["slot_b"], r["winner"], r["outcome"]) for r in rows)


def test_a_lone_kill_is_won_by_the_killer(found):
    [d] = found["with"]["kill"]
    assert (d["slot_a"], d["slot_b"], d["winner"], d["outcome"], d["source"]) == (1, 5, 1, "kill", "kill")
    assert abs(d["t0"] - 37.0) < 0.6 and d["t1"] == 40.0
    assert d["hp_start_b"] == 1.0 and d["hp_end_b"] == 0.0 and abs(d["hp_start_a"] - d["hp_end_a"] - 0.4) < 0.05


def test_two_crossed_kills_are_a_trade(found):
    [d] = found["with"]["trade"]
    assert (d["outcome"], d["winner"], d["slot_a"], d["slot_b"], d["series_kills"]) == ("trade", None, 1, 5, 2)


def test_a_teamfight_is_no_duel(found):
    assert found["with"]["teamfight"] == []


def test_a_kill_with_help_on_both_sides_counts_only_on_demand(found):
    assert found["with"]["helped"] == []
    assert [r["winner"] for r in found["helped"]["helped"]] == [1]


def test_without_hit_points_there_are_duels_by_kill(found):
    [d] = found["without"]["kill"]
    assert d["winner"] == 1 and d["hp_end_a"] is None and d["t0"] == 39.0
    assert found["without"]["hit points"] == []


def test_more_hit_points_left_win(found):
    [d] = found["with"]["hit points"]
    assert (d["slot_a"], d["slot_b"], d["winner"], d["outcome"], d["source"]) == (1, 6, 6, "hit_points", "hp")
    assert abs(d["hp_end_a"] - 0.5) < 0.05 and abs(d["hp_end_b"] - 0.8) < 0.05 and d["dist_m"] == 0.0
    assert d["ended_by"] == "recovery" and not d["regen_read_a"] and not d["regen_read_b"]
    assert abs(d["t0"] - 30.0) < 0.6 and abs(d["t1"] - (31.0 + DuelLimits().delay)) < 0.4


def test_a_difference_within_the_margin_is_undecided(found):
    assert brief(found["with"]["within the margin"]) == [(1, 6, None, "undecided")]


@pytest.mark.parametrize("name", ["small losses", "far apart", "not together", "nobody"])
def test_no_duel(found, name):
    assert found["with"][name] == []


def test_a_recovery_that_is_read_ends_it(found):
    [d] = found["with"]["recovery read"]
    assert abs(d["t1"] - 36.0) < 0.3 and d["regen_read_a"] and d["winner"] == 6 and abs(d["hp_end_a"] - 0.5) < 0.05


def test_a_third_players_kill_interrupts(found):
    [d] = found["with"]["third player"]
    assert (d["slot_a"], d["slot_b"], d["winner"], d["outcome"], d["ended_by"]) == (1, 6, None, "interrupted", "third_kill")
    assert (d["third_slot"], d["third_victim"], d["third_t"]) == (2, 6, 33.0) and abs(d["t1"] - 33.0) < 0.6


def test_a_third_player_who_lost_hit_points_too_keeps_the_duel(found):
    assert brief(found["with"]["third player fought too"]) == [(1, 6, None, "interrupted"), (2, 6, 2, "kill")]


def test_a_death_without_a_kill_is_undecided(found):
    [d] = found["with"]["unseen death"]
    assert (d["outcome"], d["winner"], d["ended_by"]) == ("undecided", None, "unseen_death")


def test_a_kill_of_the_other_is_one_duel(found):
    assert brief(found["with"]["kill of the other"]) == [(1, 6, 1, "kill")]


def test_the_end_of_the_game_bounds_a_recovery(found):
    [d] = found["with"]["end of the game"]
    assert d["t1"] <= DURATION - DuelLimits().blank + 1e-6 and d["hp_end_a"] is not None


def test_a_stretch_is_in_one_duel_that_of_the_largest_overlap(found):
    assert brief(found["with"]["one in two pairs"]) == [(1, 6, 6, "hit_points")]


def test_stretches(found):
    [s] = [r for r in found["stretches"]["recovery read"] if r["slot"] == 1]
    assert s["loss"] == 0.5 and abs(s["t0"] - 30.0) < 0.1 and abs(s["t1"] - 31.3) < 0.35 and s["death_t"] is None and abs(s["regen_t"] - 36.0) < 0.2
    assert {(r["slot"], r["death_t"], r["after"]) for r in found["stretches"]["unseen death"]} == {(1, None, 0.5), (6, 33.0, 0.0)}


def test_trailing_max_by_brute_force(spark):
    """Ties, null values, one key without rows in the block before, and a window wider and narrower than the steps."""
    rng = random.Random(3)
    rows = [(k, rng.randrange(-40, 400), None if rng.random() < 0.1 else rng.randrange(50)) for k in "ab" for _ in range(150)]
    for width in (1, 7, 60, 1000):
        found = S.trailing_max(spark.createDataFrame(rows, "k string, at long, v int"), ["k"], "at", width, "v", "most").collect()
        assert sorted((r["k"], r["at"], -1 if r["v"] is None else r["v"]) for r in found) == sorted((k, at, -1 if v is None else v) for k, at, v in rows)
        for r in found:
            assert r["most"] == max((v for k, at, v in rows if k == r["k"] and r["at"] - width <= at <= r["at"] and v is not None), default=None)


def test_stretches_of_dense_rows_take_linear_time(spark):
    """100,000 rows of a slot, 0.1 s apart; windows of 30,000 and 60,000 rows, read again for each row, are 9e9 steps."""
    hp = spark.range(100_000).select(F.lit(1).cast("long").alias("game_id"), F.lit(1).alias("slot"), (F.col("id") / 10).alias("t"), ((F.col("id") * 7919) % 1000 / 1000).alias("hp"))
    lives = spark.createDataFrame([], "game_id long, slot int, t1 double, ended string")
    began = time.time()
    assert damage_stretches(hp, lives, DuelLimits(window=3000.0, drop=0.2, hit_gap=3600.0)).count() == 1
    assert time.time() - began < 30
