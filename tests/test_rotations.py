"""Rotations on hand-made matches of a map whose active point goes from C to B."""

import pytest
from match_frames import DURATION, Matches, whole
from pyspark.sql import functions as F

from matchlake.operators import rotations as R
from matchlake.plans import combats

AT_C, AT_B, FAR, ON_THE_WAY = (0.5, 0.82), (0.25, 0.37), (0.05, 0.05), (0.08, 0.65)


def box(x, y, w, h):
    return {"x0": x - w / 2, "y0": y - h / 2, "x1": x + w / 2, "y1": y + h / 2}


RECTS = {"C": box(*AT_C, 0.12, 0.10), "B": box(*AT_B, 0.12, 0.09)}
BOXES = [("C", 0.0, 88.0), ("B", 90.0, 178.0)]


def rotates(go, come):
    return whole(lambda t: AT_C if t < go else AT_B if t >= come else ON_THE_WAY)


STAYS = whole(lambda t: AT_C)


@pytest.fixture(scope="module")
def found(spark):
    m, active, owners, fixed = Matches(), [], [], []

    def add(name, players, boxes=BOXES, own=(), no_change=False):
        g = m.add(name, {s: players.get(s, whole(lambda t: FAR)) for s in range(1, 9)})
        active.extend((g, p, a, b, RECTS[p]) for p, a, b in boxes)
        owners.extend((g, p, float(a), float(b), o) for p, a, b, o in own)
        if no_change:
            fixed.append((g,))

    three = {1: rotates(92, 100), 2: rotates(93, 104), 3: rotates(95, 108), 5: STAYS, 6: STAYS}
    pair = {1: rotates(92, 100), 2: rotates(93, 104)}
    add("arrived", three)
    add("partial", {1: rotates(92, 100), 2: rotates(93, 1e9), 3: STAYS})
    add("dead on the way", {1: rotates(92, 100), 2: [(0.0, 95.0, "death", rotates(93, 1e9)[0][3]), (150.0, DURATION, "end", lambda t: FAR)], 3: STAYS})
    add("one player", {1: rotates(92, 100)})
    add("same point", {1: STAYS, 2: STAYS}, [("C", 0.0, 80.0), ("C", 90.0, 178.0)])
    add("flicker", three, [("C", 0.0, 40.0), ("C", 45.0, 88.0), ("B", 90.0, 178.0)])
    add("early", {1: rotates(80, 100), 2: rotates(81, 100), 3: STAYS})
    add("owner after", {**pair, 5: STAYS, 6: STAYS}, own=[("B", 91, 100, "none"), ("B", 100, 178, "A")])
    add("owner of another stretch", pair, own=[("B", 0, 20, "A")])
    add("no gap", {1: rotates(87, 98), 2: rotates(88, 99), 5: STAYS, 6: STAYS}, [("C", 0.0, 90.0), ("B", 90.0, 178.0)])
    add("long gap", pair, [("C", 0.0, 60.0), ("B", 100.0, 178.0)])
    add("no schedule", pair, [])
    add("fixed map", three, no_change=True)
    f = m.frames(spark)
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    act = spark.createDataFrame(active, f"game_id long, point string, t0 double, t1 double, rect {rect}")
    own = spark.createDataFrame(owners, "game_id long, point string, t0 double, t1 double, owner string")
    out = R.find_rotations(act, own, f["lives"], f["samples"], f["games"], fixed=spark.createDataFrame(fixed, "game_id long"))
    return m.rows(out.orderBy("game_id", "team"))


def test_a_team_that_goes_over_has_arrived(found):
    a, b = found["arrived"]
    assert (a["point"], a["point_to"], a["team"], a["outcome"], a["t"]) == ("C", "B", "A", "arrived", 90.0)
    assert [x["slot"] for x in a["starters"]] == [1, 2, 3] and [x["slot"] for x in a["arrivals"]] == [1, 2, 3]
    assert a["second_arrival"] == 14.0 and abs(a["distance_m"] - 10.6) < 0.2 and (a["t0"], a["t1"]) == (70.0, 120.0)
    assert b["team"] == "B" and b["outcome"] == "not_arrived"


def test_leaving_and_gathering(found):
    a, b = found["arrived"]
    assert a["was_on_old"] and not a["stays_on_old"] and a["leave_offset"] == 3.0 and a["leave_phase"] == "at_change" and a["alive_at_leave"] == 4
    assert a["concentrate_offset"] == 14.0 and a["first_arrival"] == 10.0 and not a["already_on_new"]
    assert [k["offset"] for k in a["keys"]] == [-20.0, -10.0, 0.0, 10.0, 20.0] and (a["keys"][2]["near_old"], a["keys"][2]["near_new"], a["keys"][2]["alive"]) == (3, 0, 4)
    assert b["stays_on_old"] and b["leave_phase"] == "stays" and b["leave_offset"] is None
    assert [x["leave_t"] for x in a["starters"]] == [92.0, 93.0, 95.0]


def test_one_arrival_is_partial(found):
    [a] = found["partial"]
    assert a["outcome"] == "partial" and a["second_arrival"] is None


def test_a_death_on_the_way_is_told(found):
    [a] = found["dead on the way"]
    assert [(d["slot"], d["t"]) for d in a["deaths_en_route"]] == [(2, 95.0)]


@pytest.mark.parametrize("name", ["one player", "same point", "long gap", "no schedule", "fixed map"])
def test_no_rotation(found, name):
    assert found[name] == []


def test_a_short_gap_is_one_stretch(found):
    assert [(r["team"], r["outcome"]) for r in found["flicker"]] == [("A", "arrived"), ("B", "not_arrived")]


def test_a_team_that_left_before(found):
    [a] = found["early"]
    assert a["leave_phase"] == "before" and a["leave_offset"] == -9.0


def test_the_holder_after_wins(found):
    a, b = found["owner after"]
    assert (a["winner"], a["value"], b["value"], a["first_team"]) == ("A", "won", "lost", "A") and a["owner_10"] == "A" and a["owner_first"] == "A"
    [a] = found["owner of another stretch"]
    assert a["value"] == "undecided" and a["winner"] is None


def test_contiguous_stretches(found):
    a, b = found["no gap"]
    assert a["t"] == 90.0 and a["leave_phase"] == "at_change" and -5.0 <= a["leave_offset"] <= 0.0 and b["team"] == "B"


def test_phases(spark):
    df = spark.createDataFrame([(False, False, None), (True, True, None), (True, False, -5.1), (True, False, -5.0), (True, False, 5.0), (True, False, 5.1)], "was boolean, stays boolean, off double")
    assert [r[0] for r in df.select(R.leave_phase(F.col("was"), F.col("stays"), F.col("off"))).collect()] == ["never", "stays", "before", "at_change", "at_change", "after"]


def test_the_query_makes_no_pairs_of_kills(spark, monkeypatch):
    """Kills grow with the square of the rows that share a moment, and no rotation depends on them."""
    labels = []

    def spy(df, label):
        labels.append(label)
        return real(df, label)

    real = combats.written
    monkeypatch.setattr(combats, "written", spy)
    assert combats.rotations(spark, "/root/testdata/sf0.001").columns[:3] == ["game_id", "switch", "team"]
    assert "lives" in labels and "kills" not in labels
