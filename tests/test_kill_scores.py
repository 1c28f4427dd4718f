"""What kills and deaths are worth, on hand-made matches."""

import pytest
from match_frames import A_SPAWN, DURATION, FAR_A, FAR_B, MID, POINT, ZONES, Matches, dying, leave, stay, whole

from matchlake.operators import combat as C
from matchlake.operators import waves as W
from matchlake.operators.scores import score_kills

AT_POINT = {s: whole(stay(MID)) for s in (5, 6, 7)}
ATTACK = {**{s: whole(leave(A_SPAWN, t, t + 8.0)) for s, t in ((1, 20.0), (2, 22.0), (3, 24.0))}, **AT_POINT}


@pytest.fixture(scope="module")
def found(spark):
    m = Matches()
    m.add("outnumbered", {1: whole(stay(FAR_A)), 2: whole(stay(FAR_A)), 5: dying(5, 40.0, stay(FAR_A))}, [(40, 1, 5)])
    m.add("even", {1: whole(stay(FAR_A)), 5: dying(5, 40.0, stay(FAR_A)), 6: whole(stay(FAR_A))}, [(40, 1, 5)], spawn=False)
    m.add("trade", {1: dying(1, 40.5, stay(FAR_A)), 5: dying(5, 40.0, stay(FAR_A))}, [(40, 1, 5), (40.5, 5, 1)], spawn=False)
    m.add("late death", {1: dying(1, 41.5, stay(FAR_A)), 5: dying(5, 40.0, stay(FAR_A))}, [(40, 1, 5), (41.5, 5, 1)], spawn=False)
    m.add("no life ends", {1: whole(stay(FAR_A)), 5: whole(stay(FAR_A))}, [(40, 1, 5)])
    m.add("wave and capture", {**ATTACK, 5: dying(5, 31.0, stay(MID)), **{s: whole(stay(FAR_B)) for s in (6, 7, 8)}}, [(31, 1, 5)], owners=[(0, 5, "none"), (5, 45, "B"), (45, 100, "A")])
    m.add("holds", {1: whole(stay(MID)), 2: whole(stay(MID)), 5: dying(5, 40.0, stay(MID))}, [(40, 1, 5)], owners=[(0, 5, "none"), (5, 100, "A")], spawn=False)
    m.add("capture too late", {1: whole(stay(MID)), 2: whole(stay(MID)), 5: dying(5, 40.0, stay(MID))}, [(40, 1, 5)], owners=[(0, 5, "none"), (5, 61, "B"), (61, 100, "A")], spawn=False)
    m.add("holds outnumbered", {1: whole(stay(MID)), 5: dying(5, 40.0, stay(MID)), 6: whole(stay(MID)), 7: whole(stay(MID))}, [(40, 1, 5)], owners=[(0, 5, "none"), (5, 100, "A")], spawn=False)
    shield = {1: dying(1, 40.0, stay(FAR_A)), **{s: whole(stay(FAR_A)) for s in (2, 3, 4)}, 5: dying(5, 42.0, stay(FAR_A)), 6: dying(6, 44.0, stay(FAR_A))}
    m.add("shield", shield, [(40, 5, 1), (42, 2, 5), (44, 3, 6)], spawn=False)
    m.add("no shield where the fight is lost", {**shield, 2: dying(2, 45.0, stay(FAR_A)), 3: dying(3, 46.0, stay(FAR_A)), 7: whole(stay((0.6, 0.1)))}, [(40, 5, 1), (42, 2, 5), (44, 3, 6), (45, 7, 2), (46, 7, 3)], spawn=False)
    m.add("nobody", {}, spawn=False)
    f = m.frames(spark)
    corner = ("x0", "y0", "x1", "y1")
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    zones = spark.createDataFrame([(g, t, z) for g in m.ids.values() for t, z in ZONES.items()], f"game_id long, team string, zone {rect}")
    instances = spark.createDataFrame([(g, "A", 1, 0.0, DURATION, dict(zip(corner, POINT, strict=True))) for g in m.ids.values()], f"game_id long, point string, inst int, t0 double, t1 double, rect {rect}")
    focused, _, fights = C.fight_tables(f["kills"].drop("kind"), f["lives"], f["samples"])
    waves = W.contacts(W.find_waves(f["lives"], f["samples"], zones, f["games"]), focused, fights)
    line, captures = W.point_tables(instances, f["owners"])
    return m.rows(score_kills(focused, fights, waves, line, captures, instances, f["lives"], f["samples"]).orderBy("game_id", "t"))


def told(rows):
    return [(r["killer_slot"], r["victim_slot"], r["impact"], r["death_impact"], sorted(r["reasons"])) for r in rows]


@pytest.mark.parametrize(("name", "rows"), [
    ("outnumbered", [(1, 5, 2.0, -1.0, ["superiority", "threat"])]),
    ("even", [(1, 5, 1.0, -1.0, ["threat"])]),
    ("trade", [(1, 5, 1.0, -0.5, ["threat", "trade"]), (5, 1, 1.0, -0.5, ["threat", "trade"])]),
    ("late death", [(1, 5, 2.0, -1.0, ["superiority", "threat"]), (5, 1, 2.0, -1.0, ["superiority", "threat"])]),
    ("no life ends", [(1, 5, 1.0, -1.0, ["threat", "unmatched"])]),
    ("wave and capture", [(1, 5, 3.0, -1.0, ["first_of_wave", "point", "superiority", "threat"])]),
    ("holds", [(1, 5, 3.0, -1.0, ["point", "superiority", "threat"])]),
    ("capture too late", [(1, 5, 2.0, -1.0, ["superiority", "threat"])]),
    ("holds outnumbered", [(1, 5, 1.0, -1.0, ["point_without_superiority", "threat"])]),
    ("nobody", []),
])
def test_scores(found, name, rows):
    assert told(found[name]) == rows


def test_a_shield_earns(found):
    first, *_ = found["shield"]
    assert (first["victim_slot"], first["death_impact"]) == (1, 1.0) and "shield" in first["reasons"]
    first, *_ = found["no shield where the fight is lost"]
    assert first["death_impact"] == -1.0 and "shield" not in first["reasons"]
