"""Inferred values on hand-written games."""

from matchlake.operators import inference as I


def test_killers_by_elimination(spark):
    kills = spark.createDataFrame([(1, 1.0, 5, "W1"), (1, 2.0, 5, "W9"), (1, 3.0, 5, None), (1, 4.0, 5, None), (1, 5.0, 5, None), (1, 6.0, 5, "W1")], "game_id long, t double, victim_slot int, weapon string")
    seen = spark.createDataFrame([
        (1, 1.0, 5, 1, 0.9, "W1"), (1, 1.0, 5, 2, 0.1, "W2"),  # one holds the weapon
        (1, 2.0, 5, 1, 0.1, "W1"), (1, 2.0, 5, 2, 0.9, "W2"),  # nobody does
        (1, 3.0, 5, 1, 0.6, None), (1, 3.0, 5, 2, 1.0, None),  # nearest at exactly the ratio
        (1, 4.0, 5, 1, 0.7, None), (1, 4.0, 5, 2, 1.0, None), (1, 4.0, 5, 3, None, None),  # not clearly nearer
        (1, 6.0, 5, 4, None, None)], "game_id long, t double, victim_slot int, slot int, dist double, weapon string")
    assert {r["t"]: r["killer_slot"] for r in I.infer_killers(kills, seen).collect()} == {1.0: 1, 2.0: None, 3.0: 1, 4.0: None, 5.0: None, 6.0: 4}
    assert I.infer_killers(kills.limit(0), seen.limit(0)).count() == 0


def test_calendar_votes_leave_out_the_point_before(spark):
    periods = spark.createDataFrame([(1, k, 20.0 * k, 20.0 * (k + 1)) for k in range(4)] + [(2, 0, 0.0, 20.0)], "game_id long, k int, t0 double, t1 double")
    lit = {"A": lambda t: t < 45, "B": lambda t: 25 <= t < 44 and t % 2 == 0, "C": lambda t: t == 70}
    readings = spark.createDataFrame([(1, float(t), p, on(t)) for t in range(81) for p, on in lit.items()], "game_id long, t double, point string, lit boolean")
    found = {(r["game_id"], r["k"]): r["point"] for r in I.calendar_votes(periods, readings).collect()}
    # A; then B, as A was before it; then A, lit for under 20 % with margin; nothing in the last period nor in a game without readings
    votes_a = sum(42 <= t < 60 and lit["A"](t) for t in range(81))
    assert found == {(1, 0): "A", (1, 1): "B", (1, 2): "A" if votes_a >= 3 and votes_a >= 0.2 * 18 else None, (1, 3): None, (2, 0): None}


def test_calendar_votes_need_the_same_point_to_go_out(spark):
    periods = spark.createDataFrame([(g, k, 20.0 * k, 20.0 * (k + 1)) for g in (1, 2) for k in range(2)], "game_id long, k int, t0 double, t1 double")
    readings = spark.createDataFrame([(g, float(t), "A", g == 1 or t != 21) for g in (1, 2) for t in range(41)], "game_id long, t double, point string, lit boolean")
    found = {(r["game_id"], r["k"]): r["point"] for r in I.calendar_votes(periods, readings).collect()}
    assert found == {(1, 0): "A", (1, 1): None, (2, 0): "A", (2, 1): "A"}


def test_loadouts_by_vote(spark):
    schema = "game_id long, slot int, life_idx int, at double, late boolean, place int, weapon string, pale boolean, gadget string"
    reads = spark.createDataFrame([
        (1, 1, 0, 1.0, False, 1, "rifle", False, "mine"), (1, 1, 0, 2.0, False, 1, "rifle", False, None), (1, 1, 0, 1.0, False, 2, "rifle", True, None), (1, 1, 0, 9.0, True, 1, "rifle", False, "drone"),
        (1, 1, 1, 1.0, False, 1, "bow", True, None), (1, 1, 1, 2.0, False, 2, "axe", False, "drone"), (1, 1, 1, 3.0, False, 2, "gun", False, None),
        (1, 2, 0, 1.0, False, None, None, False, None)], schema)
    spare = spark.createDataFrame([(1, 2, "rifle", "rifle", "mine"), (1, 1, "gun", "gun", "net")], "game_id long, slot int, weapon1 string, weapon2 string, gadget string")
    plain = {(r["slot"], r["life_idx"]): tuple(r)[3:] for r in I.voted_loadouts(reads).collect()}
    assert plain == {(1, 0): ("rifle", None, "mine", "rifle"), (1, 1): ("bow", "axe", "drone", None), (2, 0): (None, None, None, None)}
    filled = {(r["slot"], r["life_idx"]): tuple(r)[3:] for r in I.voted_loadouts(reads, spare).collect()}
    assert filled == {(1, 0): ("rifle", "gun", "mine", "rifle"), (1, 1): ("bow", "axe", "drone", None), (2, 0): ("rifle", None, "mine", None)}
