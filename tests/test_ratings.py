"""Ratings: notes on a scale, coverage, and the components of hand-made matches."""

import random
import time

import duckdb
import pytest
from match_frames import FAR_A, MID, POINT, ZONES, Matches, dying, leave, stay, whole
from pyspark.sql import functions as F

from matchlake.functions.geometry import metres
from matchlake.operators import combat as C
from matchlake.operators import ratings as G
from matchlake.plans.combats import revenge_links

NAMES = [c[0] for c in G.COMPONENTS]


@pytest.mark.parametrize(("value", "down", "note"), [(2.0, False, 10.0), (1.0, False, 0.0), (1.5, False, 5.0), (0.0, False, 0.0), (4.0, False, 20.0), (3.0, False, 15.0), (9.0, False, 20.0), (1.5, True, 15.0), (None, False, None), (None, True, None)])
def test_notes(spark, value, down, note):
    df = spark.createDataFrame([(value, 1.0, 2.0, 4.0, down)], "v double, lo double, mid double, hi double, down boolean")
    assert df.select(G.note_20(*map(F.col, ("v", "lo", "mid", "hi", "down")))).first()[0] == note


def test_notes_without_a_span(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0, 2.0), (1.0, 2.0, 2.0, 2.0), (3.0, 2.0, 2.0, 2.0), (3.0, None, None, None)], "v double, lo double, mid double, hi double")
    assert [r[0] for r in df.select(G.note_20(F.col("v"), F.col("lo"), F.col("mid"), F.col("hi"), F.lit(False))).collect()] == [10.0, 0.0, 20.0, None]


def raws(spark, rows):
    return spark.createDataFrame([(1, s, 0, source, *[values.get(n) for n in NAMES]) for s, (source, values) in enumerate(rows, 1)], "game_id long, slot int, assists long, assist_source string, " + ", ".join(f"{n} double" for n in NAMES))


def test_coverage_and_the_strict_mean(spark):
    full = dict.fromkeys(NAMES, 2.0)
    scale = spark.createDataFrame([(k, 1.0, 2.0, 3.0) for k in [*NAMES, "assists_per_min:measured", "share_assists:measured"]], "key string, p05 double, p50 double, p95 double")
    rows = [("measured", full), ("measured", {**full, "kills_per_min": 3.0, "deaths_per_min": 1.0}), ("measured", {n: full[n] for n in NAMES if n not in ("kills_per_min", "deaths_per_min")}), ("board", full), ("measured", {})]
    found = {r["slot"]: r for r in G.rate_players(raws(spark, rows), scale).collect()}
    assert (found[1]["individual"], found[1]["teamplay"], found[1]["overall"]) == (10.0, 10.0, 10.0)
    assert (found[2]["individual"], found[2]["overall"]) == (16.0, 13.0)
    assert (found[3]["individual"], found[3]["teamplay"], found[3]["overall"]) == (None, 10.0, None)  # four tenths of the weight
    assert found[4]["individual"] == 10.0 and {n["component"] for n in found[4]["notes"] if n["note"] is None} == {"assists_per_min", "share_assists"}  # no scale for that source
    assert (found[5]["individual"], found[5]["teamplay"]) == (None, None)


def test_calibration(spark):
    rows = [("measured", {"aggro": float(v), "assists_per_min": 1.0}) for v in range(21)]
    found = {r["key"]: (r["p05"], r["p50"], r["p95"], r["n"]) for r in G.calibrated(raws(spark, rows)).collect()}
    assert found == {"aggro": (1.0, 10.0, 19.0, 21), "assists_per_min:measured": (1.0, 1.0, 1.0, 21)}


@pytest.fixture(scope="module")
def found(spark):
    m = Matches()
    m.add("helped kill", {1: whole(stay(MID)), 2: whole(stay((0.5, 0.54))), 3: whole(stay((0.2, 0.1))), 5: dying(5, 100.0, stay(MID)), 6: whole(stay(MID))}, [(100, 1, 5)], spawn=False)
    # slot 5 walks to slot 1, who is alone, and slot 1 lives
    m.add("drawn", {1: whole(stay(FAR_A)), 5: whole(leave((0.3, 0.1), 50.0, 60.0, FAR_A))}, spawn=False)
    m.add("drawn and dead", {1: [(0.0, 61.0, "death", stay(FAR_A))], 5: whole(leave((0.3, 0.1), 50.0, 60.0, FAR_A))}, [(61, 5, 1)], spawn=False)
    f = m.frames(spark)
    rect = "struct<x0:double,y0:double,x1:double,y1:double>"
    zones = spark.createDataFrame([(g, t, z) for g in m.ids.values() for t, z in ZONES.items()], f"game_id long, team string, zone {rect}")
    points = spark.createDataFrame([(g, 0.0, 200.0, dict(zip(("x0", "y0", "x1", "y1"), POINT, strict=True))) for g in m.ids.values()], f"game_id long, t0 double, t1 double, rect {rect}")
    kills = f["kills"].drop("kind")
    lives = f["lives"].join(kills.select("game_id", F.col("victim_slot").alias("slot"), F.col("t").alias("t1"), "killer_slot"), ["game_id", "slot", "t1"], "left")
    scores = kills.withColumn("impact", F.lit(2.0)).withColumn("death_impact", F.lit(None).cast("double"))
    links = spark.createDataFrame([], "game_id long, t double, victim_slot int, kind string, other_slot int, dt double")
    stats = spark.createDataFrame([(1, 1, 3, 4), (1, 2, None, 4), (1, 5, 9, 4), (1, 6, 1, 0)], "game_id long, slot int, gadget_uses int, gadget_possible int")
    focused, _, _ = C.fight_tables(kills, lives, f["samples"])
    arguments = (f["games"], lives, f["samples"], kills, focused, zones, points, scores, links, stats)
    board = spark.createDataFrame([(1, s, 7) for s in (1, 2, 3, 5, 6)] + [(2, 1, 7), (2, 5, None)], "game_id long, slot int, assists int")
    names = {g: n for n, g in m.ids.items()}
    pick = lambda df: {(names[r["game_id"]], r["slot"]): r for r in df.collect()}
    return pick(G.raw_components(*arguments)), pick(G.raw_components(*arguments, board=board))


def test_components(found):
    rows, _ = found
    one, two, three, five = (rows["helped kill", s] for s in (1, 2, 3, 5))
    assert one["kills_per_min"] == pytest.approx(0.3) and five["deaths_per_min"] == pytest.approx(0.3) and one["share_kills"] == 1.0 and two["share_kills"] == 0.0
    assert (two["assists"], three["assists"], one["assists"]) == (1, 0, 0) and two["share_assists"] == 1.0 and one["assist_source"] == "measured"
    assert one["presence"] == 1.0 and one["objective"] == pytest.approx(1.0, abs=0.01) and three["objective"] == 0.0 and one["cohesion"] == pytest.approx(0.465, abs=0.01)
    assert (one["kill_quality"], five["death_quality"], two["kill_quality"]) == (2.0, -2.0, None)
    assert (one["fight_first_kill"], one["fight_front"], two["fight_front"], five["fight_front"]) == (1.0, 1.0, 0.0, 1.0)
    assert (one["gadget"], two["gadget"], five["gadget"], rows["helped kill", 6]["gadget"]) == (0.75, None, 1.0, None)
    assert three["space"] is None or 0.0 <= three["space"] <= 1.0


def test_drawing_enemies(found):
    rows, _ = found
    alone, dead = rows["drawn", 1]["aggro"], rows["drawn and dead", 1]["aggro"]
    assert alone > 1.0 and dead == pytest.approx(alone / 2, rel=0.2)
    # the one who walks is closed in on as well
    assert rows["drawn", 5]["aggro"] == pytest.approx(alone)


def test_assists_of_the_board_count_where_all_are_told(found):
    _, rows = found
    assert {rows["helped kill", s]["assists"] for s in (1, 2, 3, 5, 6)} == {7} and rows["helped kill", 1]["assist_source"] == "board"
    assert rows["drawn", 1]["assist_source"] == "measured" and rows["drawn", 1]["assists"] == 0


def test_each_revenge_is_its_killers(spark):
    """Slot 1 ends twice within half a second, by 5 and then by 6, after it had killed 7 and 8; once it kills 5, which 5 itself cannot avenge."""
    rows = [(1, 100.0, 1, 7), (1, 200.0, 1, 8), (1, 300.0, 5, 1), (1, 300.3, 6, 1), (1, 400.0, 1, 5), (1, 500.0, 5, 1), (1, 9000.0, 6, 1)]
    kills = spark.createDataFrame(rows, "game_id long, t double, killer_slot int, victim_slot int")
    links = revenge_links({"kills": kills})
    found = sorted(tuple(r) for r in links.select("t", "victim_slot", "killer_slot", "other_slot", F.round("dt", 3)).collect())
    assert found == [(300.0, 1, 5, 8, 100.0), (300.3, 1, 6, 8, 100.3), (500.0, 1, 5, 8, 300.0)]
    made = G._avengers(links, kills, G.RatingLimits()).groupBy("slot").count().collect()
    assert {r["slot"]: r["count"] for r in made} == {5: 2, 6: 1}
    told = G._avengers(links.drop("killer_slot"), kills, G.RatingLimits()).collect()  # as links without a killer tell it
    assert sorted(r["slot"] for r in told) == [5, 5, 5]


def test_notes_and_distances_as_in_sql(spark):
    """Notes between two hundredths, and distances of places of which two are equally far."""
    scale = spark.range(1, 400).select(F.lit(0.0).alias("low"), F.lit(8.0).alias("mid"), F.lit(20.0).alias("high"), (F.col("id") / 50).alias("v"))
    con = duckdb.connect()
    con.register("f", scale.toPandas())
    raws = scale.select(F.lit(1).cast("long").alias("game_id"), F.monotonically_increasing_id().alias("slot"), F.lit("measured").alias("assist_source"), *[(F.col("v") if c[0] == "kills_per_min" else F.lit(None).cast("double")).alias(c[0]) for c in G.COMPONENTS])
    of = spark.createDataFrame([("kills_per_min", 0.0, 8.0, 20.0)], "key string, p05 double, p50 double, p95 double")
    rated = G.rate_players(raws, of).select(F.explode("notes").alias("n")).where("n.component = 'kills_per_min'").select("n.note")
    wanted = con.execute("SELECT round(10.0 * (v - low) / (mid - low), 2) AS note FROM f").fetchall()
    assert sorted(r["note"] for r in rated.collect()) == sorted(n for n, in wanted)
    con.execute("CREATE TABLE p AS SELECT a.i / 100.0::DOUBLE AS x, b.i / 100.0::DOUBLE AS y FROM range(100) a(i), range(100) b(i)")
    wanted = con.execute("SELECT sqrt(pow((x - 0.37) * 31.0, 2) + pow((y - 0.61) * 16.5, 2)) AS d FROM p").fetchall()
    places = spark.range(100).select((F.col("id") / 100.0).alias("x")).crossJoin(spark.range(100).select((F.col("id") / 100.0).alias("y")))
    assert sorted(r["d"] for r in places.select(metres(F.col("x") - 0.37, F.col("y") - 0.61).alias("d")).collect()) == sorted(d for d, in wanted)


def test_players_around_moments_in_many_buckets(spark, monkeypatch):
    """Nearest living rows and lives of all slots, against brute force, with few rows in a bucket and gaps wider and narrower than it."""
    rng = random.Random(5)
    spots = [(g, rng.randint(1, 8), rng.randrange(4000) / 4, rng.randrange(100) / 100, rng.randrange(100) / 100, rng.random() < 0.8) for g in (1, 2) for _ in range(300)]
    spots.append((1, 3, 5.0, None, None, True))
    lives = [(g, s, float(a), float(a + rng.randrange(1, 300))) for g in (1, 2) for s in range(1, 9) for a in range(0, 1000, 250) if rng.random() < 0.8]
    asks = [(g, rng.randrange(4000) / 4, i) for i, g in enumerate([1, 2, 3] * 40)]
    monkeypatch.setattr(C, "BUCKET_ROWS", 16)
    for gap in (2.0, 40.0, 400.0):
        found = C.around(spark.createDataFrame(asks, "game_id long, t double, n int"), spark.createDataFrame(lives, "game_id long, slot int, t0 double, t1 double"),
                         spark.createDataFrame(spots, "game_id long, slot int, t double, x double, y double, alive boolean"), gap).collect()
        assert sorted(r["n"] for r in found) == list(range(len(asks)))
        for r in found:
            assert [p["slot"] for p in r["players"]] == list(range(1, 9))
            for p in r["players"]:
                own = [s for s in spots if s[0] == r["game_id"] and s[1] == p["slot"] and s[5] and s[3] is not None and abs(s[2] - r["t"]) <= gap]
                best = min(((abs(s[2] - r["t"]), s[2]) for s in own), default=None)
                assert (p["x"], p["y"]) in ([(s[3], s[4]) for s in own if (abs(s[2] - r["t"]), s[2]) == best] or [(None, None)])
                assert p["living"] == any(v[0] == r["game_id"] and v[1] == p["slot"] and v[2] <= r["t"] <= v[3] for v in lives)


def test_revenges_of_a_long_day_take_linear_time(spark):
    """30,000 kills of one slot and as many ends of it; all pairs are 900 million."""
    kills = spark.range(60_000).select(F.lit(1).cast("long").alias("game_id"), (F.col("id") / 1.0).alias("t"), F.when(F.col("id") % 2 == 0, 1).otherwise(5 + F.col("id") % 4).cast("int").alias("killer_slot"), F.when(F.col("id") % 2 == 0, 5 + F.col("id") % 3).otherwise(1).cast("int").alias("victim_slot"))
    began = time.time()
    links = revenge_links({"kills": kills})
    assert links.count() > 29_000
    assert time.time() - began < 20
