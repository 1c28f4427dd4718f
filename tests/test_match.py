"""Match-table operators, sinks and routes on hand-written games."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import match as M
from matchlake.plans import routes
from matchlake.sources import sinks

KILLS = "game_id long, t double, killer_slot int, victim_slot int, kind string"


def kills(spark, *rows):
    return spark.createDataFrame(list(rows), KILLS)


def spots(spark, *rows):
    return spark.createDataFrame([(1, s, t, x, y, True) for s, t, x, y in rows], "game_id long, slot int, t double, x double, y double, alive boolean")


def test_trades_are_mutual_close_and_single(spark):
    found = M.trades(kills(spark, (1, 10.0, 1, 5, "kill"), (1, 10.8, 5, 1, "kill"), (1, 30.0, 1, 6, "kill"), (1, 31.5, 6, 1, "kill"), (1, 40.0, 2, 2, "suicide"), (1, 50.0, 1, 2, "kill"))).collect()
    assert [(r["ta"], r["tb"]) for r in found] == [(10.0, 10.8)]


def test_revenge_needs_a_team_mate_time_and_place(spark):
    where = spots(spark, (5, 10.0, 0.5, 0.5), (1, 10.0, 0.5, 0.5), (1, 14.0, 0.5, 0.5), (2, 20.0, 0.0, 0.0), (6, 22.0, 1.0, 1.0))
    found = M.revenges(kills(spark, (1, 10.0, 1, 5, "kill"), (1, 14.0, 6, 1, "kill"), (1, 20.0, 7, 2, "kill"), (1, 26.0, 3, 7, "kill")), where).collect()
    assert [(r["victim_slot"], r["other_slot"], r["dt"]) for r in found] == [(1, 5, 4.0)]
    assert M.kill_links(kills(spark, (1, 10.0, 1, 5, "kill"), (1, 10.5, 5, 1, "kill")), where).count() == 2


def test_kills_and_deaths_skip_suicides(spark):
    lives = spark.createDataFrame([(1, 1, "death", 5, "kill"), (1, 5, "death", 5, "suicide"), (1, 2, "end", None, None), (1, 6, "death", None, None)], "game_id long, slot int, ended string, killer_slot int, kill_kind string")
    assert {(r["slot"], r["kills"], r["deaths"]) for r in M.kills_and_deaths(lives).collect()} == {(1, 0, 1), (5, 1, 1), (6, 0, 1)}


def test_life_at_includes_its_ends(spark):
    lives = spark.createDataFrame([(1, 1, 0, 0.0, 10.0), (1, 1, 1, 25.0, 130.0)], "game_id long, slot int, idx int, t0 double, t1 double")
    points = spark.createDataFrame([(1, 1, 10.0), (1, 1, 11.0), (1, 1, 130.0)], "game_id long, slot int, t double")
    assert sorted(r["idx"] for r in M.life_at(points, lives).collect()) == [0, 1]


def test_owners_and_captures(spark):
    rows = [(1, "B", 0.0, 10.0, "none"), (1, "B", 11.0, 20.0, "A"), (1, "B", 20.0, 60.0, "none"), (1, "B", 60.0, 61.0, "B"), (1, "B", 70.0, 90.0, "B")]
    owners = spark.createDataFrame(rows, "game_id long, point string, t0 double, t1 double, owner string")
    assert [(r["t0"], r["t1"], r["owner"]) for r in M.owner_timeline(owners).orderBy("t0").collect()] == [(11.0, 50.0, "A"), (70.0, 90.0, "B")]
    assert [(r["t"], r["team"]) for r in M.captures(owners).orderBy("t").collect()] == [(11.0, "A"), (60.0, "B")]


def test_gadget_use_by_life(spark):
    states = spark.createDataFrame([(1, 1, 0.0, 20.0, "g", "ready"), (1, 1, 20.0, 25.0, "g", "used"), (1, 1, 25.0, 26.0, "g", "unknown"), (1, 1, 26.0, 27.0, "g", "used"), (1, 1, 27.0, 40.0, "g", "ready")], "game_id long, slot int, t0 double, t1 double, gadget string, state string")
    lives = spark.createDataFrame([(1, 1, 0, 0.0, 40.0, "death")], "game_id long, slot int, idx int, t0 double, t1 double, ended string")
    (row,) = M.gadget_use(states, lives, spark.createDataFrame([("g", 30.0)], "gadget string, delay double")).collect()
    assert (row["uses"], row["first_use"], row["ready_s"], row["used_s"], row["unused_at_death"], row["possible"]) == (1, 20.0, 33.0, 6.0, True, 2)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "lives")
    df = lambda *rows: spark.createDataFrame(list(rows), "game_id long, v string, rev int")
    sinks.replace_games(df((1, "a", 1), (2, "b", 1)), path)
    sinks.replace_games(df((2, "c", 2)), path)
    assert {(r["game_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    assert {r["v"] for r in sinks.upsert(df((1, "old", 3), (2, "x", 1)), df((1, "new", 3), (2, "y", 0)), ["game_id"], "rev").collect()} == {"new", "x"}
    assert {r["v"] for r in sinks.insert_or_ignore(df((1, "a", 1)), df((1, "z", 1), (3, "q", 2), (3, "p", 1)), ["game_id"], "rev").collect()} == {"a", "p"}
    uid = spark.range(1).select(sinks.game_uid(F.lit("v.mp4"), F.lit(100.4), F.lit(2.5)).alias("u")).first()["u"]
    assert len(uid) == 10 and uid == spark.range(1).select(sinks.game_uid(F.lit("v.mp4"), F.lit(99.9), F.lit(2.2)).alias("u")).first()["u"]
    bundles = sinks.changed_bundles(df((1, "a", 1), (1, "b", 2)).withColumnRenamed("game_id", "game_uid"), spark.createDataFrame([], "game_uid long, digest string"))
    known = bundles.select("game_uid", "digest")
    assert bundles.count() == 1 and sinks.changed_bundles(df((1, "b", 2), (1, "a", 1)).withColumnRenamed("game_id", "game_uid"), known).count() == 0


def test_verdicts_follow_moved_episodes(spark):
    schema = "game_id long, kind string, point string, team string, t0 double, verdict string"
    new = spark.createDataFrame([(1, "retake", "B", "A", 10.0, None), (1, "retake", "B", "A", 40.0, None)], schema)
    old = spark.createDataFrame([(1, "retake", "B", "A", 12.5, "ko"), (1, "retake", "C", "A", 40.0, "ok")], schema)
    assert [r["verdict"] for r in sinks.keep_verdicts(new, old).orderBy("t0").collect()] == ["ko", None]


def test_verdicts_of_null_points_and_of_families(spark):
    schema = "game_id long, kind string, point string, team string, t0 double, outcome string, verdict string"
    new = spark.createDataFrame([(1, "k", None, "A", 10.0, "series_3", None), (1, "k", None, "A", 11.0, "lost", None), (1, "k", None, "A", 12.0, "series_2", None), (1, "k", "B", None, 50.0, None, None)], schema)
    old = spark.createDataFrame([(1, "k", None, "A", 11.5, "series_4", "ko"), (1, "k", None, "A", 9.5, "series_4", "ok"), (1, "k", "B", None, 50.5, "lost", "ok"), (1, "k", None, "A", 11.0, "lost", None)], schema)
    # one old row serves every new one within reach, the earliest first; a series never serves another episode
    assert [r["verdict"] for r in sinks.keep_verdicts(new, old).orderBy("t0").collect()] == ["ok", None, "ok", "ok"]


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "games": make([(1, "The Cliff", "Équipe Éclair", "Loups"), (2, "The Cliff", "equipe  eclair", "Ours"), (3, "Bay", "Loups", None)], "id long, map string, team_a string, team_b string"),
        "players": make([(1, 1, "Ana"), (2, 1, "ANA"), (1, 5, "Bo1")], "game_id long, slot int, name string"),
        "player_game_stats": make([(1, 1, 4, 2, 100.0, 50.0, 2.0, 1, 3), (2, 1, 2, 0, 50.0, None, 4.0, 2, None), (1, 5, 1, 1, 10.0, 5.0, None, None, 1)],
                                  "game_id long, slot int, kills int, deaths int, alive_s double, dist_m double, v_mean double, gadget_uses int, gadget_possible int"),
        "episodes": make([(1, 1, "retake", "A", 5.0, "success", None, '{"wave":{"speed":"fast","size":3}}'), (2, 1, "retake", "A", 9.0, "fail", "ko", '{"wave":{"speed":"fast","size":3}}'), (3, 1, "retake", "A", 12.0, "fail", "ok", "{bad"),
                          (4, 2, "retake", "A", 1.0, "fail", None, '{"wave":{"speed":"slow","size":2}}')], "id long, game_id long, kind string, team string, t0 double, outcome string, verdict string, data string"),
        "point_active": make([(1, "A", 0.0), (1, "B", 5.0), (1, "B", 9.0), (2, "A", 0.0)], "game_id long, point string, t0 double"),
        "lives": make([(1, 1, 0, "death", 5, 0.5, 0.5), (1, 5, 0, "death", None, 1.0, 0.0), (1, 2, 0, "end", None, None, None)], "game_id long, slot int, idx int, ended string, killer_slot int, x1 double, y1 double"),
        "kill_scores": make([(1, 3.0, 5, 1, 1.5, None, '["trade"]'), (1, 4.0, None, 5, 1.0, -0.5, "[bad")], "game_id long, t double, killer_slot int, victim_slot int, impact double, death_impact double, reasons string"),
        "player_ratings": make([(1, 2, 5.0, 6.0, 5.5)], "game_id long, slot int, individual double, teamplay double, overall double"),
        "capture_state": make([(1, 1.0, "score_A", 10.0), (1, 9.0, "score_A", 80.0), (2, 9.0, "score_A", 40.0), (1, 9.0, "B", 99.0)], "game_id long, t double, point string, pct double"),
        "scoreboard": make([(1, 1, 4.0, 2.5, None, 100.0, "Ana", "auto")], "game_id long, slot int, kills double, deaths double, assists double, score double, name_read string, source string"),
        "samples": make([(1, 1, t / 10, 0.5, 1.0, True) for t in range(5)] + [(1, 2, 0.0, None, None, True)], "game_id long, slot int, t double, x double, y double, alive boolean"),
    }


def test_summaries(tables):
    (ana, bo) = routes.players_summary(tables).collect()
    assert (ana["identity"], ana["name"], ana["games"], ana["kills"], ana["kd"], ana["v_mean"], ana["dist_m"]) == ("ana", "Ana", 2, 6, 3.0, 2.667, 50.0)
    assert bo["identity"] == "801"
    assert routes.players_summary(tables, "bay").count() == 0
    found = {r["key"]: r for r in routes.teams_summary(tables).collect()}
    assert found["equipe eclair"]["games"] == 2 and found["equipe eclair"]["kd"] == 3.0 and found["equipe eclair"]["capture"] == 60.0 and found["loups"]["games"] == 2
    team = {r["key"]: r for r in routes.team_summary(tables, "The Cliff").collect()}["equipe eclair"]
    assert (team["games"], team["waves"], team["decided"], team["rate"], team["outcomes"]) == (2, 2, 2, 0.5, {"success": 1, "fail": 1})
    (a, b) = routes.game_summary(tables, 1).collect()
    assert (a["kills"], a["waves"], a["rate"], a["changes"], a["gadget_possible"]) == (4, 1, 1.0, 1, 3) and b["gadget_uses"] is None


def test_routes(tables):
    assert [(r["slot"], r["impact"], r["death_impact"], r["overall"]) for r in routes.player_stats(tables, 1).collect()] == [(1, None, -1.5, None), (2, None, None, 5.5), (5, 1.5, -0.5, None)]
    assert [r["reasons"] for r in routes.kill_scores(tables, 1).collect()] == [["trade"], None]
    assert [(r["kills"], r["deaths"]) for r in routes.scoreboard(tables, 1).collect()] == [(4, None)]
    assert [(r["ix"], r["iy"], r["seconds"]) for r in routes.presence(tables, "The Cliff").collect()] == [(16, 31, 0.5)]
    assert {(r["what"], r["team"], r["ix"], r["iy"]) for r in routes.global_summary(tables, "The Cliff").collect()} == {("death", "A", 16, 16), ("kill", "B", 16, 16), ("death", "B", 31, 0)}
    assert [(r["key"], r["games"]) for r in routes.teams(tables).collect()] == [("equipe eclair", 2), ("loups", 2), ("ours", 1)]
    assert [r["id"] for r in routes.episodes(tables, map_name="The Cliff", kind="retake", team="A").collect()] == [1, 2, 3, 4]
    assert [r["verdict"] for r in routes.set_verdict(tables, 1, "ok").orderBy("id").collect()][0] == "ok"
    for bad in (lambda: routes.episodes(tables), lambda: routes.set_verdict(tables, 1, "x"), lambda: routes.games_of(tables, ids=list(range(201)))):
        with pytest.raises(ValueError):
            bad()
