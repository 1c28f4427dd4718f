"""Names, countdowns and the sequential rules."""

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matchlake.functions.text import similar
from matchlake.operators import names as N
from matchlake.operators import stateful as S
from matchlake.operators.timer import games_of_timer


def test_soft_distances():
    a, b = pd.Series(["XAV0", "AB", "ABC"]), pd.Series(["HAVO", "", "ABD"])
    table = N.soft_distances(a, b)
    assert [table[i, len(x), len(y)] for i, (x, y) in enumerate(zip(a, b, strict=True))] == [0.7, 2.0, 1.0]


def test_alike_pairs_lose_none(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("AB1C") for _ in range(rng.randrange(1, 14))) for _ in range(150)}
    for n in list(names)[:60]:
        at = rng.randrange(len(n))
        names |= {n[:at] + "X" + n[at + 1:], n[:at] + n[at + 1:] or "Q", n + "AB1", "Z" + n}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = N.alike_pairs(df, "name").where(similar(F.col("a"), F.col("b")))
    every = df.select(F.col("name").alias("a")).join(df.select(F.col("name").alias("b")), F.lit(True)).where(similar(F.col("a"), F.col("b")))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, every.collect()))


def test_closest_names(spark):
    roster = spark.createDataFrame([(1, 1, "Xavier"), (1, 2, "Solène"), (1, 5, "Solene2"), (2, 1, "Xavier")], "game_id long, slot int, name string")
    reads = spark.createDataFrame([(1, 1, "HAVIER"), (2, 1, "SOLENE"), (3, 1, "ab"), (4, 1, "nobody here"), (5, 9, "XAVIER")], "id long, game_id long, text string")
    found = {r["id"]: r["slot"] for r in N.closest_names(reads, roster).collect()}
    assert found[1] == 1 and found[3] is None and found[4] is None and found[5] is None and len(found) == 5
    team = spark.createDataFrame([(1, 1, "SOLENE2", "B")], "id long, game_id long, text string, team string")
    assert N.closest_names(team, roster).first()["slot"] == 5


def test_votes_and_banners(spark):
    rows = [(1, 1, float(i), x) for i, x in enumerate(["KALIME", "KAL1ME", "KALIME", "??", "ZORRO", None])]
    (row,) = N.voted_names(spark.createDataFrame(rows, "game_id long, slot int, t double, text string")).collect()
    assert (row["name"], row["share"]) == ("KALIME", 0.75)
    lines = spark.createDataFrame([(1, 10.0, 20.0, 5.0, "low one"), (1, 10.0, 20.0, 2.0, "top one"), (1, 90.0, 8.0, 1.0, "x1")], "frame int, x double, w double, y double, text string")
    assert [(r["banner"], r["text"]) for r in N.banner_lines(lines, 100.0).collect()] == [(0, "TOPONE")]


def test_votes_form_clusters_in_the_order_of_reading():
    assert N.vote(["MOONRIDER"] * 6 + ["MOOMR1DER"])[0] == "MOONRIDER"
    assert N.vote(["NORTHWIND", "NORTHWIND", "NORTWND"]) == ("NORTHWIND", 1.0)
    # a chain is cut where a reading is far from the cluster's name, whatever it is near to otherwise
    assert N.vote(["AAAAA", "AAAAB", "AAABB", "AABBB", "AAABB"]) == ("AAABB", 0.6)
    # the name moves with the votes, and then draws others
    assert N.vote(["ABCDEF", "ABCDEFGH", "ABCDEFGH", "ABCDEFGX"]) == ("ABCDEFGH", 1.0)
    assert N.vote(["ONE", "TWO"]) == ("ONE", 0.5)


def test_countdown_becomes_games(spark):
    first = [(t, 600) for t in range(5)] + [(4 + k, 600 - k) for k in range(1, 120)]
    first[60] = (first[60][0], 12)  # misread
    second = [(300 + k, 500 - k) for k in range(100)]
    frozen = [(600 + k, 300) for k in range(100)]
    df = spark.createDataFrame([(1, float(t), v) for t, v in [*first, (150, None), *second, *frozen]], "video_id int, t double, remaining int")
    a, b = games_of_timer(df).orderBy("start_s").collect()
    assert a["start_s"] == 3.5 and not a["estimated"] and a["readings"] == len(first) - 1
    assert b["start_s"] == 300.0 and b["estimated"] and b["end_s"] == 400.0


def test_flicker_settles():
    assert S.settled_labels(list("aaaabaaaa"), 0.5) == ["a"] * 9
    assert S.settled_labels(["u"] * 4 + ["amb"] * 2 + ["r"] * 4, 0.5) == ["u"] * 5 + ["r"] * 5
    assert S.settled_labels(["u"] * 4 + ["amb"] * 2 + ["dead"] * 4, 0.5) == ["u"] * 4 + ["amb"] * 2 + ["dead"] * 4
    assert S.settled_labels(list("aaabbbbaaa"), 0.5) == list("aaabbbbaaa")


def test_levels_follow_rides_and_zone():
    times = [float(i) / 10 for i in range(0, 100)]
    outside = [0.0 if t < 5 else 0.1 for t in times]
    assert S.level_spans(0.0, 9.9, times, outside, [True] * 100, [(2.0, "etage")]) == [(0.0, 2.0, "dessous", "default"), (2.0, 5.0, "etage", "tp"), (5.0, 9.9, "dessous", "zone")]
    assert S.level_spans(0.0, 9.9, times, outside, [False] * 100, [(0.0, "etage")]) == [(0.0, 9.9, "etage", "tp")]


def test_boxes_need_place_and_time():
    rows = pd.DataFrame([(float(t), 0.5 + 0.001 * (t % 3), 0.5) for t in range(30)] + [(float(t), 0.9, 0.9) for t in range(5)], columns=["t", "x", "y"])
    (box,) = S.tracked_boxes(rows).itertuples(index=False)
    assert (box.t0, box.t1, box.x, box.n) == (0.0, 29.0, 0.501, 30)


def test_recovery_after_the_plateau():
    hp = [1.0] * 5 + [0.5] * 10 + [0.52, 0.56, 0.7, 0.9, 1.0]
    (row,) = S.recoveries(pd.DataFrame({"t": [i / 10 for i in range(len(hp))], "hp": hp})).itertuples(index=False)
    assert (row.t_loss, row.plateau, row.t_start, row.why) == (0.8, 0.5, 1.5, "ok")
    hp[12] = None
    (row,) = S.recoveries(pd.DataFrame({"t": [i / 10 for i in range(len(hp))], "hp": hp})).itertuples(index=False)
    assert row.why == "gap"


def test_decimation_and_assignment():
    path = pd.DataFrame({"t": range(11), "x": np.linspace(0, 0.1, 11), "y": 0.0})
    assert S.decimated(path, 1.0)["t"].tolist() == [0, 4, 8, 10]
    assert S.best_assignment(np.array([[0.0, 1.0], [1.0, 0.0]])) == [0, 1] and S.best_assignment(np.array([[0.5, 0.5], [0.5, 0.5]])) is None


def test_foci_of_many_kills():
    """Foci equal those by all earlier kills, and a long series at few places takes no time of its square."""
    rng = np.random.default_rng(4)

    def frame(n):
        x, y = rng.integers(0, 12, n) / 12, rng.integers(0, 12, n) / 12
        x[rng.random(n) < 0.05] = np.nan
        return pd.DataFrame({"t": np.arange(n, dtype=float), "event_id": 0, "x": x, "y": y})

    small = frame(150)
    foci: list[list] = []
    for x, y, found in S.foci(small, 2.0)[["x", "y", "focus"]].itertuples(index=False):
        at = 0 if np.isnan(x) else next((i for i, m in enumerate(foci) if any(np.hypot((x - a) * 31.0, (y - b) * 16.5) <= 2.0 for a, b in m)), len(foci))
        foci += [] if at < len(foci) else [[]]
        if not np.isnan(x):
            foci[at].append((x, y))
        assert found == at
    began = time.time()
    assert len(S.foci(frame(40_000), 0.5)) == 40_000
    assert time.time() - began < 20
