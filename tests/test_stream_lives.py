"""Streamed lives equal those of all rows at once, whatever the batches; the state goes when a player is gone."""

import random

import pandas as pd
from pyspark.sql import functions as F

from matchlake.operators import stateful
from matchlake.streaming import incremental as I
from matchlake.streaming.lives import live_lives

START = 1_700_000_000


def rows_of(seed):
    """Two games of two slots with deaths, gaps, kills and dead rows, 0.2 s apart."""
    rng, rows = random.Random(seed), []
    for game in (1, 2):
        for slot in (1, 5):
            t = START + (game - 1) * 4000 + rng.random()
            for _ in range(6):
                for _ in range(rng.randrange(5, 60)):
                    rows.append((game, slot, t, True, False))
                    t += 0.2
                if rng.random() < 0.5:
                    rows.append((game, slot, t + rng.random(), False, True))
                pause = rng.choice([0.6, 1.5, 5.0, 13.0, 20.0])
                if rng.random() < 0.5:
                    rows += [(game, slot, t + 0.5 * i, False, False) for i in range(1, int(pause / 0.5))]
                t += pause
    return sorted(rows, key=lambda r: r[2])


def at_once(rows):
    frame = pd.DataFrame(rows, columns=["game_id", "slot", "t", "alive", "killed"])
    parts = [stateful.lives(own, own[own["killed"]]) for _, own in frame.groupby(["game_id", "slot"])]
    return sorted((int(g), int(s), int(i), round(a, 3), round(b, 3), e) for p in parts for g, s, i, a, b, e in p.itertuples(index=False))


def test_streamed_lives_equal_those_at_once(spark, tmp_path):
    rows = rows_of(4)
    folder = f"{tmp_path}/in"
    schema = "game_id int, slot int, t double, alive boolean, killed boolean"
    # rows come in small files, somewhat out of order, and then a row of another game long after
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r[2] + rng.random() * 3)
    parts = [order[i:i + 60] for i in range(0, len(order), 60)] + [[(9, 1, START + 20_000.0, True, False)], [(9, 1, START + 20_000.2, True, False)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{i:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/*").withColumn("at", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    found = I.drain(live_lives(stream, late="10 seconds", over=600.0), "append", ["game_id", "slot", "idx"])
    streamed = sorted((r["game_id"], r["slot"], r["idx"], round(r["t0"], 3), round(r["t1"], 3), r["ended"]) for r in found.collect())
    assert streamed == at_once(rows)
    assert {e for *_, e in streamed} == {"death", "end"}


def test_lives_go_on_from_a_death_before():
    rows = pd.DataFrame({"game_id": 1, "slot": 2, "t": [5.0, 5.2, 20.0, 20.2], "alive": True})
    found = stateful.lives(rows, since=0.0, first=3)
    assert [tuple(r) for r in found[["idx", "t0", "t1", "ended"]].itertuples(index=False)] == [(3, 20.0, 20.2, "end")]
