"""Rows that share a moment, spans without length, and long stretches, as the SQL of the queries has them."""

import datetime as dt
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from matchlake.operators import aggregates as A
from matchlake.operators import joins as J
from matchlake.operators import series as S
from matchlake.plans.catalogue import ORACLES, QUERIES
from test_catalogue import rows

# two copies of a day, of which the second has other users at the same moments
KINDS = ["purchase", "error", "click", "signup", "view", "error", "purchase", "click"]
DAY = [(i, dt.datetime(2024, 1, 1, 1, 0, 0) + dt.timedelta(seconds=97 * (i // 2)), 3 * i + 4 * (i % 2), KINDS[(i // 3) % 8], float(i % 7) * 5, '{"k": %d}' % (i * 13 % 100)) for i in range(120)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ties"))
    spark.createDataFrame(DAY, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["kd_ratio_null_safe", "control_counts", "deaths_in_window", "mutual_pairs_band_join", "avenge_band_spatial_join", "role_swap_explode", "kills_and_deaths", "kill_near_use", "owner_forward_fill", "replaced_overlaps",
                                  "route_team_summary", "route_players_summary", "route_teams_summary", "route_global_summary"])
def test_ties_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_long_stretches_take_linear_time(spark):
    """One stretch of 120,000 rows; a frame open at its end would be read 7e9 times."""
    spans = spark.range(120_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.when(F.col("id") % 60_000 == 0, F.col("id").cast("double")).alias("v"))
    known = spans.where("v IS NOT NULL").select("k", "t", "v")
    began = time.time()
    filled = S.linear_fill(spans, ["k"], ["t"], "v", "t", 1e9, "f").agg(F.count("f"), F.sum("f")).first()
    met = J.asof(spans.select("k", "t"), known, ["k"], "t", ["v"], None, "nearest").agg(F.min("found_t"), F.max("found_t"), F.count("v")).first()
    assert time.time() - began < 60
    assert tuple(filled) == (60_001, sum(range(60_001))) and tuple(met) == (0.0, 60_000.0, 120_000)


def test_killers_of_one_moment_are_avenged_one_by_one(spark, tmp_path):
    """Slots 6 and 7 share the moment before an elimination; of both, only slot 7 is eliminated within the hour."""
    at = dt.datetime(2024, 1, 1, 1, 0, 0)
    day = [(i, at + dt.timedelta(seconds=s), slot - 1, kind, 1.0, '{"k": 5}') for i, (s, slot, kind) in enumerate([(0, 6, "click"), (0, 7, "view"), (60, 1, "error"), (120, 7, "error"), (9000, 6, "error")])]
    spark.createDataFrame(day, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES["deaths_in_window"](spark, str(tmp_path)).toPandas()
    assert rows(found) == rows(con.execute(ORACLES["deaths_in_window"]).df())
    assert sorted(found[found["event_id"] == 2]["avenged"]) == [False, True]


def test_rounding_between_two_numbers_as_in_sql(spark):
    """Means and ratios of whole numbers, halfway between two numbers of so many digits, as the queries round them."""
    cases = [(n, d) for d in (8, 40, 80, 400, 1200, 2000, 20_000) for n in range(1, 2 * d, max(1, d // 400))]
    frame = spark.createDataFrame(cases, "a long, b long")
    found = frame.select("a", "b", A.ratio(F.col("a"), F.col("b")).alias("r3"), A.rounded(F.col("a") / F.col("b"), 2).alias("r2"), A.rounded(-F.col("a") / F.col("b"), 4).alias("r4")).toPandas()
    con = duckdb.connect()
    con.register("f", frame.toPandas())
    assert rows(found) == rows(con.execute("SELECT a, b, round(a / b, 3) AS r3, round(a / b, 2) AS r2, round(-a / b, 4) AS r4 FROM f").df())
    by_decimals = frame.where(F.round(F.col("a") / F.col("b"), 2) != A.rounded(F.col("a") / F.col("b"), 2))
    assert by_decimals.count() > 0


@pytest.mark.parametrize("name", ["route_global_summary"])
def test_first_row_of_a_moment_ends_a_life(spark, tmp_path, name):
    """A slot has two or three rows at each moment, the last of them an elimination elsewhere: its life ends where the first of them is."""
    at = dt.datetime(2024, 1, 1, 1, 0, 0)
    day = [(i, at + dt.timedelta(seconds=60 * (i // 6)), [2, 2, 2, 6, 6, 5][i % 6], ["view", "click", "error", "view", "error", "view"][i % 6], float(i * 7 % 100) / 100, '{"k": %d}' % (i * 37 % 100)) for i in range(120)]
    spark.createDataFrame(day, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLES[name]).df())
