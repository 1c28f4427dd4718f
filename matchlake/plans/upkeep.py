"""Filters, classes, formats and writes: kills that count, outcomes, labels for reading, rows kept and replaced."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.operators import aggregates as A
from matchlake.operators import match as M
from matchlake.operators.rotations import RotationLimits
from matchlake.operators.rotations import leave_phase as phase_of
from matchlake.operators.waves import classify
from matchlake.plans.registry import query
from matchlake.plans.statistics import _KILLS, kills_of
from matchlake.scratch import fresh_path
from matchlake.sources import sinks
from matchlake.sources.match_view import samples
from matchlake.sources.tables import table


def _kinded(spark, d):
    """Kills with a kind, some of them own doing or the map's."""
    kind = F.when(F.col("event_id") % 11 == 0, "suicide").when(F.col("event_id") % 7 == 0, "inferred").otherwise("kill")
    killer = F.when(F.col("event_id") % 11 == 0, F.col("victim")).otherwise(F.col("killer"))
    return kills_of(samples(spark, d)).select("game_id", "t", "event_id", killer.alias("killer_slot"), F.col("victim").alias("victim_slot"), kind.alias("kind"))


_KINDED = f"""{_KILLS}, kk AS (SELECT game_id, t, event_id, CASE WHEN event_id % 11 = 0 THEN victim ELSE killer END AS killer_slot, victim AS victim_slot,
  CASE WHEN event_id % 11 = 0 THEN 'suicide' WHEN event_id % 7 = 0 THEN 'inferred' ELSE 'kill' END AS kind FROM kills)"""


@query("valid_kills", f"""{_KINDED} SELECT event_id, killer_slot, victim_slot, kind IN ('kill', 'inferred') AS counted FROM kk WHERE killer_slot IS NOT NULL AND killer_slot <> victim_slot AND (killer_slot <= 4) <> (victim_slot <= 4)""")
def valid_kills(spark, d):
    """Kills by a known opponent, and whether their kind counts as well."""
    kills = _kinded(spark, d)
    counted = M.valid_kills(kills).select("event_id", F.lit(True).alias("counted"))
    return M.valid_kills(kills, None).join(counted, "event_id", "left").select("event_id", "killer_slot", "victim_slot", F.coalesce("counted", F.lit(False)).alias("counted"))


@query("kills_and_deaths", f"""{_KINDED}, made AS (SELECT game_id, killer_slot AS slot, count(*) AS kills FROM kk WHERE (killer_slot <= 4) <> (victim_slot <= 4) AND kind NOT IN ('suicide', 'environment') GROUP BY ALL),
  died AS (SELECT game_id, victim_slot AS slot, count(*) AS deaths FROM kk GROUP BY ALL)
SELECT game_id, slot, coalesce(kills, 0) AS kills, coalesce(deaths, 0) AS deaths FROM made FULL JOIN died USING (game_id, slot)""")
def kills_and_deaths(spark, d):
    ended = _kinded(spark, d).select("game_id", F.col("victim_slot").alias("slot"), "killer_slot", F.lit("death").alias("ended"), F.col("kind").alias("kill_kind"))
    return M.kills_and_deaths(ended)


_WAVES = """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 9 = 0 THEN 'ko' END AS verdict, o_orderkey % 4 > 0 AS has_wave,
  CASE WHEN o_totalprice > 250000 THEN CASE WHEN o_custkey % 2 = 0 THEN 'initial' ELSE 'success' END WHEN o_custkey % 5 = 0 THEN 'defense' WHEN o_orderstatus = 'P' THEN 'no_contact' WHEN o_custkey % 7 = 0 THEN 'duel'
    WHEN o_orderstatus = 'F' THEN 'won_no_capture' WHEN o_totalprice < 100000 THEN CASE WHEN o_custkey % 2 = 0 THEN 'initial_lost' ELSE 'fail' END ELSE 'undecided' END AS outcome FROM orders"""


def _waves(spark, d):
    """Waves of a team A, told by orders."""
    neutral = F.col("o_custkey") % 2 == 0
    holder = F.when(F.col("o_custkey") % 5 == 0, "A").when(~neutral, "B")
    kind = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_custkey") % 7 == 0, "duel").otherwise("teamfight")
    outcome = classify(F.lit("A"), holder, F.col("o_totalprice") > 250_000, F.when(~neutral, "B"), kind, F.when(F.col("o_orderstatus") == "F", "A"), F.when(F.col("o_totalprice") < 100_000, 2).otherwise(1))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, "ko").alias("verdict"), (F.col("o_orderkey") % 4 > 0).alias("has_wave"), outcome.alias("outcome"))


@query("outcome_classes", f"SELECT o_orderkey, outcome FROM ({_WAVES})")
def outcome_classes(spark, d):
    return _waves(spark, d).select("o_orderkey", "outcome")


@query("wave_tally", f"""SELECT o_orderpriority, count(*) AS waves, (SELECT string_agg(outcome || '=' || n, ',' ORDER BY outcome) FROM (SELECT outcome, count(*) AS n FROM ({_WAVES}) v WHERE coalesce(v.verdict, '') <> 'ko' AND v.has_wave AND v.o_orderpriority = w.o_orderpriority GROUP BY outcome)) AS outcomes,
  count(*) FILTER (outcome IN ('success', 'fail', 'won_no_capture')) AS decided, round(count(*) FILTER (outcome = 'success') / nullif(count(*) FILTER (outcome IN ('success', 'fail', 'won_no_capture')), 0), 3) AS rate
FROM ({_WAVES}) w WHERE coalesce(verdict, '') <> 'ko' AND has_wave GROUP BY o_orderpriority""")
def wave_tally(spark, d):
    tally = M.wave_tally(_waves(spark, d), ["o_orderpriority"])
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("outcomes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return tally.withColumn("outcomes", listed)


@query("leave_phase", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'never' WHEN l_linestatus = 'O' THEN 'stays' WHEN datediff('day', l_shipdate, o_orderdate) < -60 THEN 'before' WHEN datediff('day', l_shipdate, o_orderdate) <= -20 THEN 'at_change' ELSE 'after' END AS phase FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def leave_phase(spark, d):
    """When a team leaves the old point, seen from the change."""
    off = F.datediff("o_orderdate", "l_shipdate")
    phase = phase_of(F.col("l_returnflag") != "N", F.col("l_linestatus") == "O", off, RotationLimits(early=60, late=-20))
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", phase.alias("phase"))


@query("rounding_families", "SELECT event_id, floor(h / 8.0 + 0.5) AS half_up, round_even(h / 8.0, 0) AS half_even, round(h / 8.0) AS half_away FROM (SELECT event_id, CAST(floor(value) AS BIGINT) - 40 AS h FROM events)")
def rounding_families(spark, d):
    """Halves towards plus infinity, to the even number and away from zero, on numbers that binary fractions hold exactly."""
    x = (F.floor("value") - 40) / F.lit(8.0)
    return table(spark, d, "events").select("event_id", F.floor(x + 0.5).cast("double").alias("half_up"), F.rint(x).alias("half_even"), F.round(x).alias("half_away"))


@query("byte_labels", """SELECT o_orderkey, CASE WHEN u = 0 OR v >= 100 THEN printf('%d', CAST(floor(v + 0.5) AS BIGINT)) ELSE replace(printf('%.1f', floor(v * 10 + 0.5) / 10), '.', ',') END || ' ' || ['B', 'kB', 'MB', 'GB'][u + 1] AS label
FROM (SELECT o_orderkey, u, b / pow(1000, u) AS v FROM (SELECT o_orderkey, b, CASE WHEN b >= 1000000000 THEN 3 WHEN b >= 1000000 THEN 2 WHEN b >= 1000 THEN 1 ELSE 0 END AS u FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_custkey AS b FROM orders)))""")
def byte_labels(spark, d):
    """Sizes in units of a thousand: whole from 100 on, else one decimal after a comma."""
    b = F.col("o_orderkey").cast("long") * F.col("o_custkey")
    u = F.when(b >= 10**9, 3).when(b >= 10**6, 2).when(b >= 10**3, 1).otherwise(0)
    sized = table(spark, d, "orders").select("o_orderkey", u.alias("u"), (b / F.pow(F.lit(1000.0), u)).alias("v"))
    whole = F.format_string("%d", F.floor(F.col("v") + 0.5))
    tenth = F.translate(F.format_string("%.1f", F.floor(F.col("v") * 10 + 0.5) / 10), ".", ",")
    return sized.select("o_orderkey", F.concat_ws(" ", F.when((F.col("u") == 0) | (F.col("v") >= 100), whole).otherwise(tenth), F.array(*map(F.lit, ("B", "kB", "MB", "GB")))[F.col("u")]).alias("label"))


@query("open_comments", """SELECT o_custkey, string_agg('- [' || o_orderpriority || '] ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS body, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def open_comments(spark, d):
    """What is not settled, as a list in Markdown by customer."""
    line = F.concat(F.lit("- ["), "o_orderpriority", F.lit("] "), "o_orderkey")
    lines = table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("lines"))
    return lines.select("o_custkey", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"), F.size("lines").cast("long").alias("n"))


@query("side_totals", """SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus <> 'P') AS shown, CASE WHEN count(*) FILTER (o_orderpriority = '5-LOW') = 0 THEN round(sum(o_totalprice), 2) END AS complete FROM orders GROUP BY o_custkey""")
def side_totals(spark, d):
    """A total that is null until something is seen, and one that is null where any part is missing."""
    part = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("shown"), F.when(F.count(part) == F.count("*"), F.round(F.sum(part), 2)).alias("complete"))


@query("followed_scope", """SELECT o_orderkey, CASE WHEN c_nationkey < 8 AND s_hit THEN 'both' WHEN c_nationkey < 8 THEN 'A' ELSE 'B' END AS sides FROM (SELECT o_orderkey, c_nationkey, bool_or(s_nationkey < 8) AS s_hit FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) WHERE c_nationkey < 8 OR s_hit""")
def followed_scope(spark, d):
    """The games a followed set takes part in, and on which sides."""
    followed = F.col("s_nationkey") < 8
    suppliers = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(followed).alias("hit"))
    customers = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", (F.col("c_nationkey") < 8).alias("own"))
    return customers.join(suppliers, "o_orderkey").where("own OR hit").select("o_orderkey", F.when(F.col("own") & F.col("hit"), "both").when(F.col("own"), "A").otherwise("B").alias("sides"))


@query("storage_by_game", ", p AS (SELECT 1) SELECT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS game_id, event_type AS module, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes, round(sum(strlen(props)) / count(DISTINCT user_id), 4) AS per_player FROM events GROUP BY ALL")
def storage_by_game(spark, d):
    """Rows and bytes a module holds of each game."""
    size = F.sum(F.octet_length("props"))
    return (table(spark, d, "events").groupBy(F.unix_date(F.to_date("ts")).alias("game_id"), F.col("event_type").alias("module"))
            .agg(F.count("*").alias("n"), size.alias("bytes"), F.round(size / F.count_distinct("user_id"), 4).alias("per_player")))


@query("control_counts", f"""{_KINDED} SELECT game_id, count(*) AS ends, count(killer_slot) AS known, count(*) FILTER (kind = 'inferred') AS inferred, round(count(killer_slot) / count(*), 4) AS coverage, max(t) - min(t) AS span FROM kk GROUP BY game_id""")
def control_counts(spark, d):
    return _kinded(spark, d).groupBy("game_id").agg(F.count("*").alias("ends"), F.count("killer_slot").alias("known"), F.count_if(F.col("kind") == "inferred").alias("inferred"), A.rounded(F.count("killer_slot") / F.count("*"), 4).alias("coverage"), (F.max("t") - F.min("t")).alias("span"))


_CHANGES = "cur AS (SELECT c_custkey AS k, c_acctbal AS v, 1 AS rev FROM customer WHERE c_custkey % 3 <> 0), ch AS (SELECT c_custkey AS k, c_acctbal + 1 AS v, CAST(c_custkey % 3 AS INT) AS rev FROM customer WHERE c_custkey % 2 = 0)"


def _changes(spark, d):
    c = table(spark, d, "customer")
    current = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).alias("rev"))
    return current, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"), (F.col("c_custkey") % 3).cast("int").alias("rev"))


@query("upserted_rows", f"WITH {_CHANGES} SELECT k, round(CASE WHEN ch.k IS NOT NULL AND ch.rev >= coalesce(cur.rev, ch.rev) THEN ch.v ELSE cur.v END, 2) AS v FROM cur FULL JOIN ch USING (k)")
def upserted_rows(spark, d):
    return sinks.upsert(*_changes(spark, d), ["k"], "rev").select("k", F.round("v", 2).alias("v"))


@query("first_wins_rows", f"WITH {_CHANGES} SELECT k, round(coalesce(cur.v, ch.v), 2) AS v FROM cur FULL JOIN ch USING (k)")
def first_wins_rows(spark, d):
    return sinks.insert_or_ignore(*_changes(spark, d), ["k"], "rev").select("k", F.round("v", 2).alias("v"))


@query("game_uids", "SELECT o_orderkey, left(sha1('game' || o_custkey || '|' || CAST(round_even(o_totalprice, 0) AS BIGINT) || '|' || CAST(round_even(o_totalprice / 100, 0) AS BIGINT)), 10) AS uid FROM orders")
def game_uids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sinks.game_uid(F.concat(F.lit("game"), "o_custkey"), F.col("o_totalprice"), F.col("o_totalprice") / 100).alias("uid"))


_EPISODES = """, ep AS (SELECT event_id, game_id, 'wave' AS kind, CASE WHEN slot % 3 > 0 THEN CAST(slot % 3 AS VARCHAR) END AS point, team, t AS t0, CASE WHEN event_id % 4 = 0 THEN 'series_' || team ELSE 'won' END AS outcome FROM ev WHERE kind = 'click'),
  old AS (SELECT game_id, point, team, t0 + 200 AS t0, starts_with(outcome, 'series_') AS fam, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'ko' END AS verdict FROM ep WHERE event_id % 5 < 3)"""


@query("verdicts_kept", f"""{_EPISODES} SELECT event_id, (SELECT arg_min(verdict, (old.t0, verdict)) FROM old WHERE old.game_id = ep.game_id AND old.point IS NOT DISTINCT FROM ep.point AND old.team = ep.team AND old.fam = starts_with(ep.outcome, 'series_') AND abs(old.t0 - ep.t0) <= 900) AS verdict FROM ep""")
def verdicts_kept(spark, d):
    """Episodes computed anew, with the verdicts given to those they stand for."""
    point = F.when(F.col("slot") % 3 > 0, (F.col("slot") % 3).cast("string"))
    outcome = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("series_"), "team")).otherwise("won")
    new = samples(spark, d).where("kind = 'click'").select("event_id", "game_id", F.lit("wave").alias("kind"), point.alias("point"), "team", F.col("t").alias("t0"), outcome.alias("outcome"))
    old = new.where("event_id % 5 < 3").withColumn("t0", F.col("t0") + 200).withColumn("verdict", F.when(F.col("event_id") % 2 == 0, "ok").otherwise("ko")).drop("event_id")
    return sinks.keep_verdicts(new, old, 900.0).select("event_id", "verdict")


@query("replaced_games", """, r AS (SELECT 1) SELECT game_id, slot, count(*) AS n, CAST(sum(CASE WHEN game_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS revision FROM ev WHERE game_id % 3 > 0 OR alive GROUP BY ALL""")
def replaced_games(spark, d):
    """All rows of a game that was computed again give way to its new ones; other games stay."""
    ev, path = samples(spark, d).select("slot", "alive", "game_id"), fresh_path(spark, "replaced")
    sinks.replace_games(ev.withColumn("rev", F.lit(1)).select("slot", "rev", "game_id"), path)
    sinks.replace_games(ev.where("game_id % 3 = 0 AND alive").withColumn("rev", F.lit(2)).select("slot", "rev", "game_id"), path)
    return spark.read.parquet(path).groupBy("game_id", "slot").agg(F.count("*").alias("n"), F.sum("rev").alias("revision"))


@query("players_of_followed", """, g AS (SELECT game_id, team, count(DISTINCT slot) AS present, count(*) FILTER (alive) AS rows_alive FROM ev GROUP BY ALL) SELECT team, present, count(*) AS games, CAST(sum(rows_alive) AS BIGINT) AS seen FROM g GROUP BY ALL""")
def players_of_followed(spark, d):
    """In how many games a team stood with how many of its players."""
    present = samples(spark, d).groupBy("game_id", "team").agg(F.count_distinct("slot").alias("present"), F.count_if("alive").alias("rows_alive"))
    return present.groupBy("team", "present").agg(F.count("*").alias("games"), F.sum("rows_alive").alias("seen"))
