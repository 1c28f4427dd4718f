"""Streaming queries, drained over the events table, with the batch result as their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.plans.episodes import _LIVES
from matchlake.plans.registry import query
from matchlake.scratch import fresh_path
from matchlake.streaming import incremental as I
from matchlake.streaming.lives import live_lives
from matchlake.streaming.progress import history, logged


@query("stream_dedup_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_dedup_window(spark, d):
    return I.drain(I.windowed_counts(I.events_stream(spark, d)), "update", ["start", "event_type"])


@query("stream_session", """SELECT min(ts) AS start, event_type, count(*) AS n FROM (SELECT *, sum(CASE WHEN since IS NULL OR since > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS run
FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS since FROM events)) GROUP BY event_type, run
HAVING max(ts) + INTERVAL 10 MINUTE + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def stream_session(spark, d):
    return I.drain(I.session_counts(I.events_stream(spark, d)), "append", ["start", "event_type"])


@query("stream_state", "SELECT user_id, count(*) FILTER (changed) AS changes, count(*) AS n FROM (SELECT *, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events) GROUP BY ALL")
def stream_state(spark, d):
    return I.drain(I.state_changes(I.events_stream(spark, d)), "update", ["user_id"])


_CERTAIN = f"""{_LIVES[:_LIVES.rindex('SELECT game_id, slot, CAST(row_number()')]}, lv AS ({_LIVES[_LIVES.rindex('SELECT game_id, slot, CAST(row_number()'):]}),
  wm AS (SELECT max(game_id * 86400 + t) - 3600 AS w FROM ev), sil AS (SELECT game_id, slot, max(game_id * 86400 + t) AS last FROM ev GROUP BY ALL)
SELECT lv.* FROM lv JOIN sil USING (game_id, slot), wm WHERE last + 7200 < w OR (last + 3600 < w AND ended = 'death' AND game_id * 86400 + t1 + 3600 <= w)"""


@query("stream_lives", _CERTAIN)
def stream_lives(spark, d):
    """The lives that the watermark has made certain."""
    slot = (F.col("user_id") % 8 + 1).cast("int")
    dead = F.col("event_type") == "error"
    rows = I.events_stream(spark, d).select(F.unix_date(F.to_date("ts")).alias("game_id"), slot.alias("slot"), "at", (~dead).alias("alive"), dead.alias("killed"))
    found = I.drain(live_lives(rows, "1 hour", gap=3600.0, respawn=1800.0, tail=900.0, near=600.0, over=7200.0), "append", ["game_id", "slot", "idx"])
    day = F.col("game_id") * F.lit(86_400.0)
    return found.select("game_id", "slot", "idx", F.round(F.col("t0") - day, 6).alias("t0"), F.round(F.col("t1") - day, 6).alias("t1"), "ended")


@query("job_log", "SELECT 'progress' AS event, event_type AS step, count(*) AS rows FROM events GROUP BY ALL UNION ALL SELECT 'done', '', count(*) FROM events")
def job_log(spark, d):
    """What a streamed job told while it ran, replayed from its log."""
    path = fresh_path(spark, "job-log")
    logged(I.events_stream(spark, d), path, fresh_path(spark, "job"), step="event_type")
    return history(spark, path).groupBy("event", "step").agg(F.sum("rows").alias("rows"))
