"""Queries register here with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The match view of `events` in DuckDB SQL.
EV = """ev AS (SELECT event_id, CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS game_id, CAST(user_id % 8 + 1 AS INT) AS slot,
    CASE WHEN user_id % 8 + 1 <= 4 THEN 'A' ELSE 'B' END AS team, (epoch_us(ts) % 86400000000) / 1e6 AS t,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 100 AS x, (floor(value * 100) % 100) / 100.0 AS y,
    event_type <> 'error' AS alive, event_type AS kind, value FROM events)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {EV} {sql}" if sql.lstrip().startswith(",") else sql
        return f
    return add
