"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others give some."""

import os

import duckdb
import pandas as pd
import pytest

from matchlake.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 6) if hasattr(value, "__float__") else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if "datetime" in str(frame[c].dtype):
            frame = frame.assign(**{c: frame[c].astype(str)})
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        wanted = duck.execute(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found)
