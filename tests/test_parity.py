"""Every query of the engine against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from furlong.plans import feature_queries, model_queries, racing_queries

DATA = "/root/testdata/sf0.001"
ORACLES = feature_queries.ORACLES | racing_queries.ORACLES | model_queries.ORACLES
# Trained models without an oracle have tests of their own.
QUERIES = {k: q for k, q in (feature_queries.QUERIES | racing_queries.QUERIES | model_queries.QUERIES).items() if k in ORACLES or k not in model_queries.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
        assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "trainer_win_rate_90d" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
