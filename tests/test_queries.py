"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not re.match(r"op\d|pipeline", k)}


def rows(frame: pd.DataFrame):
    shown = lambda v: "" if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
