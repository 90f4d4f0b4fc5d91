"""Every query with SQL gives DuckDB's rows at the smallest scale; the others run and give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from shapelake import more_queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = tidy(q.QUERIES[name](spark, DATA).toPandas()), tidy(duck.sql(q.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        if pd.api.types.is_float_dtype(theirs[c]):
            assert ((ours[c] - theirs[c]).abs().fillna(0) <= 2e-6 * (1 + theirs[c].abs().fillna(0))).all(), c
            assert (ours[c].isna() == theirs[c].isna()).all(), c
        else:
            assert ((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_rows(spark, name):
    assert q.QUERIES[name](spark, DATA).count() > 0
