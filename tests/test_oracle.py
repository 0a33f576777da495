"""Every query beside its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gridloom import queries as q

q.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    none = lambda v: v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v
    text = lambda v: None if none(v) else f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(text(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows_as_sql(spark, con, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), con.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs_without_sql(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
