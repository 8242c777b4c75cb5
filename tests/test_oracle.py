"""Every event query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from chronokey.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].astype(object).where(x[cols].notna(), None).map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for x in (a, b))
    key = lambda x: sorted(map(repr, x.itertuples(index=False, name=None)))
    assert key(a) == key(b)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        same(got, duck.sql(sql).df())
    else:
        assert len(got)
