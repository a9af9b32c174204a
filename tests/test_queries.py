"""Every registered query that has SQL gives DuckDB's rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

from weftgraph import context_queries, driver_queries, extraction_queries, plan_queries, registry_queries  # noqa: F401  (register their queries)
from weftgraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
