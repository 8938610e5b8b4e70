import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
