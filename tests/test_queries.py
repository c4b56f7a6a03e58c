"""Every query of the reference's operators against its oracle, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from karst.plans import surveys as plans

DIR = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "events", "part", "documents")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(df):
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_its_oracle(spark, con, name):
    got, want = plans.queries()[name](spark, DIR).toPandas(), con.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracle_sql().keys()))
def test_runs(spark, con, name):
    assert plans.queries()[name](spark, DIR).columns
