"""Every query with SQL equals it on the smallest tables, where they are at hand."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def cells(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].round(5) if df[c].dtype.kind == "f" else df[c].map(lambda x: None if x is None else str(x))
    return Counter(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    got, want = driver.queries()[name](spark, FOLDER).toPandas(), connection.execute(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_flagship(spark):
    assert driver.entry(spark).count() > 0
