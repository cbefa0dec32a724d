"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from cohortlab.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def values(df):
    show = lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        want = db.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)
