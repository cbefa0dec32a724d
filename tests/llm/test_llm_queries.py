"""Every training-data query that has SQL against it, on the smallest tables."""

import pandas as pd
import pytest

from cohortlab.llm import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def shown(df):
    df = df.convert_dtypes()
    return sorted(tuple("NULL" if v is None or v is pd.NA or v is pd.NaT else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and shown(got) == shown(want)
