"""Every query can tell right from wrong: no label it returns is the same in all rows."""

import os

import pytest

from cohortlab.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Columns that are true of all rows by intention.
SAME = {("trace_content", "explained")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_no_label_is_constant():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    constant = []
    for name, sql in catalog.ORACLES.items():
        rows = con.execute(sql).df()
        labels = [c for c in rows.columns if str(rows[c].dtype) in ("bool", "boolean", "object", "str")]
        constant += [(name, c) for c in labels if len(rows) > 2 and rows[c].astype(str).nunique() < 2]
    assert set(constant) == SAME
