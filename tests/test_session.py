"""Intermediate tables in a session that names no shared folder (in an interpreter of its own and without the machine's defaults)."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_materialize_without_a_checkpoint_folder(tmp_path):
    code = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        from cohortlab import session
        spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
                 .config("spark.sql.warehouse.dir", "{tmp_path}/house").getOrCreate())
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        assert sorted(r.id for r in session.materialize(spark.range(3)).collect()) == [0, 1, 2]
        folder = session.checkpoint_dir(spark)
        assert folder.endswith("/house/_steps"), folder
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        spark.stop()
    """)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert not list((tmp_path / "house" / "_steps").glob("cohortlab-*")), "tables go with the application"


def test_customers_are_dealt_to_all_tasks_of_a_shuffle(spark, tmp_path):
    from cohortlab.plans import standins

    rows = [(k, f"c{k}", k % 25, 10.0 * k, "BUILDING") for k in range(64)] + [(None, None, None, None, None)] * 3 + [(5, "again", 5, 1.0, None)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = standins.customer_rows(spark, str(tmp_path))
    parts = [len(p) for p in df.rdd.glom().collect()]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(parts) == len(rows) and min(parts) > 0
    assert sorted(r["case_id"] for r in df.collect() if r["case_id"] is not None) == sorted([*range(64), 5])
