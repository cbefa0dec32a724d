"""Writers and the suite status table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

STATUS = ("name string, status string, summary string, metrics map<string,double>, "
          "warnings array<string>, missing_components array<string>, report_path string")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=None,
          rows_per_file: int = 5_000_000) -> None:
    """Write a result; files are kept at a readable size, partition folders optional."""
    writer = df.write.mode(mode).format(fmt).option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Write a table bucketed and sorted by the case key, so later joins need no shuffle; at ``path``, else in the warehouse."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def status(metrics: DataFrame, name: str, summary: str, needs: str, report_path: str | None = None) -> DataFrame:
    """One status row from a one-row metric table: pass, or unavailable when ``needs`` is 0 or null.

    ``metrics`` must be an ungrouped aggregate of DOUBLE columns.
    """
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in metrics.columns]),
                              F.array(*[F.col(c).cast("double") for c in metrics.columns]))
    ok = F.coalesce(F.col(needs), F.lit(0)) > 0
    return metrics.select(
        F.lit(name).alias("name"), F.when(ok, "pass").otherwise("unavailable").alias("status"),
        F.lit(summary).alias("summary"), F.when(ok, pairs).alias("metrics"),
        F.array().cast("array<string>").alias("warnings"),
        F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit(needs))).alias("missing_components"),
        F.lit(report_path).alias("report_path"))


def suite(rows: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rows)


def unavailable(spark: SparkSession, name: str, summary: str, missing: list[str]) -> DataFrame:
    return spark.createDataFrame([(name, "unavailable", summary, None, [], missing, None)], STATUS)
