"""A stored layout for tables that are joined by case again and again: bucketed by case, so that joins and aggregations need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlab.operators.posterior import part_of
from cohortlab.session import materialize, scratch
from cohortlab.sources.sinks import write_bucketed

#: Buckets may serve a join on the case and further columns.
PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def by_case_alone(spark: SparkSession) -> Iterator[None]:
    """Within it, tables bucketed by case also meet on (case, day) where they lie; the session's setting comes back afterwards."""
    before = spark.conf.get(PARTIAL_KEYS)
    spark.conf.set(PARTIAL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(PARTIAL_KEYS, before)


class CaseStore:
    """Tables in buckets of cases, one file a bucket, sorted by case.

    A case lies in one bucket whole, so choose as many buckets as the tables have tasks' worth of rows; a case of more rows than a
    task should hold is better left to a shuffled join, which adaptive execution splits.
    """

    def __init__(self, spark: SparkSession, buckets: int = 64, case: str = "case_id") -> None:
        self.spark, self.buckets, self.case = spark, buckets, case
        self.tables: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` (again) under ``name`` and return the stored table."""
        self.tables[name] = f"cohortlab_{name}_{uuid.uuid4().hex}"
        rows = df.repartition(self.buckets, self.case)  # the hash of the buckets: one task writes one bucket
        write_bucketed(rows, self.tables[name], self.case, self.buckets, scratch(self.spark, name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def close(self) -> None:
        """Forget the tables; their files go with the application."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()

    def log_likelihood(self, predictions: str, observed: str, noise: Column) -> DataFrame:
        """``loglik`` per case and particle over the days that have an observation; planned without a shuffle inside ``by_case_alone``."""
        met = self.read(predictions).join(self.read(observed), [self.case, "day"])
        return met.groupBy(self.case, "particle_id").agg(F.sum(part_of(noise)).alias("loglik"), F.count("*").alias("n_obs"))

    def scored(self, predictions: str, observed: str, noise: Column) -> DataFrame:
        """``log_likelihood``, written down."""
        with by_case_alone(self.spark):
            return materialize(self.log_likelihood(predictions, observed, noise))
