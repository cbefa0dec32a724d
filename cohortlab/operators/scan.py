"""Segmented prefix scans: what each row needs from the rows before it in its key, for keys of any size.

Rows are dealt to ranges of (key, order), so one key, or one hour of one person, may spread over many tasks. Each range works on its
part of a key alone and hands on one row for each key in it; these rows, at most one for a range and key, are combined along
the ranges and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators.scale import attach
from cohortlab.session import materialize

PART = "r_part"


def ranged(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` with the number of its range of (key, order) as ``r_part``, written down so that all who read it see the same ranges."""
    columns = [F.col(c) for c in (*key, *order)]
    return materialize(df.repartitionByRange(*columns).withColumn(PART, F.spark_partition_id()))


def inside(key: list[str], order: list[str]) -> Window:
    """The rows of a key's part up to the current one."""
    return Window.partitionBy(*key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def earlier(key: list[str]) -> Window:
    """A key's parts before the current one."""
    return Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def last_value(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the last non-null ``value`` up to each row of its key; ``rows`` come from ``ranged``."""
    rows = rows.withColumn("r_value", value)
    ends = rows.groupBy(*key, PART).agg(F.max_by("r_value", F.when(F.col("r_value").isNotNull(), F.struct(*order))).alias("r_last"))
    carry = ends.select(*key, PART, F.last("r_last", ignorenulls=True).over(earlier(key)).alias("r_carry"))
    met = attach(rows, carry, [*key, PART])
    return met.withColumn(name, F.coalesce(F.last("r_value", ignorenulls=True).over(inside(key, order)), F.col("r_carry"))).drop(PART, "r_value", "r_carry")


def longest_run(rows: DataFrame, key: list[str], order: list[str], high: Column) -> DataFrame:
    """Longest stretch of rows with ``high`` per key (null is not high).

    A part is described by its best run, the run at its start, the run at its end and whether anything breaks it; parts combine
    along the ranges like the rows themselves would.
    """
    rows = rows.withColumn("r_high", F.coalesce(high, F.lit(False)).cast("int")).withColumn("r_breaks", F.sum(1 - F.col("r_high")).over(inside(key, order)))
    runs = rows.groupBy(*key, PART, "r_breaks").agg(F.sum("r_high").alias("run"))
    parts = runs.groupBy(*key, PART).agg(F.max("run").alias("best"), F.coalesce(F.max(F.when(F.col("r_breaks") == 0, F.col("run"))), F.lit(0)).alias("head"),
                                         F.max_by("run", "r_breaks").alias("tail"), F.max("r_breaks").alias("breaks"))
    packed = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(PART, "best", "head", "tail", "breaks"))).alias("parts"))  # one for a range at most
    start = F.struct(F.lit(0).cast("bigint").alias("best"), F.lit(0).cast("bigint").alias("open"))
    walk = F.aggregate("parts", start, lambda a, p: F.struct(
        F.greatest(a["best"], p["best"], a["open"] + p["head"]).alias("best"),
        F.when(p["breaks"] == 0, a["open"] + p["tail"]).otherwise(p["tail"]).alias("open")))
    return packed.select(*key, walk["best"].alias("longest_run"))


def longest_step(rows: DataFrame, key: list[str], at: Column) -> DataFrame:
    """Largest difference of the number ``at`` between neighbours of a key; null for a single row."""
    rows = rows.select(*key, PART, at.alias("r_at"))
    before = F.lag("r_at").over(Window.partitionBy(*key, PART).orderBy("r_at"))
    parts = rows.withColumn("r_step", F.col("r_at") - before).groupBy(*key, PART).agg(F.min("r_at").alias("lo"), F.max("r_at").alias("hi"), F.max("r_step").alias("step"))
    between = F.col("lo") - F.max("hi").over(earlier(key))
    return parts.withColumn("between", between).groupBy(*key).agg(F.max(F.greatest("step", "between")).alias("longest_step"))
