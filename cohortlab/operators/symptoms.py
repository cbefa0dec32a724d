"""Trends over symptom logs, safe for a person, or one hour of a person, with very many entries.

What a row needs from the rows before it comes from segmented scans (``scan``): logs are dealt to ranges of person and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators import scan
from cohortlab.operators.scale import attach


def asof_previous(df: DataFrame, key: list[str], ts: str, tie: str, event: Column, value: Column, name: str) -> DataFrame:
    """Add the ``value`` of the latest earlier (or same) row where ``event`` holds; rows are ordered by ``ts`` and ``tie``."""
    return scan.last_value(scan.ranged(df, key, [ts, tie]), key, [ts, tie], F.when(event, value), name)


def longest_run(df: DataFrame, key: list[str], ts: str, tie: str, high: Column) -> DataFrame:
    """Longest row of consecutive entries where ``high`` holds, per key."""
    return scan.longest_run(scan.ranged(df, key, [ts, tie]), key, [ts, tie], high)


def longest_gap(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Longest time between neighbouring entries in seconds, per key."""
    return _in_seconds(scan.longest_step(scan.ranged(df, key, [ts]), key, F.unix_micros(F.col(ts))), key)


def _in_seconds(steps: DataFrame, key: list[str]) -> DataFrame:
    return steps.select(*key, (F.col("longest_step") / 1e6).alias("longest_gap"))


def symptom_flags(df: DataFrame, person: str, symptom: str, ts: str, tie: str, severity: str,
                  rise: float, high: float, n_high: int, gap_seconds: float) -> DataFrame:
    """Per person and symptom: first seen, worsened over baseline, stayed high, gap in the log."""
    key = [person, symptom]
    sums = df.groupBy(*key).agg(
        F.count("*").alias("n_entries"), F.min(ts).alias("first_seen"),
        F.min_by(severity, F.struct(ts, tie)).alias("baseline_severity"),
        F.max(severity).alias("peak_severity"))
    rows = scan.ranged(df.select(*key, ts, tie, severity), key, [ts, tie])
    runs = scan.longest_run(rows, key, [ts, tie], F.col(severity) >= high)
    gaps = _in_seconds(scan.longest_step(rows, key, F.unix_micros(F.col(ts))), key)
    out = attach(attach(sums, runs, key), gaps, key)
    return out.withColumns({"worsened": F.col("peak_severity") - F.col("baseline_severity") >= rise,
                            "stayed_high": F.col("longest_run") >= n_high,
                            "log_gap": F.coalesce(F.col("longest_gap") > gap_seconds, F.lit(False))})


def new_symptoms(df: DataFrame, person: str, symptom: str, ts: str, days: int) -> DataFrame:
    """Symptoms first logged at least ``days`` after the person's first entry."""
    seen = df.groupBy(person, symptom).agg(F.min(ts).alias("first_seen"), F.count("*").alias("n_entries"))
    start = seen.groupBy(person).agg(F.min("first_seen").alias("start"))
    return attach(seen, start, [person]).withColumn(
        "is_new", F.datediff("first_seen", "start") >= days)


def paired_movement(df: DataFrame, person: str, symptom: str, ts: str, severity: str, up: str, down: str) -> DataFrame:
    """Days on which the mean of ``up`` rose while that of ``down`` fell, per person.

    Works on daily means: one row per person, symptom and day.
    """
    daily = df.filter(F.col(symptom).isin(up, down)).groupBy(person, F.to_date(ts).alias("day")).agg(
        F.avg(F.when(F.col(symptom) == up, F.col(severity))).alias("u"),
        F.avg(F.when(F.col(symptom) == down, F.col(severity))).alias("d"))
    order = Window.partitionBy(person).orderBy("day")
    both = daily.filter(F.col("u").isNotNull() & F.col("d").isNotNull()).withColumns(
        {"pu": F.lag("u").over(order), "pd": F.lag("d").over(order)})
    return both.groupBy(person).agg(
        F.count("*").alias("n_days"), F.count_if((F.col("u") > F.col("pu")) & (F.col("d") < F.col("pd"))).alias("n_opposed"))


def treatment_day_profile(df: DataFrame, person: str, symptom: str, ts: str, severity: str, since: str) -> DataFrame:
    """Mean severity per whole day since the latest treatment, and the peak day per symptom."""
    offset = F.datediff(F.col(ts), F.col(since))
    rows = df.filter(F.col(since).isNotNull()).groupBy(symptom, offset.alias("day_offset")).agg(
        F.count("*").alias("n"), F.avg(severity).alias("mean_severity"))
    peak = rows.groupBy(symptom).agg(F.min(F.struct(-F.col("mean_severity"), F.col("day_offset").alias("at")))["at"].alias("peak_offset"))
    return rows.join(peak, symptom)


def visit_summary(df: DataFrame, person: str, symptom: str, ts: str, severity: str, visit: Column, low: float) -> DataFrame:
    """Average, peak, first entry and low days among the last seven before the visit."""
    recent = (F.col(ts) >= visit - F.expr("interval 7 days")) & (F.col(ts) < visit)
    day = F.when(recent & (F.col(severity) < low), F.to_date(ts))
    per_day = df.filter(F.col(ts) < visit).groupBy(person, symptom, F.to_date(ts).alias("day")).agg(
        F.sum(severity).alias("s"), F.count("*").alias("n"), F.max(severity).alias("hi"),
        F.min(ts).alias("first"), F.max(F.when(day.isNotNull(), 1).otherwise(0)).alias("low_day"))
    return per_day.groupBy(person, symptom).agg(
        F.sum("n").alias("n_entries"), (F.sum("s") / F.sum("n")).alias("mean_severity"), F.max("hi").alias("peak_severity"),
        F.min("first").alias("first_seen"), F.sum("low_day").alias("low_days_of_last_7"))


def burden(df: DataFrame, person: str, symptom: str, severity: str, weights: dict[str, float],
           low: float, high: float) -> DataFrame:
    """Weighted mean burden, its level and the category that adds most."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col(symptom) == name, w).otherwise(weight)
    parts = df.groupBy(person, symptom).agg((F.avg(severity) * F.max(weight)).alias("part"))
    got = parts.groupBy(person).agg(F.sum("part").alias("burden"),
                                    F.min(F.struct(-F.col("part"), F.col(symptom).alias("s")))["s"].alias("dominant"))
    return got.withColumn("burden_level", F.when(F.col("burden") < low, "low").when(F.col("burden") < high, "moderate").otherwise("high"))


def baseline_attached(df: DataFrame, key: list[str], ts: str, tie: str, value: str, name: str) -> DataFrame:
    """Add each key's first value (by time) to all its rows."""
    firsts = df.groupBy(*key).agg(F.min_by(value, F.struct(ts, tie)).alias(name), F.count("*").alias("n"))
    return attach(df, firsts, key)
