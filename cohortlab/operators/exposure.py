"""Drug exposure on an output grid from dose events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators.scale import attach

#: Decay, as a logarithm, over one stretch of days: far from the range of a double, and far below its precision.
REACH = 300.0


def output_days(total: Column, step: int = 7) -> Column:
    """Array 0, step, .. with ``total`` appended when it is not on the grid."""
    return F.array_distinct(F.concat(F.sequence(F.lit(0), F.floor(total).cast("int"), F.lit(step)).cast("array<double>"),
                                     F.array(total.cast("double"))))


def grid_rows(schedules: DataFrame, schedule: str = "schedule_id", total: str = "total_days", step: int = 7) -> DataFrame:
    return schedules.select(schedule, F.explode(output_days(F.col(total), step)).alias("grid_day"))


def exposure(doses: DataFrame, schedules: DataFrame, decay: Column, schedule: str = "schedule_id",
             total: str = "total_days", step: int = 7) -> DataFrame:
    """``(schedule, drug, grid_day, exposure)``: decayed sum of the doses given so far.

    Doses are first added up within the grid cell they fall into, decayed to the end
    of that cell, so a schedule with a billion doses has at most one row per cell and drug. Decay is
    exponential, so the levels are running sums over the grid: one pass, however long it is.
    ``decay`` is an expression of ``drug``. Every drug of the schedule has its rows, zeros if need be.
    """
    ends = schedules.select(schedule, F.col(total).cast("double").alias("s_total"))
    rows = attach(doses, ends, [schedule])
    # grid day at or after the dose; beyond the last full step it is the total itself
    cell = F.least(F.ceil(F.col("day") / step) * step, F.col("s_total")).cast("double")
    # a dose after the horizon adds nothing, but its drug is one of the schedule
    cells = (rows.filter(F.col("s_total").isNotNull())
             .select(schedule, "drug", "s_total", "day", "relative_dose", cell.alias("cell_day"), decay.alias("decay"))
             .groupBy(schedule, "drug", "s_total", "decay", "cell_day")
             .agg(F.sum(F.expr("CASE WHEN day <= s_total THEN relative_dose * exp(-decay * (cell_day - day)) ELSE 0D END")).alias("amount")))
    # every drug of the schedule has each grid day, with what its own cell adds
    days = F.explode(output_days(F.col("s_total"), step)).alias("grid_day")
    empty = cells.select(schedule, "drug", "s_total", "decay").distinct().select(schedule, "drug", "decay", days, F.lit(0.0).alias("amount"))
    held = cells.select(schedule, "drug", "decay", F.col("cell_day").alias("grid_day"), "amount")
    rows = empty.unionByName(held).groupBy(schedule, "drug", "decay", "grid_day").agg(F.sum("amount").alias("amount"))
    # Decayed sums are running sums of amount * exp(decay * day). Days are cut into stretches over which that factor stays within exp(REACH);
    # what is two stretches back has decayed to nothing.
    rows = rows.withColumn("e_at", F.coalesce(F.col("decay") * F.col("grid_day"), F.lit(0.0))).withColumn("e_stretch", F.floor(F.col("e_at") / REACH))
    rows = rows.withColumn("e_grown", F.col("amount") * F.exp(F.col("e_at") - F.col("e_stretch") * REACH))
    line = Window.partitionBy(schedule, "drug")
    so_far = F.sum("e_grown").over(Window.partitionBy(schedule, "drug", "e_stretch").orderBy("grid_day").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("e_grown").over(line.orderBy("e_stretch").rangeBetween(-1, -1)), F.lit(0.0))
    since = F.col("e_at") - F.col("e_stretch") * REACH
    level = F.when(F.col("decay").isNotNull(), so_far * F.exp(-since) + before * F.exp(-since - REACH))
    return rows.select(schedule, "drug", "grid_day", level.alias("exposure"))


def saturating_effect(levels: DataFrame, sensitivity: Column, ec50: Column, schedule: str = "schedule_id") -> DataFrame:
    """Sum over drugs of ``s E / (E + ec50)`` where there is exposure; per grid day."""
    e = F.col("exposure")
    part = F.when(e > 0, sensitivity * e / (e + ec50)).otherwise(0.0)
    return levels.groupBy(schedule, "grid_day").agg(F.sum(part).alias("effect"))
