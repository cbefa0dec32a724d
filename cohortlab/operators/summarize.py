"""Summaries of an ensemble of trajectories (long form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.functions.numeric import ratio_or
from cohortlab.operators.ranks import quantiles_of
from cohortlab.operators.scale import attach

BANDS = {"lo95": 0.025, "lo80": 0.1, "median": 0.5, "hi80": 0.9, "hi95": 0.975}
# Fixed value: the line every summary carries.
STANDING_WARNING = "Exploratory simulation; parameters are not clinically validated."


def bands_by_day(df: DataFrame, case: list[str], day: str, value: str) -> DataFrame:
    """Median, 80% and 95% bands and the 80% width per case and day."""
    out = quantiles_of(df, [*case, day], value, BANDS)
    return out.withColumn("width80", F.col("hi80") - F.col("lo80"))


def band_score(bands: DataFrame, case: list[str], day: str) -> DataFrame:
    """Day of the widest band (the first on ties) and the uncertainty score."""
    got = bands.groupBy(*case).agg(
        F.min(F.struct(-F.col("width80"), F.col(day).alias("at")))["at"].alias("widest_day"),
        F.max("width80").alias("widest"), F.avg("width80").alias("mean_width"),
        F.avg(F.greatest("median", F.lit(1e-9))).alias("level"))
    score = F.col("mean_width") / F.greatest("level", F.lit(1e-9))
    return got.withColumn("uncertainty_score", score).drop("mean_width", "level")


def last_day_rows(df: DataFrame, case: list[str], day: str) -> DataFrame:
    """Rows of the last day of each case.

    The last days are one row per case; a case key is never gathered to find them.
    """
    last = df.groupBy(*case).agg(F.max(day).alias("last_day"), F.count("*").alias("n"))
    return attach(df, last, case).filter(F.col(day) == F.col("last_day")).drop("last_day")


def tail_share(last: DataFrame, case: list[str], value: str, threshold: float = 1.0) -> DataFrame:
    """Share of particles below the threshold on the last day, with its distribution."""
    share = last.groupBy(*case).agg(F.avg((F.col(value) < threshold).cast("double")).alias("share_below"))
    return quantiles_of(last, case, value, BANDS).join(share, case)


def abs_correlation(x: str, y: str) -> Column:
    """|Pearson| as an aggregate; 0 below three pairs or without variance."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(F.count(x) < 3, 0.0).otherwise(ratio_or(F.abs(F.covar_pop(x, y)), F.when(spread > 0, spread), 0.0))


def driver_correlation(df: DataFrame, case: list[str], param: str, value: str, outcome: str) -> DataFrame:
    """Correlation of each parameter with the final outcome, its rank, and its role.

    ``dominant``: among the first three and at least 0.2. ``prior_dominated``: below 0.1.
    """
    got = df.groupBy(*case, param).agg(abs_correlation(value, outcome).alias("correlation"))
    rank = F.row_number().over(Window.partitionBy(*case).orderBy(F.col("correlation").desc(), F.col(param)))
    got = got.withColumn("rank", rank)
    return got.withColumns({"dominant": (F.col("rank") <= 3) & (F.col("correlation") >= 0.2),
                            "prior_dominated": F.col("correlation") < 0.1})


def warning_union(df: DataFrame, case: list[str], warnings: str, standing: str = STANDING_WARNING) -> DataFrame:
    """Distinct sorted warnings per case plus the standing line.

    Warnings are made distinct before they are gathered, so the list is as long as
    there are kinds of warning.
    """
    kinds = df.select(*case, F.explode_outer(warnings).alias("w")).distinct()
    return kinds.groupBy(*case).agg(F.array_sort(F.array_distinct(
        F.concat(F.collect_list("w"), F.array(F.lit(standing))))).alias("warnings"))
