"""Series of measurements per case: key points and simple forecasts.

Input: ``case_id, day, volume_ml`` and an optional tie-breaking column. Everything
is an aggregate with map-side combine or a pre-limited top-k, so a case with very
many rows costs its share of a scan and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.numeric import finite_or_null
from cohortlab.operators.scale import first_rows

FLOOR = 1e-6
TWO_POINT = ("baseline_no_change", "linear_early", "exponential_early")
SERIES = ("last_observation", "last_slope", "linear", "exponential")


def _at(day: str, volume: str, tie: str | None, keep: Column | None = None) -> Column:
    fields = [F.col(day), F.col(volume)] + ([F.col(tie)] if tie else [])
    point = F.struct(*fields)
    return point if keep is None else F.when(keep, point)


def key_points(df: DataFrame, case: str = "case_id", day: str = "day", volume: str = "volume_ml",
               tie: str | None = None) -> DataFrame:
    """Baseline, early and final point per case; early only with three points or more."""
    order = [F.col(c) for c in (day, volume) + ((tie,) if tie else ())]
    ends = df.groupBy(case).agg(F.count("*").alias("n_points"), F.max(_at(day, volume, tie)).alias("last"))
    heads = (first_rows(df, [case], order, 2).groupBy(case)
             .agg(F.min(F.when(F.col("rank") == 1, F.struct(day, volume))).alias("first"),
                  F.min(F.when(F.col("rank") == 2, F.struct(day, volume))).alias("second")))
    early = F.when(F.col("n_points") > 2, F.col("second"))
    return ends.join(heads, case).select(
        case, "n_points", F.col(f"first.{day}").alias("baseline_day"),
        F.col(f"first.{volume}").alias("baseline_volume_ml"),
        early[day].alias("early_day"), early[volume].alias("early_volume_ml"),
        F.col(f"last.{day}").alias("final_day"), F.col(f"last.{volume}").alias("final_volume_ml"))


def two_point_forecasts(cases: DataFrame) -> DataFrame:
    """Add the three baselines that need at most a baseline and an early point.

    NULL where there is no forecast: a zero day gap, a non-positive early volume, or a
    result beyond the range of a double.
    """
    base, early = F.col("baseline_volume_ml"), F.col("early_volume_ml")
    elapsed = F.col("early_day") - F.col("baseline_day")
    horizon = F.col("final_day") - F.col("baseline_day")
    steps = F.try_divide(horizon, elapsed)
    none = F.col("early_day").isNull()
    linear = F.greatest(base + (early - base) * steps, F.lit(FLOOR))
    curve = F.when((early > 0) & (base > 0),
                   F.greatest(base * F.exp(F.ln(early / base) * steps), F.lit(FLOOR)))
    return cases.withColumns({
        "baseline_no_change": base,
        "linear_early": F.when(none, base).when(steps.isNotNull(), finite_or_null(linear)),
        "exponential_early": F.when(none, base).when(steps.isNotNull(), finite_or_null(curve)),
    })


def series_fits(df: DataFrame, case: str = "case_id", day: str = "day", volume: str = "volume_ml",
                tie: str | None = None, fit: Column | None = None) -> DataFrame:
    """Least-squares fits and the last two points over the rows where ``fit`` holds.

    The first row at or after the fit window becomes the held-out point.
    """
    fit = F.lit(True) if fit is None else fit
    x, y = F.when(fit, F.col(day)), F.when(fit, F.col(volume))
    log_y = F.when(fit, F.ln(F.greatest(F.col(volume), F.lit(FLOOR))))
    # centre the days per case only after the fact: slope and mean are shift free
    fits = df.groupBy(case).agg(
        F.count(x).alias("n_fit"), F.avg(x).alias("mean_day"), F.var_pop(x).alias("var_day"),
        F.avg(y).alias("mean_volume"), F.covar_pop(x, y).alias("cov_volume"),
        F.avg(log_y).alias("mean_log"), F.covar_pop(x, log_y).alias("cov_log"),
        F.min(_at(day, volume, tie, ~fit)).alias("held"))
    order = [F.col(c).desc() for c in (day, volume) + ((tie,) if tie else ())]
    tails = (first_rows(df.filter(fit), [case], order, 2).groupBy(case)
             .agg(F.max(F.when(F.col("rank") == 1, F.struct(day, volume))).alias("last"),
                  F.max(F.when(F.col("rank") == 2, F.struct(day, volume))).alias("prior")))
    return fits.join(tails, case).select(
        case, "n_fit", "mean_day", "var_day", "mean_volume", "cov_volume", "mean_log", "cov_log",
        F.col(f"held.{day}").alias("held_day"), F.col(f"held.{volume}").alias("held_volume_ml"),
        F.col(f"last.{day}").alias("last_day"), F.col(f"last.{volume}").alias("last_volume_ml"),
        F.col(f"prior.{day}").alias("prior_day"), F.col(f"prior.{volume}").alias("prior_volume_ml"))


def series_forecasts(fits: DataFrame, target: Column) -> DataFrame:
    """Add last value, last slope, least squares line and log-line forecasts at ``target``."""
    last, zero = F.col("last_volume_ml"), F.lit(0.0)
    flat = (F.col("n_fit") < 2) | F.coalesce(F.col("last_day") == F.col("prior_day"), F.lit(True))
    slope = F.try_divide(last - F.col("prior_volume_ml"), F.col("last_day") - F.col("prior_day"))
    level = F.col("var_day") <= 0
    step = target - F.col("mean_day")
    line = F.col("mean_volume") + F.try_divide(F.col("cov_volume"), F.col("var_day")) * step
    log_line = F.col("mean_log") + F.try_divide(F.col("cov_log"), F.col("var_day")) * step
    return fits.withColumns({
        "last_observation": F.greatest(last, zero),
        "last_slope": F.when(flat, F.greatest(last, zero)).otherwise(
            F.greatest(last + slope * (target - F.col("last_day")), zero)),
        "linear": F.when(level, F.greatest(last, zero)).otherwise(F.greatest(line, zero)),
        "exponential": F.when(level, F.greatest(last, F.lit(FLOOR))).otherwise(finite_or_null(F.exp(log_line))),
    })


def change_features(df: DataFrame, volume: str = "volume_ml") -> DataFrame:
    """Percent and log change against the baseline volume already attached as ``baseline_volume_ml``.

    Where ``baseline_day`` is attached too, ``response_slope`` is the log change per day since then; null on the baseline's own day.
    """
    v, b = F.col(volume), F.col("baseline_volume_ml")
    df = df.withColumns({
        "percent_change": 100.0 * F.try_divide(v - b, b),
        "log_change": F.when((v > 0) & (b > 0), F.ln(F.try_divide(v, b)))})
    if "baseline_day" not in df.columns:
        return df
    return df.withColumn("response_slope", F.try_divide(F.col("log_change"), F.col("day") - F.col("baseline_day")))


def long_forecasts(df: DataFrame, methods, ids: list[str], observed: str) -> DataFrame:
    """Unpivot wide point forecasts to ``method, point, observed`` with absolute error."""
    return (df.select(*ids, F.col(observed).alias("observed"), *methods)
            .unpivot([*ids, "observed"], list(methods), "method", "point")
            .withColumn("abs_error", F.abs(F.col("point") - F.col("observed"))))
