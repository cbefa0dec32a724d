"""Scores of forecasts: errors, intervals, paired changes, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.numeric import ratio_or
from cohortlab.operators.ranks import quantiles, quantiles_of
from cohortlab.operators.scale import attach

SWEEP_METRICS = ("ess", "ess_fraction", "fit_prior_rmse_ml", "fit_posterior_rmse_ml",
                 "rmse_improvement_fraction", "posterior_heldout_error_ml", "prior_heldout_error_ml")


def error_sums() -> list[Column]:
    """Aggregates shared by all error reports over ``point`` and ``observed``."""
    error = F.col("point") - F.col("observed")
    logs = F.ln(F.greatest("point", F.lit(1e-6))) - F.ln(F.col("observed"))
    return [F.count("point").alias("n"), F.avg(F.abs(error)).alias("mae_ml"),
            F.sqrt(F.avg(error * error)).alias("rmse_ml"), F.sqrt(F.avg(logs * logs)).alias("log_volume_rmse")]


def coverage(lower: str, upper: str) -> Column:
    """Share of rows with an interval whose observation lies in it; NULL without any."""
    return F.avg(F.when(F.col(lower).isNotNull(),
                        F.col("observed").between(F.col(lower), F.col(upper)).cast("double")))


def interval_sums() -> list[Column]:
    return [coverage("lo80", "hi80").alias("coverage_80"), coverage("lo95", "hi95").alias("coverage_95"),
            F.avg(F.col("hi80") - F.col("lo80")).alias("width_80_ml")]


def interval_score(lower: str, upper: str, miss: float) -> Column:
    """Mean interval score: the width, plus 2 / miss for each unit that the observation lies outside."""
    low, high, seen = F.col(lower), F.col(upper), F.col("observed")
    outside = F.greatest(low - seen, F.lit(0.0)) + F.greatest(seen - high, F.lit(0.0))
    return F.avg(high - low + F.lit(2.0 / miss) * outside)


def forecast_metrics(df: DataFrame, keys: list[str], intervals: bool = True) -> DataFrame:
    """Error and interval scores per group, with the median absolute percentage error."""
    df = df.filter(F.col("point").isNotNull())
    sums = df.groupBy(*keys).agg(*error_sums(), *(interval_sums() if intervals else []))
    ape = df.select(*keys, (F.abs(F.col("point") - F.col("observed")) / F.col("observed")).alias("ape"))
    medians = quantiles_of(ape, keys, "ape", {"median_ape": 0.5}).drop("n")
    return sums.join(medians, keys, "left")


def calibration_extract(metrics: DataFrame, method: str) -> DataFrame:
    """The interval scores of one method."""
    return metrics.filter(F.col("method") == method).select(
        "method", "n", "coverage_80", "coverage_95", "width_80_ml")


def leaderboard_rollup(df: DataFrame, dims: list[str], intervals: bool = False) -> DataFrame:
    """Error scores for every prefix of ``dims`` (a horizon may be one); the level says how many are set.

    With ``intervals`` also coverage, width and the interval scores of the 80% and 95% bands.
    """
    more = [*interval_sums(), interval_score("lo80", "hi80", 0.2).alias("score_80"), interval_score("lo95", "hi95", 0.05).alias("score_95")] if intervals else []
    return df.filter(F.col("point").isNotNull()).rollup(*dims).agg(F.grouping_id().alias("level"), *error_sums(), *more)


def paired_delta(df: DataFrame, comparisons: list[tuple[str, str, str]], case: str = "case_id") -> DataFrame:
    """Per (label, new, old): cases helped, harmed and the mean fall of the absolute error.

    Exact ties count as neither.
    """
    methods = sorted({m for _, new, old in comparisons for m in (new, old)})
    wide = df.filter(F.col("method").isin(methods)).groupBy(case).agg(
        *[F.max(F.when(F.col("method") == m, F.abs(F.col("point") - F.col("observed")))).alias(m) for m in methods])
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("comparison"), (F.col(old) - F.col(new)).alias("delta"))
        for label, new, old in comparisons])).alias("r")).select("r.*")
    return rows.groupBy("comparison").agg(
        F.count("delta").alias("n"), F.count_if(F.col("delta") > 0).alias("helped"),
        F.count_if(F.col("delta") < 0).alias("harmed"),
        F.coalesce(F.avg("delta"), F.lit(0.0)).alias("mean_mae_delta_ml"))


def method_comparison(df: DataFrame, run: list[str]) -> DataFrame:
    """Median and mean absolute error and win count per method.

    The smallest error of a run wins; ties go to the alphabetically first method.
    """
    df = df.filter(F.col("abs_error").isNotNull())
    wins = (df.groupBy(*run).agg(F.min(F.struct("abs_error", "method"))["method"].alias("method"))
            .groupBy("method").agg(F.count("*").alias("win_count")))
    medians = quantiles_of(df, ["method"], "abs_error", {"median_abs_error": 0.5})
    means = df.groupBy("method").agg(F.avg("abs_error").alias("mean_abs_error"))
    return means.join(medians, "method").join(wins, "method", "left").select(
        "method", F.col("n"), "median_abs_error", "mean_abs_error",
        F.coalesce("win_count", F.lit(0)).alias("win_count"))


def sweep_medians(runs: DataFrame, groupings: dict[str, str], metrics=SWEEP_METRICS) -> DataFrame:
    """Run count and metric medians for each single grouping of one run table.

    ``groupings`` maps a label to a column; they share one scan. A group counts all its runs, and a metric
    that is NULL in all of them has a NULL median.
    """
    labels, columns = list(groupings), list(groupings.values())
    groups = F.array(*[F.struct(F.lit(i).alias("g"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("g") + 1)
    n_runs = runs.groupBy(*columns).agg(F.count("*").alias("n")).select(F.explode(groups).alias("k"), "n").select("k.*", "n").groupBy("g", "value").agg(F.sum("n").alias("n_runs"))
    medians = quantiles(runs, ["g", "value"], {m: F.col(m) for m in metrics}, {"q50": 0.5}, groups, columns)
    medians = medians.select("g", "value", *[F.col(f"{m}_q50").alias(f"median_{m}") for m in metrics])
    return attach(n_runs, medians, ["g", "value"]).select(label.alias("grouping"), "value", "n_runs", *[f"median_{m}" for m in metrics])


def parameter_stability(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample sd (0 for a single run), range and relative sd."""
    got = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return got.withColumn("relative_stddev", ratio_or(F.col("stddev"), F.abs("mean"), 0.0))


def insight_rows(methods: DataFrame, by_variant: DataFrame, overall: DataFrame,
                 posterior: str, prior: str) -> DataFrame:
    """Four findings from the (already tiny) summaries.

    ``methods(method, median_abs_error)``, ``by_variant(variant, median_error)`` and
    ``overall(median_ess_fraction)`` have one row per method, variant and sweep.
    """
    error = lambda m: F.max(F.when(F.col("method") == m, F.col("median_abs_error")))
    a = methods.agg(error(posterior).alias("posterior"), error(prior).alias("prior"),
                    F.min(F.struct("median_abs_error", "method"))["method"].alias("best"))
    best_variant = by_variant.agg(F.min(F.struct("median_error", "variant"))["variant"]).scalar()
    ess = overall.agg(F.max("median_ess_fraction")).scalar()
    row = lambda i, finding, detail: F.struct(F.lit(i).alias("ord"), F.lit(finding).alias("finding"),
                                              detail.alias("detail"))
    rows = F.array(
        row(1, "posterior_vs_prior", F.when(F.col("posterior") < F.col("prior"), "improved").otherwise("not_improved")),
        row(2, "ess_share", F.when(F.col("ess") < 0.05, "fragile").otherwise("not_concentrated")),
        row(3, "best_method", F.col("best")), row(4, "best_variant", F.col("variant")))
    a = a.withColumns({"ess": ess, "variant": best_variant})
    return a.select(F.explode(rows).alias("r")).select("r.*")


def fit_rmse(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fit error of the prior and the posterior mean, and the improvement share."""
    square = lambda c: F.pow(F.col(c) - F.col("observed"), F.lit(2.0))
    got = df.groupBy(*keys).agg(F.sqrt(F.avg(square("prior_mean"))).alias("prior_rmse"),
                                F.sqrt(F.avg(square("posterior_mean"))).alias("posterior_rmse"))
    gain = F.when(F.col("prior_rmse") > 0, (F.col("prior_rmse") - F.col("posterior_rmse")) / F.col("prior_rmse"))
    return got.withColumn("improvement_fraction", F.coalesce(gain, F.lit(0.0)))
