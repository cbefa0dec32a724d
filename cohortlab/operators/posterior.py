"""Reweighting of particles against observations, and what the weights tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators.ranks import quantiles
from cohortlab.operators.scale import attach
from cohortlab.session import materialize

#: Log-likelihoods of one step are added up together; far from the range of a double.
STEP = 64.0


def with_observed(predictions: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions that have an observation on the same case and day.

    ``observed(keys.., observed)`` has one row per key.
    """
    return attach(predictions, observed, keys).filter(F.col("observed").isNotNull())


def part_of(noise: Column) -> Column:
    """What one observation adds to the log-likelihood of a row with ``predicted`` and ``observed``."""
    sd = F.greatest(noise * F.greatest(F.col("observed"), F.lit(1.0)), F.lit(0.25))
    miss = (F.col("observed") - F.col("predicted")) / sd
    return F.lit(-0.5) * F.pow(miss, F.lit(2.0)) - F.ln(sd)


def log_likelihood(predictions: DataFrame, case: list[str], particle: list[str], noise: Column) -> DataFrame:
    """``loglik`` per particle over rows that hold ``predicted`` and ``observed``."""
    return predictions.groupBy(*case, *particle).agg(F.sum(part_of(noise)).alias("loglik"), F.count("*").alias("n_obs"))


def weights(loglik: DataFrame, case: list[str]) -> DataFrame:
    """Add ``weight``, summing to one per case.

    The likelihoods are read twice, so they are written once. Maximum and total come from one aggregation: likelihoods are added up
    in steps of ``STEP``, each relative to its own upper end, and the steps of a case, a few rows, relative to the highest.
    """
    loglik = materialize(loglik)
    step = F.ceil(F.col("loglik") / STEP)
    parts = loglik.groupBy(*case, step.alias("w_step")).agg(F.sum(F.exp(F.col("loglik") - step * STEP)).alias("w_sum"), F.max("loglik").alias("w_top"), F.count("*").alias("n"))
    top = F.max("w_top").over(Window.partitionBy(*case))
    totals = parts.withColumn("w_top", top).groupBy(*case).agg(
        F.max("w_top").alias("top"), F.sum(F.col("w_sum") * F.exp(F.least(F.col("w_step") * STEP - F.col("w_top"), F.lit(STEP)))).alias("total"), F.sum("n").alias("n"))
    return attach(loglik, totals, case).withColumn("weight", F.exp(F.col("loglik") - F.col("top")) / F.col("total")).drop("top", "total")


def effective_size(weighted: DataFrame, case: list[str]) -> DataFrame:
    """Effective sample size, its share, and the flag for too few surviving particles."""
    got = weighted.groupBy(*case).agg(F.count("*").alias("n_particles"),
                                      (1.0 / F.sum(F.col("weight") * F.col("weight"))).alias("ess"))
    return got.withColumns({"ess_fraction": F.col("ess") / F.col("n_particles"),
                            "low_ess": F.col("ess") < F.greatest(F.lit(10.0), 0.02 * F.col("n_particles"))})


def weighted_mean(value: str, weight: str = "weight") -> Column:
    """Weighted mean, the plain mean where the weights add up to nothing."""
    w = F.sum(weight)
    return F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / w).otherwise(F.avg(value))


def mean_predictions(df: DataFrame, keys: list[str], predicted: str = "predicted") -> DataFrame:
    """Prior mean and posterior (weighted) mean per key, e.g. case and day."""
    return df.groupBy(*keys).agg(F.avg(predicted).alias("prior_mean"),
                                 F.sum(F.col(predicted) * F.col("weight")).alias("posterior_mean"))


def parameter_widths(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Prior and posterior 80% widths of each parameter and their ratio (1 for a constant), from the same passes over the rows."""
    got = quantiles(df, keys, {"v": F.col(value)}, {"p0": 0.0, "p10": 0.1, "p90": 0.9, "p100": 1.0}, weight=F.col(weight), weighted={"w10": 0.1, "w90": 0.9})
    widths = got.select(*keys, F.col("n_v").alias("n"), (F.col("v_p100") - F.col("v_p0")).alias("value_range"),
                        (F.col("v_p90") - F.col("v_p10")).alias("prior_width_80"), (F.col("v_w90") - F.col("v_w10")).alias("posterior_width_80"))
    ratio = F.when(F.col("prior_width_80") > 0, F.col("posterior_width_80") / F.col("prior_width_80"))
    return widths.withColumn("width_ratio", F.coalesce(ratio, F.lit(1.0)))


def parameter_class(df: DataFrame, inactive: Column, n_obs: Column, low_ess: Column) -> DataFrame:
    """Add ``classification`` and ``reason`` from width ratio, observations and sample size."""
    ratio = F.col("width_ratio")
    label = (F.when(inactive | (n_obs < 3), "prior-dominated")
             .when((ratio < 0.35) & low_ess, "weakly constrained").when(ratio < 0.35, "constrained")
             .when(ratio < 0.55, "weakly constrained").otherwise("prior-dominated"))
    reason = (F.when(inactive, "drug not in schedule").when(n_obs < 3, "too few observations")
              .when((ratio < 0.35) & low_ess, "low effective sample size").otherwise(""))
    return df.withColumns({"classification": label, "reason": reason})


def class_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda c: F.count_if(F.col("classification") == c)
    return df.groupBy(*keys).agg(count("constrained").alias("constrained"),
                                 count("weakly constrained").alias("weakly_constrained"),
                                 count("prior-dominated").alias("prior_dominated"))


def posterior_health(ess: DataFrame, widths: DataFrame, case: list[str]) -> DataFrame:
    """Sample-size share, mean contraction and a degeneracy flag per case."""
    shrink = widths.groupBy(*case).agg(F.avg(1.0 - F.col("width_ratio")).alias("mean_contraction"))
    return ess.join(shrink, case).withColumn("degenerate", F.col("low_ess") & (F.col("ess_fraction") < 0.05))


def update_value(before: DataFrame, after: DataFrame, case: list[str]) -> DataFrame:
    """Paired change when observations are added: errors, coverage, collapse, overconfidence.

    Both sides hold ``point, lo80, hi80, observed, ess_fraction`` per case.
    """
    b = before.select(*case, *[F.col(c).alias(f"b_{c}") for c in ("point", "lo80", "hi80", "observed")])
    rows = after.join(b, case)
    inside = lambda p: F.col("observed").between(F.col(f"{p}lo80"), F.col(f"{p}hi80")).cast("double")
    err_b, err_a = F.abs(F.col("b_point") - F.col("observed")), F.abs(F.col("point") - F.col("observed"))
    narrow = (F.col("hi80") - F.col("lo80")) < 0.5 * (F.col("b_hi80") - F.col("b_lo80"))
    return rows.agg(
        F.count("*").alias("n"), F.avg(err_b - err_a).alias("mean_error_fall"),
        F.count_if(err_a < err_b).alias("helped"), F.count_if(err_a > err_b).alias("harmed"),
        F.avg(inside("b_")).alias("coverage_before"), F.avg(inside("")).alias("coverage_after"),
        F.avg((F.col("ess_fraction") < 0.05).cast("double")).alias("collapse_rate"),
        F.avg((narrow & (inside("") == 0)).cast("double")).alias("overconfident_wrong_rate"))


