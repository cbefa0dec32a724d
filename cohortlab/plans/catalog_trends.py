"""Catalogue: key points, simple forecasts, leaderboards, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions.numeric import significant
from cohortlab.operators import metrics, trends
from cohortlab.operators.ranks import quantiles_of
from cohortlab.plans import standins as S
from cohortlab.plans.registry import R, in_nine, nine, query, rounded, table
from cohortlab.session import materialize

CUTOFF = 100.0

POINTS = f"""SELECT case_id, count(*)::BIGINT AS n_points,
  max(CASE WHEN up = 1 THEN day END) AS baseline_day, max(CASE WHEN up = 1 THEN volume_ml END) AS baseline_volume_ml,
  max(CASE WHEN up = 2 AND n > 2 THEN day END) AS early_day,
  max(CASE WHEN up = 2 AND n > 2 THEN volume_ml END) AS early_volume_ml,
  max(CASE WHEN down = 1 THEN day END) AS final_day, max(CASE WHEN down = 1 THEN volume_ml END) AS final_volume_ml
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY day, volume_ml, obs_id) AS up,
    row_number() OVER (PARTITION BY case_id ORDER BY day DESC, volume_ml DESC, obs_id DESC) AS down,
    count(*) OVER (PARTITION BY case_id) AS n FROM ({S.MEASUREMENTS})) GROUP BY case_id"""

TWO_POINT = f"""SELECT *, baseline_volume_ml AS baseline_no_change,
  CASE WHEN early_day IS NULL THEN baseline_volume_ml WHEN early_day > baseline_day THEN
    greatest(baseline_volume_ml + (early_volume_ml - baseline_volume_ml) * ((final_day - baseline_day) / (early_day - baseline_day)), 1e-6) END AS linear_early,
  CASE WHEN early_day IS NULL THEN baseline_volume_ml WHEN early_day > baseline_day
    AND ln(baseline_volume_ml) + ln(early_volume_ml / baseline_volume_ml) * ((final_day - baseline_day) / (early_day - baseline_day)) < 709.7 THEN
    greatest(baseline_volume_ml * exp(ln(early_volume_ml / baseline_volume_ml) * ((final_day - baseline_day) / (early_day - baseline_day))), 1e-6) END AS exponential_early
  FROM ({POINTS})"""

FITS = f"""SELECT case_id, count(*) FILTER (f) AS n_fit, avg(day) FILTER (f) AS mean_day, var_pop(day) FILTER (f) AS var_day,
  avg(volume_ml) FILTER (f) AS mean_volume, covar_pop(day, volume_ml) FILTER (f) AS cov_volume,
  avg(ln(greatest(volume_ml, 1e-6))) FILTER (f) AS mean_log, covar_pop(day, ln(greatest(volume_ml, 1e-6))) FILTER (f) AS cov_log,
  max(CASE WHEN NOT f AND held = 1 THEN day END) AS held_day, max(CASE WHEN NOT f AND held = 1 THEN volume_ml END) AS held_volume_ml,
  max(CASE WHEN f AND down = 1 THEN day END) AS last_day, max(CASE WHEN f AND down = 1 THEN volume_ml END) AS last_volume_ml,
  max(CASE WHEN f AND down = 2 THEN day END) AS prior_day, max(CASE WHEN f AND down = 2 THEN volume_ml END) AS prior_volume_ml
  FROM (SELECT *, day < {CUTOFF} AS f, row_number() OVER (PARTITION BY case_id, day < {CUTOFF} ORDER BY day, volume_ml, obs_id) AS held,
    row_number() OVER (PARTITION BY case_id, day < {CUTOFF} ORDER BY day DESC, volume_ml DESC, obs_id DESC) AS down
    FROM ({S.MEASUREMENTS})) GROUP BY case_id HAVING count(*) FILTER (f) > 0"""

SERIES = f"""SELECT *, greatest(last_volume_ml, 0) AS last_observation,
  CASE WHEN n_fit < 2 OR last_day = prior_day THEN greatest(last_volume_ml, 0) ELSE
    greatest(last_volume_ml + (last_volume_ml - prior_volume_ml) / (last_day - prior_day) * (held_day - last_day), 0) END AS last_slope,
  CASE WHEN var_day <= 0 THEN greatest(last_volume_ml, 0) ELSE greatest(mean_volume + cov_volume / var_day * (held_day - mean_day), 0) END AS linear,
  CASE WHEN var_day <= 0 THEN greatest(last_volume_ml, 1e-6)
    WHEN mean_log + cov_log / var_day * (held_day - mean_day) < 709.7 THEN exp(mean_log + cov_log / var_day * (held_day - mean_day)) END AS exponential
  FROM ({FITS}) WHERE held_day IS NOT NULL"""

METHODS = ("last_observation", "last_slope", "linear", "exponential")
#: Exponential forecasts span many magnitudes: they, and sums over them, are compared in nine digits.
POINTS_SQL = {m: R(m, 6) for m in METHODS[:3]} | {"exponential": nine("exponential")}
LONG = " UNION ALL ".join(f"SELECT case_id, '{m}' AS method, held_volume_ml AS observed, last_volume_ml, {e} AS point FROM s" for m, e in POINTS_SQL.items())
SERIES_LONG = f"SELECT *, abs(point - observed) AS abs_error FROM (WITH s AS ({SERIES}) {LONG})"


def points(spark, sf):
    return trends.key_points(S.measurements(spark, sf), tie="obs_id")


def series(spark, sf):
    m = S.measurements(spark, sf)
    fits = trends.series_fits(m, tie="obs_id", fit=F.col("day") < CUTOFF).filter(F.col("held_day").isNotNull())
    return trends.series_forecasts(fits, F.col("held_day"))


def series_long(spark, sf):
    return trends.long_forecasts(rounded_series(spark, sf), METHODS, ["case_id"], "held_volume_ml")


def rounded_series(spark, sf):
    # points are rounded so that methods that agree on paper tie in every engine
    return rounded(series(spark, sf), 6, list(METHODS[:3])).withColumn("exponential", significant(F.col("exponential")))


@query("trend_points", POINTS)
def trend_points(spark, sf):
    return points(spark, sf)


@query("trend_two_point", f"""SELECT case_id, baseline_no_change, {R('linear_early', 5)} AS linear_early,
  {R('ln(exponential_early)', 5)} AS ln_exponential_early FROM ({TWO_POINT})""")
def trend_two_point(spark, sf):
    df = trends.two_point_forecasts(points(spark, sf))
    return rounded(df.select("case_id", "baseline_no_change", "linear_early",
                             F.ln("exponential_early").alias("ln_exponential_early")),
                   5, ["linear_early", "ln_exponential_early"])


@query("trend_locf_slope_ols_exp", f"""SELECT case_id, n_fit, held_day, last_observation, {R('last_slope', 4)} AS last_slope,
  {R('linear', 6)} AS linear, {R('CASE WHEN exponential > 0 THEN ln(exponential) END', 6)} AS ln_exponential FROM ({SERIES})""")
def trend_series(spark, sf):
    df = series(spark, sf).select("case_id", "n_fit", "held_day", "last_observation", "last_slope", "linear",
                                  F.ln("exponential").alias("ln_exponential"))
    return rounded(rounded(df, 6, ["linear", "ln_exponential"]), 4, ["last_slope"])


@query("leaderboard_methods", f"""SELECT m.method, m.n, {nine('m.mae_ml')} AS mae_ml, {nine('m.rmse_ml')} AS rmse_ml,
  {nine('m.log_volume_rmse')} AS log_volume_rmse, {nine('m.median_ape')} AS median_ape, {nine('m.median_abs_error')} AS median_abs_error,
  coalesce(w.win_count, 0) AS win_count
  FROM (SELECT method, count(point) AS n, avg(abs_error) AS mae_ml, sqrt(avg((point - observed) * (point - observed))) AS rmse_ml,
    sqrt(avg(pow(ln(greatest(point, 1e-6)) - ln(observed), 2))) AS log_volume_rmse,
    quantile_cont(abs_error / observed, 0.5) AS median_ape, quantile_cont(abs_error, 0.5) AS median_abs_error
    FROM ({SERIES_LONG}) GROUP BY method) m
  LEFT JOIN (SELECT method, count(*) AS win_count FROM (SELECT method, row_number() OVER (PARTITION BY case_id ORDER BY abs_error, method) AS r
    FROM ({SERIES_LONG})) WHERE r = 1 GROUP BY method) w ON m.method = w.method""")
def leaderboard_methods(spark, sf):
    long = materialize(series_long(spark, sf))
    scores = metrics.forecast_metrics(long, ["method"], intervals=False)
    wins = metrics.method_comparison(long, ["case_id"]).select("method", "median_abs_error", "win_count")
    out = scores.join(wins, "method").select("method", "n", "mae_ml", "rmse_ml", "log_volume_rmse", "median_ape",
                                             "median_abs_error", "win_count")
    return in_nine(out)


@query("leaderboard_rollup", f"""SELECT region, segment, method, level, n, {nine('mae_ml')} AS mae_ml, {nine('rmse_ml')} AS rmse_ml,
  {nine('log_volume_rmse')} AS log_volume_rmse FROM (
  SELECT r_name AS region, c_mktsegment AS segment, method, grouping(r_name, c_mktsegment, method)::BIGINT AS level, count(point) AS n,
    avg(abs_error) AS mae_ml, sqrt(avg((point - observed) * (point - observed))) AS rmse_ml,
    sqrt(avg(pow(ln(greatest(point, 1e-6)) - ln(observed), 2))) AS log_volume_rmse
  FROM ({SERIES_LONG}) f JOIN customer ON case_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment, method))""")
def leaderboard_rollup(spark, sf):
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), "c_nationkey", F.col("c_mktsegment").alias("segment"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    df = rounded_series(spark, sf).join(who, "case_id").join(nation, "c_nationkey").join(region, "n_regionkey")
    long = trends.long_forecasts(df, METHODS, ["region", "segment"], "held_volume_ml")
    return in_nine(metrics.leaderboard_rollup(long, ["region", "segment", "method"]))


def score_sql(lo: str, hi: str, miss: float) -> str:
    return f"avg({hi} - {lo} + {2 / miss}::DOUBLE * (greatest({lo} - observed, 0) + greatest(observed - {hi}, 0)))"


@query("leaderboard_horizon", f"""SELECT method, horizon::VARCHAR AS horizon, grouping(method, horizon)::BIGINT AS level, count(*) AS n, {R('avg(abs(point - observed))')} AS mae_ml, {R('sqrt(avg((point - observed) * (point - observed)))')} AS rmse_ml,
  {R('sqrt(avg(pow(ln(greatest(point, 1e-6)) - ln(observed), 2)))')} AS log_volume_rmse, {R('avg(CASE WHEN lo80 IS NOT NULL THEN (observed BETWEEN lo80 AND hi80)::INT END)')} AS coverage_80,
  {R('avg(CASE WHEN lo95 IS NOT NULL THEN (observed BETWEEN lo95 AND hi95)::INT END)')} AS coverage_95, {R('avg(hi80 - lo80)')} AS width_80_ml,
  {R(score_sql('lo80', 'hi80', 0.2), 6)} AS score_80, {R(score_sql('lo95', 'hi95', 0.05), 6)} AS score_95 FROM ({S.FORECASTS}) GROUP BY ROLLUP (method, horizon)""")
def leaderboard_horizon(spark, sf):
    """Errors and interval scores by method and horizon, with the totals above them."""
    got = metrics.leaderboard_rollup(S.forecasts(spark, sf), ["method", "horizon"], intervals=True).withColumn("horizon", F.col("horizon").cast("string"))
    return rounded(rounded(got, 6, ["score_80", "score_95"]), 8, ["mae_ml", "rmse_ml", "log_volume_rmse", "coverage_80", "coverage_95", "width_80_ml"])


@query("interval_coverage", f"""SELECT method, cohort, n, {R('mae_ml')} AS mae_ml, {R('rmse_ml')} AS rmse_ml,
  {R('log_volume_rmse')} AS log_volume_rmse, {R('coverage_80')} AS coverage_80, {R('coverage_95')} AS coverage_95,
  {R('width_80_ml')} AS width_80_ml, {R('median_ape')} AS median_ape FROM (
  SELECT method, cohort, count(*) AS n, avg(abs(point - observed)) AS mae_ml, sqrt(avg((point - observed) * (point - observed))) AS rmse_ml,
    sqrt(avg(pow(ln(greatest(point, 1e-6)) - ln(observed), 2))) AS log_volume_rmse,
    avg(CASE WHEN lo80 IS NOT NULL THEN (observed BETWEEN lo80 AND hi80)::INT END) AS coverage_80,
    avg(CASE WHEN lo95 IS NOT NULL THEN (observed BETWEEN lo95 AND hi95)::INT END) AS coverage_95,
    avg(hi80 - lo80) AS width_80_ml, quantile_cont(abs(point - observed) / observed, 0.5) AS median_ape
  FROM ({S.FORECASTS}) GROUP BY method, cohort)""")
def interval_coverage(spark, sf):
    return rounded(metrics.forecast_metrics(S.forecasts(spark, sf), ["method", "cohort"]))


@query("calibration_extract", f"""SELECT method, count(*) AS n,
  {R('avg((observed BETWEEN lo80 AND hi80)::INT)')} AS coverage_80, {R('avg((observed BETWEEN lo95 AND hi95)::INT)')} AS coverage_95,
  {R('avg(hi80 - lo80)')} AS width_80_ml FROM ({S.FORECASTS}) WHERE method = 'R' GROUP BY method""")
def calibration_extract(spark, sf):
    scored = S.forecasts(spark, sf).groupBy("method").agg(F.count("point").alias("n"), *metrics.interval_sums())
    return rounded(metrics.calibration_extract(scored, "R"))


@query("layer_delta", " UNION ALL ".join(f"""SELECT '{new}_vs_{old}' AS comparison, count(*) AS n,
  count(*) FILTER (abs({old} - held_volume_ml) - abs({new} - held_volume_ml) > 0) AS helped,
  count(*) FILTER (abs({old} - held_volume_ml) - abs({new} - held_volume_ml) < 0) AS harmed,
  {R(f'avg(abs({old} - held_volume_ml) - abs({new} - held_volume_ml))', 6)} AS mean_mae_delta_ml FROM ({SERIES})"""
    for new, old in (("linear", "last_observation"), ("last_slope", "last_observation"))))
def layer_delta(spark, sf):
    pairs = [("linear_vs_last_observation", "linear", "last_observation"), ("last_slope_vs_last_observation", "last_slope", "last_observation")]
    return rounded(metrics.paired_delta(series_long(spark, sf), pairs), 6)


RUN_METRICS = {"ess": "l_quantity", "ess_fraction": "l_quantity / 64.0::DOUBLE", "fit_prior_rmse_ml": "l_extendedprice / 1000.0::DOUBLE",
               "fit_posterior_rmse_ml": "l_extendedprice * l_discount / 1000.0::DOUBLE", "rmse_improvement_fraction": "1 - l_discount",
               "posterior_heldout_error_ml": "l_extendedprice * l_tax / 1000.0::DOUBLE", "prior_heldout_error_ml": "l_extendedprice / 2000.0::DOUBLE"}
RUNS = "SELECT l_discount AS noise, ceil(l_quantity / 10)::INT AS particles, l_returnflag AS variant, " + ", ".join(
    f"{e} AS {m}" for m, e in RUN_METRICS.items()) + " FROM lineitem"


def runs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("noise"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("particles"),
        F.col("l_returnflag").alias("variant"),
        *[F.expr(e.replace("::DOUBLE", "D")).alias(m) for m, e in RUN_METRICS.items()])


@query("sweep_medians", f"""SELECT grouping, value, n_runs, {', '.join(f"{R(f'median_{m}', 9)} AS median_{m}" for m in RUN_METRICS)} FROM (
  SELECT CASE WHEN grouping(noise) = 0 THEN 'noise' WHEN grouping(particles) = 0 THEN 'particles' ELSE 'variant' END AS grouping,
    CASE WHEN grouping(noise) = 0 THEN noise::VARCHAR WHEN grouping(particles) = 0 THEN particles::VARCHAR ELSE variant END AS value,
    count(*) AS n_runs, {', '.join(f'quantile_cont({m}, 0.5) AS median_{m}' for m in RUN_METRICS)}
  FROM ({RUNS}) GROUP BY GROUPING SETS ((noise), (particles), (variant)))""")
def sweep_medians(spark, sf):
    return rounded(metrics.sweep_medians(runs(spark, sf), {"noise": "noise", "particles": "particles", "variant": "variant"},
                                         tuple(RUN_METRICS)), 9)


@query("param_stability", f"""SELECT variant, param, {R('avg(v)', 6)} AS mean, {R('coalesce(stddev_samp(v), 0)', 6)} AS stddev, min(v) AS min, max(v) AS max,
  {R('CASE WHEN avg(v) = 0 THEN 0 ELSE coalesce(stddev_samp(v), 0) / abs(avg(v)) END', 6)} AS relative_stddev FROM (
  SELECT l_returnflag AS variant, 'growth_rate' AS param, p_size / 100.0::DOUBLE AS v FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_returnflag, 'resistant_fraction', p_retailprice / 10000.0::DOUBLE FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY variant, param""")
def param_stability(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 100.0).alias("growth_rate"),
                                           (F.col("p_retailprice") / 10000.0).alias("resistant_fraction"))
    df = table(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("variant")).join(part, "l_partkey")
    long = df.unpivot(["variant"], ["growth_rate", "resistant_fraction"], "param", "v")
    return rounded(metrics.parameter_stability(long, ["variant", "param"], "v"), 6, ["mean", "stddev", "relative_stddev"])


@query("insight_rows", f"""WITH m AS (SELECT method, quantile_cont(abs_error, 0.5) AS e FROM ({SERIES_LONG}) GROUP BY method),
  v AS (SELECT variant, quantile_cont(posterior_heldout_error_ml, 0.5) AS e FROM ({RUNS}) GROUP BY variant),
  o AS (SELECT quantile_cont(ess_fraction, 0.5) AS e FROM ({RUNS}))
  SELECT 1 AS ord, 'posterior_vs_prior' AS finding, CASE WHEN (SELECT e FROM m WHERE method = 'linear') < (SELECT e FROM m WHERE method = 'last_observation')
    THEN 'improved' ELSE 'not_improved' END AS detail
  UNION ALL SELECT 2, 'ess_share', CASE WHEN (SELECT e FROM o) < 0.05 THEN 'fragile' ELSE 'not_concentrated' END
  UNION ALL SELECT 3, 'best_method', (SELECT method FROM m ORDER BY e, method LIMIT 1)
  UNION ALL SELECT 4, 'best_variant', (SELECT variant FROM v ORDER BY e, variant LIMIT 1)""")
def insight_rows(spark, sf):
    methods = quantiles_of(materialize(series_long(spark, sf)), ["method"], "abs_error", {"median_abs_error": 0.5})
    table_ = runs(spark, sf)
    variants = quantiles_of(table_, ["variant"], "posterior_heldout_error_ml", {"median_error": 0.5})
    overall = quantiles_of(table_.withColumn("g", F.lit(0)), ["g"], "ess_fraction", {"median_ess_fraction": 0.5})
    return metrics.insight_rows(methods, variants, overall, "linear", "last_observation")


@query("method_errors_long", f"""SELECT case_id, method, abs_error, abs(point - last_volume_ml) AS abs_error_to_last
  FROM ({SERIES_LONG}) WHERE point IS NOT NULL""")
def method_errors_long(spark, sf):
    long = trends.long_forecasts(rounded_series(spark, sf), METHODS, ["case_id", "last_volume_ml"], "held_volume_ml").filter("point IS NOT NULL")
    return long.select("case_id", "method", "abs_error", F.abs(F.col("point") - F.col("last_volume_ml")).alias("abs_error_to_last"))
