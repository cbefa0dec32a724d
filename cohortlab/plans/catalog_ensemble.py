"""Catalogue: ensemble summaries, exposure, reweighting and identifiability."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import exposure, metrics, pairs, posterior, summarize
from cohortlab.operators.ranks import weighted_quantiles
from cohortlab.plans import standins as S
from cohortlab.plans.registry import R, query, rounded, table
from cohortlab.session import materialize
from cohortlab.sources import stored

# ---- long trajectories: line items by ship month --------------------------------------
PATHS = """SELECT l_returnflag || l_linestatus AS case_id, date_trunc('month', l_shipdate)::DATE AS day, l_extendedprice AS volume_ml FROM lineitem"""
PROBABILITIES = {"lo95": 0.025, "lo80": 0.1, "median": 0.5, "hi80": 0.9, "hi95": 0.975}
BANDS = ", ".join(f"quantile_cont(volume_ml, {p}) AS {n}" for n, p in PROBABILITIES.items())
BY_DAY = f"SELECT *, hi80 - lo80 AS width80 FROM (SELECT case_id, day, count(*) AS n, {BANDS} FROM ({PATHS}) GROUP BY case_id, day)"
NAMES = (*PROBABILITIES, "width80")


def paths(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("case_id"), F.trunc("l_shipdate", "month").alias("day"),
        F.col("l_extendedprice").alias("volume_ml"))


@query("band_by_day", f"SELECT case_id, day::VARCHAR AS day, n, {', '.join(f'{R(n)} AS {n}' for n in NAMES)} FROM ({BY_DAY})")
def band_by_day(spark, sf):
    got = summarize.bands_by_day(paths(spark, sf), ["case_id"], "day", "volume_ml")
    return rounded(got.withColumn("day", F.col("day").cast("string")))


@query("band_score", f"""SELECT case_id, arg_min(day, (-width80, day))::VARCHAR AS widest_day, {R('max(width80)')} AS widest,
  {R('avg(width80) / greatest(avg(greatest(median, 1e-9)), 1e-9)')} AS uncertainty_score FROM ({BY_DAY}) GROUP BY case_id""".replace(
    "arg_min(day, (-width80, day))", "split_part(min(printf('%020.9f', 1e9 - width80) || '|' || day::VARCHAR), '|', 2)"))
def band_score(spark, sf):
    bands = summarize.bands_by_day(paths(spark, sf), ["case_id"], "day", "volume_ml")
    got = summarize.band_score(bands, ["case_id"], "day")
    return rounded(got.withColumn("widest_day", F.col("widest_day").cast("string")))


@query("tail_share", f"""WITH l AS (SELECT *, max(day) OVER (PARTITION BY case_id) AS last_day FROM ({PATHS}))
  SELECT case_id, count(*) AS n, {', '.join(f'{R(f"quantile_cont(volume_ml, {p})")} AS {n}' for n, p in PROBABILITIES.items())},
  {R('avg((volume_ml < 20000)::INT)')} AS share_below FROM l WHERE day = last_day GROUP BY case_id""")
def tail_share(spark, sf):
    last = summarize.last_day_rows(paths(spark, sf), ["case_id"], "day")
    return rounded(summarize.tail_share(last, ["case_id"], "volume_ml", 20000.0))


PARAMS = {"growth_rate": "p_size::DOUBLE", "carrying_capacity_ml": "l_extendedprice * (1 - l_discount)", "drug_sensitivity.taxane": "l_extendedprice / 100000.0::DOUBLE + l_quantity / 7.0::DOUBLE"}
DRIVERS = " UNION ALL ".join(f"SELECT l_returnflag AS case_id, '{n}' AS param, {e} AS v, l_extendedprice AS outcome FROM lineitem JOIN part ON l_partkey = p_partkey"
                             for n, e in PARAMS.items())


@query("driver_corr", f"""SELECT case_id, param, {R('c', 7)} AS correlation, rank, rank <= 3 AND c >= 0.2 AS dominant, c < 0.1 AS prior_dominated FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, param)::INT AS rank FROM (
  SELECT case_id, param, CASE WHEN count(*) < 3 OR var_pop(v) = 0 THEN 0 ELSE abs(corr(v, outcome)) END AS c FROM ({DRIVERS}) GROUP BY case_id, param))""")
def driver_corr(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    df = table(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("case_id"), "l_quantity", "l_extendedprice", "l_discount").join(part, "l_partkey")
    long = df.select("case_id", F.col("l_extendedprice").alias("outcome"), F.explode(F.array(
        *[F.struct(F.lit(n).alias("param"), F.expr(e.replace("::DOUBLE", "D") if n != "growth_rate" else "p_size").cast("double").alias("v")) for n, e in PARAMS.items()])).alias("p")).select(
        "case_id", "outcome", "p.*")
    return rounded(summarize.driver_correlation(long, ["case_id"], "param", "v", "outcome"), 7)


@query("warning_union", f"""SELECT case_id, string_agg(DISTINCT w, '|' ORDER BY w) AS warnings FROM (
  SELECT l_returnflag AS case_id, unnest(['Exploratory simulation; parameters are not clinically validated.', CASE WHEN l_discount > 0.09 THEN 'high_growth_rate' END, CASE WHEN l_returnflag = 'R' AND l_tax > 0.07 THEN 'high_sensitivity' END]) AS w
  FROM lineitem) WHERE w IS NOT NULL GROUP BY case_id""")
def warning_union(spark, sf):
    found = F.array_compact(F.array(F.when(F.col("l_discount") > 0.09, "high_growth_rate"),
                                    F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07), "high_sensitivity")))
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("case_id"), found.alias("w"))
    got = summarize.warning_union(df, ["case_id"], "w")
    return got.select("case_id", F.concat_ws("|", "warnings").alias("warnings"))


# ---- exposure ---------------------------------------------------------------------------
TOTAL = 30.0
DECAY = "CASE drug WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.2 WHEN 'purchase' THEN 0.06 ELSE 0.16 END"
GRID = "SELECT unnest([0.0, 7.0, 14.0, 21.0, 28.0, 30.0])::DOUBLE AS grid_day"
LEVELS = f"""SELECT schedule_id, drug, grid_day, coalesce(sum(relative_dose * exp(-({DECAY})::DOUBLE * (grid_day - day))) FILTER (day <= grid_day), 0) AS exposure
  FROM ({S.DOSES}) d, ({GRID}) g GROUP BY schedule_id, drug, grid_day"""


def levels(spark, sf):
    d = S.doses(spark, sf)
    schedules = d.select("schedule_id").distinct().withColumn("total_days", F.lit(TOTAL))
    return exposure.exposure(d, schedules, F.expr(DECAY).cast("double"))


@query("exposure_grid", f"SELECT schedule_id, drug, grid_day, {R('exposure')} AS exposure FROM ({LEVELS})")
def exposure_grid(spark, sf):
    return rounded(levels(spark, sf))


@query("effect_grid", f"""SELECT schedule_id, grid_day, {R("sum(CASE WHEN exposure > 0 THEN (CASE drug WHEN 'view' THEN 0.1 ELSE 0.05 END) * exposure / (exposure + 0.5) ELSE 0 END)")} AS effect FROM ({LEVELS}) GROUP BY schedule_id, grid_day""")
def effect_grid(spark, sf):
    s = F.when(F.col("drug") == "view", 0.1).otherwise(0.05)
    return rounded(exposure.saturating_effect(levels(spark, sf), s, F.lit(0.5)))


@query("output_grid", """SELECT user_id AS schedule_id, unnest(list_sort(list_distinct(list_concat([x::DOUBLE FOR x IN range(0, t::BIGINT + 1, 7)], [t::DOUBLE])))) AS grid_day FROM (
  SELECT user_id, floor(max(value)) AS t FROM events GROUP BY user_id)""")
def output_grid(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("schedule_id")).agg(F.floor(F.max("value")).cast("double").alias("total_days"))
    return exposure.grid_rows(s)


# ---- particles with paths: embeddings, 64 days, case = label -------------------------------
PRED = "SELECT label AS case_id, vec_id AS particle_id, i AS day, 10 + 20 * embedding[i + 1]::DOUBLE AS predicted FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)"
OBS = f"SELECT case_id, day, avg(predicted) + 0.5 AS observed FROM ({PRED}) WHERE day % 8 = 7 GROUP BY case_id, day"
LOGLIK = f"""SELECT case_id, particle_id, count(*) AS n_obs, sum(-0.5 * pow((observed - predicted) / sd, 2) - ln(sd)) AS loglik FROM (
  SELECT *, greatest({{noise}} * greatest(observed, 1), 0.25) AS sd FROM ({PRED}) JOIN ({OBS}) USING (case_id, day) WHERE {{where}}) GROUP BY case_id, particle_id"""


def weights_sql(where: str = "true", noise: str = "0.2") -> str:
    return f"""SELECT case_id, particle_id, n_obs, loglik, raw / sum(raw) OVER (PARTITION BY case_id) AS weight FROM (
      SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY case_id)) AS raw FROM ({LOGLIK.format(where=where, noise=noise)}))"""


WEIGHTS = weights_sql()
#: How sharp the measurements are differs by case, so that some posteriors are wide, some narrow, some degenerate.
SHARP = "CASE case_id % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.16 WHEN 2 THEN 0.09 ELSE 0.03 END"
SHARP_WEIGHTS = weights_sql(noise=SHARP)


def predictions(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("case_id"), F.col("vec_id").alias("particle_id"), F.posexplode("embedding").alias("day", "v")).select(
        "case_id", "particle_id", F.col("day").cast("bigint").alias("day"), (10 + 20 * F.col("v").cast("double")).alias("predicted"))


def observations(pred):
    return pred.filter(F.col("day") % 8 == 7).groupBy("case_id", "day").agg((F.avg("predicted") + 0.5).alias("observed"))


def weighted(spark, sf, keep=None, noise="0.2"):
    pred = predictions(spark, sf)
    met = posterior.with_observed(pred, observations(pred), ["case_id", "day"])
    if keep is not None:
        met = met.filter(keep)
    return posterior.weights(posterior.log_likelihood(met, ["case_id"], ["particle_id"], F.expr(noise).cast("double")), ["case_id"])


@query("reweight", f"SELECT case_id, particle_id, n_obs, {R('loglik', 6)} AS loglik, {R('weight')} AS weight FROM ({WEIGHTS})")
def reweight(spark, sf):
    return rounded(rounded(weighted(spark, sf).select("case_id", "particle_id", "n_obs", "loglik", "weight"), 6, ["loglik"]), 8, ["weight"])


ESS = f"SELECT *, ess / n_particles AS ess_fraction, ess < greatest(10, 0.02 * n_particles) AS low_ess FROM (SELECT case_id, count(*) AS n_particles, 1 / sum(weight * weight) AS ess FROM ({SHARP_WEIGHTS}) GROUP BY case_id)"


@query("ess", f"SELECT case_id, n_particles, {R('ess', 6)} AS ess, {R('ess_fraction', 6)} AS ess_fraction, low_ess FROM ({ESS})")
def ess(spark, sf):
    return rounded(posterior.effective_size(weighted(spark, sf, noise=SHARP), ["case_id"]), 6)


MEANS = f"SELECT case_id, day, avg(predicted) AS prior_mean, sum(predicted * weight) AS posterior_mean FROM ({PRED}) JOIN ({WEIGHTS}) USING (case_id, particle_id) GROUP BY case_id, day"


def means(spark, sf):
    return posterior.mean_predictions(predictions(spark, sf).join(weighted(spark, sf), ["case_id", "particle_id"]), ["case_id", "day"])


@query("posterior_means", f"SELECT case_id, day, {R('prior_mean')} AS prior_mean, {R('posterior_mean')} AS posterior_mean FROM ({MEANS})")
def posterior_means(spark, sf):
    return rounded(means(spark, sf))


@query("fit_rmse", f"""SELECT case_id, {R('p', 7)} AS prior_rmse, {R('q', 7)} AS posterior_rmse, {R('CASE WHEN p > 0 THEN (p - q) / p ELSE 0 END', 7)} AS improvement_fraction FROM (
  SELECT case_id, sqrt(avg(pow(prior_mean - observed, 2))) AS p, sqrt(avg(pow(posterior_mean - observed, 2))) AS q FROM ({MEANS}) JOIN ({OBS}) USING (case_id, day) GROUP BY case_id)""")
def fit_rmse(spark, sf):
    got = means(spark, sf).join(observations(predictions(spark, sf)), ["case_id", "day"])
    return rounded(metrics.fit_rmse(got, ["case_id"]), 7)


#: One parameter that the measurements say nothing about, one that they bind (how far the path is off on the measured days), and one in between.
OFF = " + ".join(f"pow(cast(embedding[{{one}} + {7 + 8 * k}] AS double) - 0.025, 2)" for k in range(8))
PARAM = {"growth_rate": "(vec_id * 37 % 101) / 1024.0", "resistant_fraction": OFF, "drug_sensitivity.endocrine_agent": "embedding[{one} + 7]"}
PARAM_SQL = " UNION ALL ".join(f"SELECT label AS case_id, vec_id AS particle_id, '{n}' AS param, ({e.format(one=1)})::DOUBLE AS value FROM embeddings" for n, e in PARAM.items())
PW = f"SELECT * FROM ({PARAM_SQL}) JOIN ({SHARP_WEIGHTS}) USING (case_id, particle_id)"
CUM = f"SELECT *, sum(weight) OVER (PARTITION BY case_id, param ORDER BY value) AS cum, sum(weight) OVER (PARTITION BY case_id, param) AS tot FROM ({PW})"
WIDTHS = f"""SELECT *, CASE WHEN prior_width_80 > 0 THEN posterior_width_80 / prior_width_80 ELSE 1 END AS width_ratio FROM (
  SELECT case_id, param, count(*) AS n, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS prior_width_80,
    coalesce(min(value) FILTER (cum >= 0.9 * tot), max(value)) - coalesce(min(value) FILTER (cum >= 0.1 * tot), max(value)) AS posterior_width_80, max(value) - min(value) AS value_range
  FROM ({CUM}) GROUP BY case_id, param)"""


def params_long(spark, sf):
    fields = F.array(*[F.struct(F.lit(n).alias("param"), F.expr(e.format(one=0).replace("24.0", "24.0D").replace("0.025", "0.025D")).cast("double").alias("value")) for n, e in PARAM.items()])
    return table(spark, sf, "embeddings").select(F.col("label").alias("case_id"), F.col("vec_id").alias("particle_id"), F.explode(fields).alias("p")).select(
        "case_id", "particle_id", "p.*")


def params_weighted(spark, sf):
    return params_long(spark, sf).join(weighted(spark, sf, noise=SHARP), ["case_id", "particle_id"])


@query("weighted_quantile", f"""SELECT case_id, param, n, {R('prior_width_80')} AS prior_width_80, {R('posterior_width_80')} AS posterior_width_80, {R('value_range')} AS value_range, {R('width_ratio', 6)} AS width_ratio FROM ({WIDTHS})""")
def weighted_quantile(spark, sf):
    got = posterior.parameter_widths(materialize(params_weighted(spark, sf)), ["case_id", "param"])
    return rounded(rounded(got, 6, ["width_ratio"]), 8)


@query("param_posterior_means", f"SELECT case_id, param, {R('avg(value)')} AS prior_mean, {R('sum(value * weight) / sum(weight)')} AS posterior_mean FROM ({PW}) GROUP BY case_id, param")
def param_posterior_means(spark, sf):
    return rounded(params_weighted(spark, sf).groupBy("case_id", "param").agg(
        F.avg("value").alias("prior_mean"), posterior.weighted_mean("value").alias("posterior_mean")))


CLASSED = f"""SELECT case_id, param, CASE WHEN inactive OR case_id = 3 THEN 'prior-dominated' WHEN width_ratio < 0.35 AND low_ess THEN 'weakly constrained' WHEN width_ratio < 0.35 THEN 'constrained'
  WHEN width_ratio < 0.55 THEN 'weakly constrained' ELSE 'prior-dominated' END AS classification,
  CASE WHEN inactive THEN 'drug not in schedule' WHEN case_id = 3 THEN 'too few observations' WHEN width_ratio < 0.35 AND low_ess THEN 'low effective sample size' ELSE '' END AS reason
  FROM (SELECT *, param LIKE 'drug_sensitivity.endocrine%' AND case_id % 2 = 0 AS inactive FROM ({WIDTHS}) JOIN ({ESS}) USING (case_id))"""


def classed(spark, sf):
    w = materialize(weighted(spark, sf, noise=SHARP))
    long = materialize(params_long(spark, sf).join(w, ["case_id", "particle_id"]))
    widths = posterior.parameter_widths(long, ["case_id", "param"])
    got = widths.join(posterior.effective_size(w, ["case_id"]), "case_id")
    inactive = F.startswith("param", F.lit("drug_sensitivity.endocrine")) & (F.col("case_id") % 2 == 0)
    return posterior.parameter_class(got, inactive, F.when(F.col("case_id") == 3, 2).otherwise(8), F.col("low_ess"))


@query("param_class", CLASSED)
def param_class(spark, sf):
    return classed(spark, sf).select("case_id", "param", "classification", "reason")


@query("class_counts", f"""SELECT case_id, count(*) FILTER (classification = 'constrained') AS constrained, count(*) FILTER (classification = 'weakly constrained') AS weakly_constrained,
  count(*) FILTER (classification = 'prior-dominated') AS prior_dominated FROM ({CLASSED}) GROUP BY case_id""")
def class_counts(spark, sf):
    return posterior.class_counts(classed(spark, sf), ["case_id"])


@query("posterior_health", f"""SELECT case_id, n_particles, {R('ess', 6)} AS ess, {R('ess_fraction', 6)} AS ess_fraction, low_ess, {R('c', 6)} AS mean_contraction, low_ess AND ess_fraction < 0.05 AS degenerate
  FROM ({ESS}) JOIN (SELECT case_id, avg(1 - width_ratio) AS c FROM ({WIDTHS}) GROUP BY case_id) USING (case_id)""")
def posterior_health(spark, sf):
    w = materialize(weighted(spark, sf, noise=SHARP))
    widths = posterior.parameter_widths(materialize(params_long(spark, sf).join(w, ["case_id", "particle_id"])), ["case_id", "param"])
    return rounded(posterior.posterior_health(posterior.effective_size(w, ["case_id"]), widths, ["case_id"]), 6)


def interval_sql(where: str) -> str:
    return f"""SELECT case_id, coalesce(min(predicted) FILTER (cum >= 0.5 * tot), max(predicted)) AS point, coalesce(min(predicted) FILTER (cum >= 0.1 * tot), max(predicted)) AS lo80,
      coalesce(min(predicted) FILTER (cum >= 0.9 * tot), max(predicted)) AS hi80, 1 / sum(weight * weight) / count(*) AS ess_fraction FROM (
      SELECT *, sum(weight) OVER (PARTITION BY case_id ORDER BY predicted) AS cum, sum(weight) OVER (PARTITION BY case_id) AS tot
      FROM ({PRED}) JOIN ({weights_sql(where)}) USING (case_id, particle_id) WHERE day = 63) GROUP BY case_id"""


def interval(spark, sf, keep):
    pred = predictions(spark, sf).filter(F.col("day") == 63)
    rows = materialize(pred.join(weighted(spark, sf, keep), ["case_id", "particle_id"]))
    got = weighted_quantiles(rows, ["case_id"], "predicted", "weight", {"point": 0.5, "lo80": 0.1, "hi80": 0.9})
    size = posterior.effective_size(rows, ["case_id"]).select("case_id", "ess_fraction")
    truth = observations(predictions(spark, sf)).filter(F.col("day") == 63).select("case_id", "observed")
    return got.join(size, "case_id").join(truth, "case_id")


@query("update_value", f"""SELECT count(*) AS n, {R('avg(eb - ea)')} AS mean_error_fall, count(*) FILTER (ea < eb) AS helped, count(*) FILTER (ea > eb) AS harmed, {R('avg(ib)')} AS coverage_before, {R('avg(ia)')} AS coverage_after,
  {R('avg((f < 0.05)::INT)')} AS collapse_rate, {R('avg((wa < 0.5 * wb AND ia = 0)::INT)')} AS overconfident_wrong_rate FROM (
  SELECT abs(b.point - observed) AS eb, abs(a.point - observed) AS ea, (observed BETWEEN b.lo80 AND b.hi80)::INT AS ib, (observed BETWEEN a.lo80 AND a.hi80)::INT AS ia, a.ess_fraction AS f,
    a.hi80 - a.lo80 AS wa, b.hi80 - b.lo80 AS wb FROM ({interval_sql('day < 16')}) b JOIN ({interval_sql('day < 63')}) a USING (case_id) JOIN ({OBS}) o ON o.case_id = a.case_id AND o.day = 63)""")
def update_value(spark, sf):
    before, after = interval(spark, sf, F.col("day") < 16), interval(spark, sf, F.col("day") < 63)
    return rounded(posterior.update_value(before, after, ["case_id"]))


PAIR_TOLERANCE = 0.15


@query("near_equal_pairs", f"""WITH e AS (SELECT label AS case_id, vec_id AS pid, embedding::DOUBLE[] AS path, vec_id * 37 % 101 / 128.0::DOUBLE AS p1, vec_id * 91 % 97 / 128.0::DOUBLE AS p2,
    list_sum(embedding::DOUBLE[]) / 64 AS m, max(vec_id * 37 % 101 / 128.0::DOUBLE) OVER w - min(vec_id * 37 % 101 / 128.0::DOUBLE) OVER w AS r1,
    max(vec_id * 91 % 97 / 128.0::DOUBLE) OVER w - min(vec_id * 91 % 97 / 128.0::DOUBLE) OVER w AS r2 FROM embeddings WINDOW w AS (PARTITION BY label)),
  met AS (SELECT a.case_id, a.pid AS vec_id, b.pid AS partner, list_distance(a.path, b.path) / 8 / greatest((a.m + b.m) / 2, 1) AS rmse,
    (abs(a.p1 - b.p1) / greatest(a.r1, 1e-9) + abs(a.p2 - b.p2) / greatest(a.r2, 1e-9)) / 2 AS gap FROM e a JOIN e b ON a.case_id = b.case_id AND a.pid <> b.pid)
  SELECT case_id, vec_id, count(*) AS n_partners, arg_min(partner, rmse) AS closest, {R('min(rmse)')} AS trajectory_normalized_rmse
  FROM met WHERE rmse <= 0.15 AND gap >= 0.25 GROUP BY case_id, vec_id""")
def near_equal_pairs(spark, sf):
    df = table(spark, sf, "embeddings").select(
        F.col("label").alias("case_id"), "vec_id", F.col("embedding").cast("array<double>").alias("path"),
        F.expr("array(vec_id * 37 % 101 / 128.0D, vec_id * 91 % 97 / 128.0D)").alias("params"))
    return rounded(pairs.near_equal(df, "case_id", "vec_id", "path", "params", PAIR_TOLERANCE))


@query("stored_reweight", f"SELECT case_id, particle_id, n_obs, {R('loglik', 6)} AS loglik FROM ({LOGLIK.format(where='true', noise=SHARP)})")
def stored_reweight(spark, sf):
    """Predictions and observations stored by case; likelihoods from tables that meet where they lie."""
    store = stored.CaseStore(spark, 8)
    pred = predictions(spark, sf)
    store.save(pred, "predictions")
    store.save(observations(pred), "observed")
    got = store.scored("predictions", "observed", F.expr(SHARP).cast("double"))
    store.close()
    return rounded(got.select("case_id", "particle_id", "n_obs", "loglik"), 6)
