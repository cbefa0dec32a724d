"""Catalogue: probability scores, calibration, rankings, edges, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import curate, outcomes, posterior, symptoms, trends
from cohortlab.plans import standins as S
from cohortlab.plans.catalog_checks import LABEL, U
from cohortlab.plans.catalog_ensemble import ESS, SHARP, WIDTHS, params_long, weighted
from cohortlab.plans.catalog_rules import SCOPED, facts
from cohortlab.plans.registry import R, query, rounded, table
from cohortlab.session import materialize

LABELLED = "SELECT lang, source, least(n_chars / 8192.0::DOUBLE, 1) AS score, quality, toxic FROM documents JOIN labels USING (doc_id)"


def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.least(F.col("n_chars") / 8192.0, F.lit(1.0)).alias("score"))
    return docs.join(table(spark, sf, "labels"), "doc_id")


@query("calibration_bins", f"SELECT lang, least(floor(score * 10), 9)::INT AS bin, count(*) AS n, {R('avg(score)')} AS mean_score, {R('avg(quality)')} AS event_rate FROM ({LABELLED}) GROUP BY lang, bin")
def calibration_bins(spark, sf):
    return rounded(outcomes.calibration_bins(labelled(spark, sf), ["lang"], "score", "quality"))


@query("calibration_error", f"""SELECT lang, sum(n)::BIGINT AS n, {R('sum(n * abs(s - e)) / sum(n)')} AS ece FROM (
  SELECT lang, least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS s, avg(quality) AS e FROM ({LABELLED}) GROUP BY lang, bin) GROUP BY lang""")
def calibration_error(spark, sf):
    return rounded(outcomes.calibration_error(outcomes.calibration_bins(labelled(spark, sf), ["lang"], "score", "quality"), ["lang"]))


@query("auc_brier", f"""SELECT lang, n, n_events, {R('brier')} AS brier, {R('tp / n_events')} AS sensitivity, {R('tn / (n - n_events)')} AS specificity,
  {R('(tp / n_events + tn / (n - n_events)) / 2')} AS balanced_accuracy, {R('(ranks - n_events * (n_events + 1) / 2) / (n_events * (n - n_events))')} AS auc FROM (
  SELECT lang, count(*) AS n, sum(quality)::BIGINT AS n_events, avg(pow(score - quality, 2)) AS brier, count(*) FILTER (quality = 1 AND score >= 0.25) AS tp,
    count(*) FILTER (quality = 0 AND score < 0.25) AS tn, sum(mid) FILTER (quality = 1) AS ranks FROM (
    SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS mid FROM ({LABELLED})) GROUP BY lang)""")
def auc_brier(spark, sf):
    df = labelled(spark, sf)
    scores = outcomes.binary_scores(df, ["lang"], "score", "quality", 0.25)
    return rounded(scores.join(outcomes.roc_auc(df, ["lang"], "score", "quality"), "lang"))


GAUSS = f"SELECT method, cohort, observed, point AS mean, point * 0.25 AS sd FROM ({S.FORECASTS})"


@query("probabilistic_scores", f"""SELECT method, cohort, count(*) AS n, {R('avg(0.9189385332046727 + ln(sd) + 0.5 * pow((observed - mean) / sd, 2))', 6)} AS nll,
  {R('avg((abs((observed - mean) / sd) <= 0.6744897501960817)::INT)')} AS coverage_50, {R('avg((abs((observed - mean) / sd) <= 1.2815515655446004)::INT)')} AS coverage_80,
  {R('avg((abs((observed - mean) / sd) <= 1.959963984540054)::INT)')} AS coverage_95, {R('avg(sd * 2 * 1.2815515655446004)', 6)} AS sharpness_80 FROM ({GAUSS}) WHERE sd > 0 GROUP BY method, cohort""")
def probabilistic_scores(spark, sf):
    df = S.forecasts(spark, sf).select("method", "cohort", "observed", F.col("point").alias("mean"), (F.col("point") * 0.25).alias("sd"))
    return rounded(rounded(outcomes.probabilistic_scores(df, ["method", "cohort"]), 6, ["nll", "sharpness_80"]), 8)


@query("conformal_width", f"""SELECT method, n, {R('half_width')} AS half_width FROM (SELECT method, count(*) OVER (PARTITION BY method) AS n, abs(observed - point) AS half_width,
  row_number() OVER (PARTITION BY method ORDER BY abs(observed - point)) AS r FROM ({S.FORECASTS}) WHERE case_id % 2 = 0) WHERE r = ceil((n + 1) * 0.8::DOUBLE)""")
def conformal_width(spark, sf):
    return rounded(outcomes.conformal_width(S.forecasts(spark, sf).filter(F.col("case_id") % 2 == 0), ["method"]))


@query("conformal_coverage", f"""WITH w AS (SELECT method, half_width FROM (SELECT method, count(*) OVER (PARTITION BY method) AS n, abs(observed - point) AS half_width,
    row_number() OVER (PARTITION BY method ORDER BY abs(observed - point)) AS r FROM ({S.FORECASTS}) WHERE case_id % 2 = 0) WHERE r = ceil((n + 1) * 0.8::DOUBLE))
  SELECT method, count(*) AS n, {R('avg((observed BETWEEN point - half_width AND point + half_width)::INT)')} AS coverage FROM ({S.FORECASTS}) JOIN w USING (method) WHERE case_id % 2 = 1 GROUP BY method""")
def conformal_coverage(spark, sf):
    df = S.forecasts(spark, sf)
    width = outcomes.conformal_width(df.filter(F.col("case_id") % 2 == 0), ["method"]).drop("n")
    met = df.filter(F.col("case_id") % 2 == 1).join(width, "method")
    inside = F.col("observed").between(F.col("point") - F.col("half_width"), F.col("point") + F.col("half_width"))
    return rounded(met.groupBy("method").agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage")))


@query("ks_two_sample", f"""SELECT method, max(na) AS n_a, max(nb) AS n_b, {R('max(abs(ca / na - cb / nb))')} AS ks FROM (
  SELECT method, observed, count(*) FILTER (cohort = 'F') OVER (PARTITION BY method ORDER BY observed) AS ca, count(*) FILTER (cohort <> 'F') OVER (PARTITION BY method ORDER BY observed) AS cb,
    count(*) FILTER (cohort = 'F') OVER (PARTITION BY method) AS na, count(*) FILTER (cohort <> 'F') OVER (PARTITION BY method) AS nb FROM ({S.FORECASTS})) GROUP BY method""")
def ks_two_sample(spark, sf):
    return rounded(outcomes.ks_two_sample(S.forecasts(spark, sf), ["method"], "observed", F.col("cohort") == "F"))


RANKS = """SELECT l_suppkey, count(*) AS n_particles, count(*) FILTER (l_extendedprice < 1000 + s_acctbal * 8) AS rank FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey"""


@query("rank_histogram", f"""SELECT bin, count(*) AS n_cases, {R('pow(count(*) - max(flat), 2) / max(flat)')} AS chi_square_part FROM (
  SELECT least(floor(rank * 10 / (n_particles + 1)), 9)::INT AS bin, count(*) OVER () / 10.0::DOUBLE AS flat FROM ({RANKS})) GROUP BY bin""")
def rank_histogram(spark, sf):
    truths = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (1000 + F.col("s_acctbal") * 8).alias("truth"), F.lit(1).alias("n"))
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    return rounded(outcomes.rank_histogram(outcomes.truth_ranks(df, truths, ["l_suppkey"], "l_extendedprice", "truth")))


UNSURE = f"""SELECT case_id, ratio, CASE WHEN score < 0.5 THEN 'low' WHEN score < 1 THEN 'moderate' ELSE 'high' END AS trajectory_uncertainty,
  CASE WHEN ratio < 0.35 THEN 'low' WHEN ratio < 0.55 THEN 'moderate' ELSE 'high' END AS parameter_uncertainty,
  CASE WHEN 1 - ess_fraction < 0.2 THEN 'low' WHEN 1 - ess_fraction < 0.5 THEN 'moderate' ELSE 'high' END AS data_quality_uncertainty,
  CASE WHEN case_id % 3 = 0 THEN 'low' WHEN case_id % 3 = 1 THEN 'moderate' ELSE 'high' END AS missing_data_uncertainty
  FROM (SELECT case_id, avg(width_ratio) AS ratio, case_id / 8.0 AS score FROM ({WIDTHS}) GROUP BY case_id) JOIN ({ESS}) USING (case_id)"""


@query("uncertainty_components", f"""SELECT case_id, {R('ratio', 6)} AS mean_width_ratio, trajectory_uncertainty, parameter_uncertainty, data_quality_uncertainty, missing_data_uncertainty,
  concat_ws(',', CASE WHEN trajectory_uncertainty = 'high' THEN 'trajectory' END, CASE WHEN parameter_uncertainty = 'high' THEN 'parameter' END,
    CASE WHEN data_quality_uncertainty = 'high' THEN 'data_quality' END, CASE WHEN missing_data_uncertainty = 'high' THEN 'missing_data' END) AS top_drivers FROM ({UNSURE})""")
def uncertainty_components(spark, sf):
    w = materialize(weighted(spark, sf, noise=SHARP))
    widths = posterior.parameter_widths(materialize(params_long(spark, sf).join(w, ["case_id", "particle_id"])), ["case_id", "param"])
    df = widths.groupBy("case_id").agg(F.avg("width_ratio").alias("mean_width_ratio")).join(posterior.effective_size(w, ["case_id"]), "case_id")
    df = df.withColumns({"uncertainty_score": F.col("case_id") / 8.0, "qc_share": F.col("ess_fraction"),
                         "completeness": F.when(F.col("case_id") % 3 == 0, 0.9).when(F.col("case_id") % 3 == 1, 0.6).otherwise(0.3)})
    got = outcomes.uncertainty_components(df).withColumn("top_drivers", F.concat_ws(",", "top_drivers"))
    return rounded(got.select("case_id", "mean_width_ratio", *[f"{n}_uncertainty" for n in ("trajectory", "parameter", "data_quality", "missing_data")], "top_drivers"), 6)


@query("missing_value_rank", f"""SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, item)::INT AS rank, item, {R('value')} AS value FROM (
  SELECT case_id, 'early_mri' AS item, 1.0 * u AS value FROM (SELECT *, (k % 16) / 16.0::DOUBLE + 0.5 AS u FROM ({SCOPED})) WHERE k % 3 = 0
  UNION ALL SELECT case_id, 'brca_hrd', 0.8 * u FROM (SELECT *, (k % 16) / 16.0::DOUBLE + 0.5 AS u FROM ({SCOPED})) WHERE repair_missing
  UNION ALL SELECT case_id, 'ki67', 0.6 * u FROM (SELECT *, (k % 16) / 16.0::DOUBLE + 0.5 AS u FROM ({SCOPED})) WHERE ki67_missing
  UNION ALL SELECT case_id, 'segmentation_review', 0.4 * u FROM (SELECT *, (k % 16) / 16.0::DOUBLE + 0.5 AS u FROM ({SCOPED})) WHERE segmentation_low)""")
def missing_value_rank(spark, sf):
    df = facts(spark, sf).withColumn("u", (F.col("case_id") % 16) / 16.0 + 0.5)
    return rounded(outcomes.missing_value_rank(df, "case_id", {
        "early_mri": F.col("case_id") % 3 == 0, "brca_hrd": F.col("repair_missing"), "ki67": F.col("ki67_missing"),
        "segmentation_review": F.coalesce("segmentation_low", F.lit(False))}, "u"))


@query("scenario_rank", f"""SELECT nation, scenario, {R('tradeoff', 6)} AS tradeoff, row_number() OVER (PARTITION BY nation ORDER BY tradeoff DESC, scenario)::INT AS rank FROM (
  SELECT c_nationkey AS nation, o_orderpriority AS scenario, avg(o_totalprice) / 65536.0 - 0.5 * avg((o_orderstatus = 'F')::INT) - 0.25 * coalesce(stddev_samp(o_totalprice), 0) / 65536.0 AS tradeoff
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""")
def scenario_rank(spark, sf):
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    scored = table(spark, sf, "orders").join(who, "o_custkey").groupBy("nation", F.col("o_orderpriority").alias("scenario")).agg(
        (F.avg("o_totalprice") / 65536.0).alias("response"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("toxicity"),
        (F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)) / 65536.0).alias("uncertainty"))
    return rounded(outcomes.scenario_rank(scored, ["nation"]).select("nation", "scenario", "tradeoff", "rank"), 6)


@query("edge_rollup", f"""SELECT case_id, phenotype, {R('sum(shift)')} AS shift, count(DISTINCT gene) AS n_genes FROM (
  SELECT l_orderkey AS case_id, l_suppkey AS gene, coalesce(CASE WHEN s_acctbal >= 0 THEN r_name END, 'missing_driver') AS phenotype,
    coalesce(CASE WHEN s_acctbal >= 0 THEN l_discount * s_acctbal / 1000.0::DOUBLE * (n_nationkey % 3 - 1) END, 0) AS shift
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY case_id, phenotype""")
def edge_rollup(spark, sf):
    genes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("gene"), F.col("l_discount").alias("effect"))
    first = table(spark, sf, "supplier").filter(F.col("s_acctbal") >= 0).select(
        F.col("s_suppkey").alias("gene"), F.col("s_nationkey").alias("pathway"), (F.col("s_acctbal") / 1000.0).alias("gene_weight"))
    second = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("pathway"), F.col("r_name").alias("phenotype"), (F.col("n_nationkey") % 3 - 1).cast("double").alias("pathway_weight"))
    return rounded(outcomes.edge_rollup(genes, first, second))


@query("output_audit", """SELECT role, rule, count(*) AS n FROM (SELECT role, unnest([CASE WHEN contains(t, 'tion') AND NOT contains(t, 'the') THEN 'disclaimer_missing' END,
  CASE WHEN contains(t, 'tion') AND NOT contains(t, 'on the') THEN 'uncertainty_missing' END, CASE WHEN contains(t, 'guaranteed') THEN 'claim: guaranteed' END,
  CASE WHEN contains(t, 'que la') THEN 'claim: que la' END]) AS rule FROM (SELECT role, lower(text) AS t FROM conversations)) WHERE rule IS NOT NULL GROUP BY role, rule""")
def output_audit(spark, sf):
    got = outcomes.output_audit(table(spark, sf, "conversations"), "text", "the", "tion", "on the", ("guaranteed", "que la"))
    return got.select("role", F.explode("broken_rules").alias("rule")).groupBy("role", "rule").agg(F.count("*").alias("n"))


BASED = f"""SELECT *, first_value(volume_ml) OVER (PARTITION BY case_id ORDER BY day, obs_id) AS baseline_volume_ml, first_value(day) OVER (PARTITION BY case_id ORDER BY day, obs_id) AS baseline_day FROM ({S.MEASUREMENTS})"""


def based(spark, sf):
    first = symptoms.baseline_attached(S.measurements(spark, sf), ["case_id"], "day", "obs_id", "volume_ml", "baseline_volume_ml")
    return symptoms.baseline_attached(first, ["case_id"], "day", "obs_id", "day", "baseline_day")


@query("change_features", f"""SELECT obs_id, {R('100 * (volume_ml - baseline_volume_ml) / baseline_volume_ml', 6)} AS percent_change, {R('ln(volume_ml / baseline_volume_ml)')} AS log_change,
  {R('CASE WHEN day <> baseline_day THEN ln(volume_ml / baseline_volume_ml) / (day - baseline_day) END', 7)} AS response_slope FROM ({BASED})""")
def change_features(spark, sf):
    got = trends.change_features(based(spark, sf)).select("obs_id", "percent_change", "log_change", "response_slope")
    return rounded(rounded(rounded(got, 6, ["percent_change"]), 8, ["log_change"]), 7, ["response_slope"])


@query("stratum_curves", f"""SELECT segment, day_bin, {R('avg(volume_ml / baseline_volume_ml)', 6)} AS mean_ratio, count(*) AS n_rows FROM (
  SELECT c_mktsegment AS segment, floor(day / 8)::BIGINT AS day_bin, volume_ml, baseline_volume_ml, {LABEL} AS split FROM (
    SELECT *, {U.replace('o_custkey', 'case_id')} AS u FROM ({BASED}) JOIN customer ON case_id = c_custkey)) WHERE split = 'train' GROUP BY segment, day_bin""")
def stratum_curves(spark, sf):
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"))
    df = based(spark, sf).join(who, "case_id")
    return rounded(curate.stratum_curves(df, ["segment"], "day", 8, curate.split_of(F.col("case_id")) == "train"), 6)
