"""Catalogue: scope, noise, rules, priors, draws and the layered evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortlab.functions import context as C, draws, gauss, markers, numeric
from cohortlab.functions.context import Context
from cohortlab.operators import priors, rules
from cohortlab.plans import evaluation, standins as S
from cohortlab.plans.catalog_trends import POINTS, TWO_POINT, points
from cohortlab.plans.registry import R, in_nine, nine, query, rounded, table

N = 200
SEED = 2026
SCOPED = f"SELECT *, is_tnbc AND is_chemo AS in_scope FROM ({S.FACTS})"

# The rules once more, written out: layer, order, id, family, driver, SQL predicate over the facts, evidence, effects on the means (growth, sensitivity, resistance) and on the variances.
WRITTEN = (
    (3, 1, "ki67_missing_v1", "ki67", True, "ki67_missing", "missingness_policy", (), (1.25, 1, 1), 1),
    (3, 2, "ki67_low_v1", "ki67", False, "ki67 <= 5", "B", (0.70, 1, 1), (1.05, 1, 1), 2),
    (3, 3, "ki67_high_v1", "ki67", False, "ki67 >= 30", "A/B", (1.50, 1.10, 0.90), (1.10, 1, 1), 4),
    (3, 4, "grade3_high_growth_v1", "grade", False, "grade >= 3", "B", (1.15, 1, 1), (1.05, 1, 1), 2),
    (3, 5, "grade1_lower_growth_v1", "grade", False, "grade <= 1", "C", (0.90, 1, 1), (), 1),
    (3, 6, "tnbc_receptor_inconsistency_v1", "receptor_consistency", True, "receptor_positive", "data_quality_policy", (), (1.10, 1.15, 1.15), 3),
    (3, 7, "brca_hrd_positive_v1", "brca_hrd", False, "repair_positive", "B", (1, 1.15, 0.85), (1, 1.05, 1), 3),
    (3, 8, "brca_hrd_missing_v1", "brca_hrd", True, "repair_missing", "missingness_policy", (), (1, 1.10, 1.15), 2),
    (4, 1, "diameter_only_report_only_v1", "measurement_mode", True, "report_only", "data_quality_policy", (), (), 0),
    (4, 2, "low_segmentation_qc_v1", "segmentation_qc", True, "segmentation_low", "data_quality_policy", (), (1.05, 1.10, 1.10), 3),
    (4, 3, "low_registration_qc_v1", "registration_qc", True, "registration_low", "data_quality_policy", (), (1.10, 1, 1.10), 2),
    (4, 4, "high_enhancement_heterogeneity_v1", "enhancement_heterogeneity", True, "enhancement_high", "data_quality_policy", (), (1, 1, 1.25), 1),
    (4, 5, "low_enhancement_fraction_v1", "enhancement_delivery", True, "low_enhancement_high", "data_quality_policy", (), (1, 1.15, 1.20), 2),
    (4, 6, "ftv_anatomic_volume_inconsistency_v1", "mri_qc_consistency", True, "ftv_mismatch", "data_quality_policy", (), (1, 1.10, 1.10), 2))


def rule_hits_sql() -> str:
    parts = [f"SELECT case_id, {layer} AS layer, {order} AS ord, '{name}' AS rule_id, '{family}' AS rule_family, {str(driver).lower()} AS uncertainty_driver, "
             f"'{evidence}' AS evidence_level, {effects} AS n_effects FROM f WHERE {holds}" for layer, order, name, family, driver, holds, evidence, _, _, effects in WRITTEN]
    return f"WITH f AS ({SCOPED}) " + " UNION ALL ".join(parts)


def gaussian_sql(layer: int) -> str:
    """The Gaussian of a layer, written out: medians, 80% ranges, correlations."""
    z = 2 * 1.2815515655446004
    logit = lambda p: math.log(p / (1 - p))
    mean = [math.log(0.0067), math.log(0.090), logit(0.20)]
    sd = [math.log(0.0150 / 0.0030) / z, math.log(0.180 / 0.040) / z, (logit(0.45) - logit(0.08)) / z]
    rho = {(0, 1): 0.25, (0, 2): -0.05, (1, 2): -0.40, (0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}
    active = [r for r in WRITTEN if r[0] <= layer]
    case = lambda r, value, other: f"CASE WHEN {r[5]} THEN {value!r}::DOUBLE ELSE {other} END"
    shift = lambda i: [case(r, math.log(r[7][i]), 0) for r in active if r[7] and r[7][i] != 1]
    spread = lambda i: "sqrt(" + " * ".join(["1::DOUBLE", *[case(r, float(r[8][i]), 1) for r in active if r[8] and r[8][i] != 1]]) + ")"
    cols = [" + ".join([f"{mean[i]!r}::DOUBLE", *shift(i)]) + f" AS m{i}" for i in range(3)]
    cols += [f"{rho[i, j] * sd[i] * sd[j]!r}::DOUBLE * {spread(i)} * {spread(j)} AS c{i}{j}" for i in range(3) for j in range(i, 3)]
    return f"SELECT case_id, {layer} AS layer, {', '.join(cols)} FROM ({SCOPED}) WHERE in_scope AND NOT ki67_bad"


PRIORS = " UNION ALL ".join(gaussian_sql(n) for n in (2, 3, 4))


def uniforms_sql(source: str, key: str, seed: int, index: str, count: int) -> str:
    """The draws in SQL: ``u0..`` for rows of ``source`` keyed by the SQL text ``key``."""
    lanes = range(count)
    sql = (f"SELECT *, ('0x' || substr(hk, 1, 8))::BIGINT AS s_a, ('0x' || substr(hk, 9, 8))::BIGINT AS s_b "
           f"FROM (SELECT *, md5({key}) AS hk FROM ({source}))")
    step = lambda inner, f: "SELECT * REPLACE (" + ", ".join(f"{f(f'u{d}')} AS u{d}" for d in lanes) + f") FROM ({inner})"
    mix = lambda u: f"(xor({u}, {u} >> 16) * {draws.MULTIPLIER}) & {draws.MASK}"
    sql = "SELECT *, " + ", ".join(f"(s_a + {index} * {draws.LANES} + {d}) & {draws.MASK} AS u{d}" for d in lanes) + f" FROM ({sql})"
    sql = step(step(sql, mix), mix)
    sql = step(sql, lambda u: f"xor(xor({u}, {u} >> 16), s_b)")
    sql = step(step(sql, mix), mix)
    return step(sql, lambda u: f"(xor({u}, {u} >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE")


def normals_sql(source: str, key: str, seed: int, index: str, count: int) -> str:
    pairs = (count + 1) // 2
    cols = ", ".join(f"sqrt(-2 * ln(u{2 * (d // 2)})) * {'cos' if d % 2 == 0 else 'sin'}(2 * pi() * u{2 * (d // 2) + 1}) AS z{d}"
                     for d in range(count))
    return f"SELECT *, {cols} FROM ({uniforms_sql(source, key, seed, index, 2 * pairs)})"


def particles_sql(source: str, n: int, seed: int) -> str:
    fan = f"SELECT *, unnest(range({n}))::BIGINT AS particle FROM ({source})"
    z = normals_sql(fan, f"concat_ws(':', '{seed}', case_id::VARCHAR, layer::VARCHAR)", seed, "particle", 3)
    l1 = f"SELECT *, sqrt(c00) AS l00, c01 / sqrt(c00) AS l10, c02 / sqrt(c00) AS l20 FROM ({z})"
    l2 = f"SELECT *, sqrt(c11 - l10 * l10) AS l11, (c12 - l10 * l20) / sqrt(c11 - l10 * l10) AS l21 FROM ({l1})"
    l3 = f"SELECT *, sqrt(c22 - l20 * l20 - l21 * l21) AS l22 FROM ({l2})"
    return (f"SELECT *, exp(m0 + l00 * z0) AS growth, exp(m1 + l10 * z0 + l11 * z1) AS sensitivity, "
            f"1 / (1 + exp(-(m2 + l20 * z0 + l21 * z1 + l22 * z2))) AS resistant FROM ({l3})")


BAND_PROBABILITIES = {"lo95": 0.025, "lo80": 0.1, "point": 0.5, "hi80": 0.9, "hi95": 0.975}


def bands_sql(source: str, n: int, seed: int) -> str:
    volume = ("greatest(baseline_volume_ml * exp(least(greatest((growth - sensitivity * (1 - resistant)) * days, -30), 30)), 1e-6)")
    return (f"SELECT case_id, layer, " + ", ".join(f"quantile_cont({volume}, {p}) AS {name}" for name, p in BAND_PROBABILITIES.items())
            + f" FROM ({particles_sql(source, n, seed)}) GROUP BY case_id, layer")


CASES = f"SELECT * FROM ({POINTS}) WHERE n_points >= 2 AND final_day > baseline_day"
LAYERED = f"SELECT p.*, c.baseline_volume_ml, c.final_day - c.baseline_day AS days FROM ({PRIORS}) p JOIN ({CASES}) c USING (case_id)"


def case_table(spark, sf):
    return points(spark, sf).join(S.customer_context(spark, sf), "case_id")


def facts(spark, sf, inside=False):
    return evaluation.scoped(S.customer_context(spark, sf), inside=inside)


@query("scope_contract", f"""SELECT case_id, CASE WHEN in_scope THEN 'tnbc_chemo' ELSE 'conservative_generic' END AS contract_id,
  CASE WHEN in_scope THEN 3 ELSE 0 END AS n_learnable, CASE WHEN NOT in_scope THEN
    CASE WHEN is_tnbc AND c_nationkey % 4 = 3 THEN 'treatment_unknown' ELSE 'outside_scope' END END AS scope_warning FROM ({SCOPED})""")
def scope_contract(spark, sf):
    return rules.scope(S.customer_context(spark, sf)).select(
        "case_id", "contract_id", F.size("learnable").alias("n_learnable"), "scope_warning")


@query("noise_kind", f"""SELECT case_id, noise_kind, CASE noise_kind WHEN 'diameter_derived_volume' THEN 0.35 WHEN 'manual_volume' THEN 0.25 WHEN 'low_qc_mri_volume' THEN 0.20 WHEN 'high_qc_mri_volume' THEN 0.08 ELSE 0.12 END::DOUBLE
  AS log_scale_noise, CASE WHEN noise_kind = 'manual_volume' THEN 'source_unknown' END AS noise_warning FROM ({S.FACTS})""")
def noise_kind(spark, sf):
    return rules.noise_kind(S.customer_context(spark, sf), Context(), imaging=True).select("case_id", "noise_kind", "log_scale_noise", "noise_warning")


@query("measurement_noise", """SELECT event_id, CASE event_type WHEN 'click' THEN 'diameter_derived_volume' WHEN 'view' THEN 'manual_volume'
  WHEN 'purchase' THEN CASE WHEN k >= 80 THEN 'high_qc_mri_volume' WHEN k < 50 THEN 'low_qc_mri_volume' ELSE 'medium_qc_mri_volume' END
  ELSE 'manual_volume' END AS noise_kind, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'source_unknown' END AS noise_warning
  FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events)""")
def measurement_noise(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.expr("""to_variant_object(named_struct('source',
      CASE event_type WHEN 'click' THEN 'Longest-Diameter caliper' WHEN 'view' THEN 'manual_entry' WHEN 'purchase' THEN 'DCE-MRI' END,
      'segmentation_confidence', variant_get(parse_json(props), '$.k', 'int') / 100.0D))""").alias("context"))
    return rules.noise_kind(df).select("event_id", "noise_kind", "noise_warning")


@query("marker_parse", """SELECT c_custkey AS case_id, CASE c_custkey % 6 WHEN 1 THEN CASE WHEN c_acctbal / 100.0::DOUBLE BETWEEN 0 AND 100 THEN round(c_acctbal / 100.0::DOUBLE, 6) END
    WHEN 4 THEN 3.0 WHEN 2 THEN 35.0 WHEN 5 THEN 80.0 END::DOUBLE AS ki67,
  CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 4 THEN 1 END::DOUBLE AS grade,
  CASE WHEN c_nationkey % 3 = 0 THEN 'negative' WHEN c_nationkey % 3 = 1 THEN CASE WHEN c_custkey % 7 = 0 THEN 'positive' ELSE 'negative' END END AS er,
  CASE c_custkey % 11 WHEN 0 THEN 'positive' WHEN 1 THEN 'unknown' END AS her2,
  CASE c_custkey % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'unknown' END AS brca,
  CASE c_custkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'positive' WHEN 2 THEN 'unknown' END AS brca_by_word,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 10 = 8 THEN 'high' WHEN c_custkey % 10 = 6 THEN 'medium' ELSE 'low' END
    WHEN c_custkey % 4 = 1 THEN 'low' END AS segmentation_level,
  CASE WHEN c_custkey % 6 = 1 AND NOT c_acctbal / 100.0::DOUBLE BETWEEN 0 AND 100 THEN 'ki67_invalid' END AS first_error FROM customer""")
def marker_parse(spark, sf):
    ctx = Context()
    df = rules.with_facts(S.customer_context(spark, sf), ctx)
    df, x, _ = C.stage(df, {"brca": ctx.get("brca_status")})
    brca = x["brca"]
    return rounded(df.select("case_id", "ki67", F.col("grade").cast("double").alias("grade"), "er", "her2", markers.status(brca).alias("brca"),
                             markers.status(brca, word_boundary=True).alias("brca_by_word"), "segmentation_level",
                             F.try_element_at("fact_errors", F.lit(1)).alias("first_error")), 6)


@query("context_presence", """SELECT (c_custkey % 6 IN (1, 4))::INT AS numeric_key, (c_custkey % 6 IN (2, 3, 5))::INT AS text_key,
  CASE c_custkey % 6 WHEN 1 THEN 'NUMBER' WHEN 4 THEN 'NUMBER' WHEN 0 THEN 'ABSENT' ELSE 'TEXT' END AS ki67_kind,
  CASE WHEN c_nationkey % 3 = 0 THEN 'TEXT' WHEN c_nationkey % 3 = 1 THEN 'BOOLEAN' ELSE 'ABSENT' END AS er_kind, count(*) AS n
  FROM customer GROUP BY ALL""")
def context_presence(spark, sf):
    ctx = Context()
    df, x, _ = C.stage(S.customer_context(spark, sf), {
        "percent": ctx.get("ki67_percent"), "plain": ctx.get("ki67"), "ki67": ctx.first(rules.KI67), "er": ctx.first(rules.RECEPTORS["er"])})
    df = df.select(x["percent"].kind.isNotNull().cast("int").alias("numeric_key"), x["plain"].kind.isNotNull().cast("int").alias("text_key"),
                   F.coalesce(x["ki67"].kind, F.lit("ABSENT")).alias("ki67_kind"), F.coalesce(x["er"].kind, F.lit("ABSENT")).alias("er_kind"))
    return df.groupBy("numeric_key", "text_key", "ki67_kind", "er_kind").agg(F.count("*").alias("n"))


@query("rule_hits", rule_hits_sql())
def rule_hits(spark, sf):
    df = facts(spark, sf)
    hits = F.concat(rules.hits(3), rules.hits(4))
    return df.select("case_id", F.explode(hits).alias("h")).select(
        "case_id", "h.layer", "h.ord", "h.rule_id", "h.rule_family", "h.uncertainty_driver", "h.evidence_level", F.size("h.effects").alias("n_effects"))


@query("prior_shift", f"SELECT case_id, layer, {R('m0')} AS m0, {R('m1')} AS m1, {R('m2')} AS m2 FROM ({PRIORS})")
def prior_shift(spark, sf):
    return rounded(evaluation.layered_priors(facts(spark, sf), ["case_id"]).select("case_id", "layer", *gauss.MEANS))


@query("prior_cov_scaled", f"SELECT case_id, layer, {', '.join(f'{R(c)} AS {c}' for c in gauss.COVS)} FROM ({PRIORS})")
def prior_cov_scaled(spark, sf):
    return rounded(evaluation.layered_priors(facts(spark, sf), ["case_id"]).select("case_id", "layer", *gauss.COVS))


@query("psd_check", """SELECT p_partkey AS case_id, (c00 >= 0 AND c11 - a * a >= -1e-10 AND c22 - b * b - d * d >= -1e-10) AS psd
  FROM (SELECT *, (c12 - a * b) / sqrt(c11 - a * a) AS d FROM (SELECT *, c01 / sqrt(c00) AS a, c02 / sqrt(c00) AS b FROM (
  SELECT p_partkey, p_size + 2.0::DOUBLE AS c00, (p_partkey % 7) / 4.0::DOUBLE AS c01, -(p_partkey % 5) / 2.0::DOUBLE AS c02, 3.0::DOUBLE AS c11,
    (p_partkey % 11) / 4.0::DOUBLE AS c12, 2.0::DOUBLE AS c22 FROM part)))""")
def psd_check(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_partkey AS case_id", "p_size + 2.0D AS c00", "(p_partkey % 7) / 4.0D AS c01", "-(p_partkey % 5) / 2.0D AS c02",
        "3.0D AS c11", "(p_partkey % 11) / 4.0D AS c12", "2.0D AS c22")
    return gauss.with_cholesky(df).select("case_id", "psd")


@query("rule_trace", f"""SELECT c_custkey AS case_id, coalesce(rule_ids, '') AS rule_ids, coalesce(drivers, '') AS drivers, coalesce(warnings, '') AS warnings,
  CASE WHEN c_custkey % 17 = 0 THEN 'report_only' ELSE 'volume_update' END AS update_mode
  FROM customer LEFT JOIN (SELECT case_id, string_agg(rule_id, ',' ORDER BY layer, ord) AS rule_ids,
    string_agg(rule_id, ',' ORDER BY layer, ord) FILTER (uncertainty_driver) AS drivers,
    string_agg(CASE rule_id WHEN 'tnbc_receptor_inconsistency_v1' THEN 'receptors_conflict' WHEN 'diameter_only_report_only_v1' THEN 'report_only' ELSE 'ftv_conflict' END, ',' ORDER BY layer, ord DESC)
      FILTER (rule_id IN ('tnbc_receptor_inconsistency_v1', 'ftv_anatomic_volume_inconsistency_v1', 'diameter_only_report_only_v1')) AS warnings
    FROM ({rule_hits_sql()}) GROUP BY case_id) ON c_custkey = case_id""")
def rule_trace(spark, sf):
    df = rules.with_trace(facts(spark, sf), [3, 4])
    return df.select("case_id", F.concat_ws(",", "rule_ids").alias("rule_ids"),
                     F.concat_ws(",", "uncertainty_drivers").alias("drivers"), F.concat_ws(",", "warnings").alias("warnings"), "update_mode")


# what a trace says beside the numbers: conditions as text, and the noise kind that a rule names
CONDITIONS = {"ki67_missing_v1": "ki67_missing", "ki67_low_v1": "ki67 <= 5", "ki67_high_v1": "ki67 >= 30", "grade3_high_growth_v1": "grade >= 3", "grade1_lower_growth_v1": "grade <= 1",
              "tnbc_receptor_inconsistency_v1": "receptor_positive", "brca_hrd_positive_v1": "repair_positive", "brca_hrd_missing_v1": "repair_missing",
              "diameter_only_report_only_v1": "report_only", "low_segmentation_qc_v1": "segmentation_low", "low_registration_qc_v1": "registration_low",
              "high_enhancement_heterogeneity_v1": "enhancement_std >= 0.3", "low_enhancement_fraction_v1": "low_enhancement >= 0.35", "ftv_anatomic_volume_inconsistency_v1": "ftv_mismatch"}


@query("trace_content", f"""SELECT rule_id, CASE rule_id {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CONDITIONS.items())} END AS condition, count(*) AS n_cases,
  CASE WHEN rule_id = 'low_segmentation_qc_v1' THEN 'low_qc_mri_volume' END AS observation_noise, true AS explained FROM ({rule_hits_sql()}) GROUP BY rule_id""")
def trace_content(spark, sf):
    # outer, so that no filter on the size of the trace makes each trace twice; the noise is a key first, as no hash aggregation takes the largest text
    df = rules.with_trace(facts(spark, sf), [3, 4]).select(F.explode_outer("trace").alias("h")).filter("h IS NOT NULL").select("h.*")
    df = df.groupBy("rule_id", "condition", "observation_noise").agg(F.count("*").alias("n"), F.bool_and(F.length("explanation") > 20).alias("told"))
    return df.groupBy("rule_id", "condition").agg(F.sum("n").alias("n_cases"), F.max("observation_noise").alias("observation_noise"), F.bool_and("told").alias("explained"))


@query("prior_lineage", f"""SELECT layer, CASE layer WHEN 2 THEN 'layer2_population' WHEN 3 THEN 'layer3_pathology' ELSE 'layer4_mri_qc' END AS prior_version,
  CASE layer WHEN 3 THEN 'layer2_population' WHEN 4 THEN 'layer3_pathology' END AS base_prior_version, count(*) AS n_cases FROM ({PRIORS}) GROUP BY layer""")
def prior_lineage(spark, sf):
    made = evaluation.with_lineage(evaluation.layered_priors(facts(spark, sf), ["case_id"]))
    return made.groupBy("layer", "prior_version", "base_prior_version").agg(F.count("*").alias("n_cases"))


@query("transform_round_trip", f"""SELECT p_partkey AS case_id, {R('ln(g)')} AS z0, {R('ln(s)')} AS z1, {R('ln(r / (1 - r))')} AS z2, {R('r')} AS resistant_back,
  {R('cbrt(6 * p_retailprice / pi())')} AS diameter_cm
  FROM (SELECT *, p_size / 1024.0::DOUBLE AS g, p_size / 128.0::DOUBLE AS s, (p_partkey % 100 + 1) / 128.0::DOUBLE AS r FROM part)""")
def transform_round_trip(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey AS case_id", "p_size / 1024.0D AS g", "p_size / 128.0D AS s",
                                             "(p_partkey % 100 + 1) / 128.0D AS r", "p_retailprice")
    z = gauss.to_transformed(F.col("g"), F.col("s"), F.col("r"))
    df = df.withColumns({f"z{i}": e for i, e in enumerate(z)})
    back = gauss.from_transformed(F.col("z0"), F.col("z1"), F.col("z2"))[2]
    return rounded(df.select("case_id", "z0", "z1", "z2", back.alias("resistant_back"),
                             numeric.sphere_diameter_cm(F.col("p_retailprice")).alias("diameter_cm")))


@query("interval_to_normal", f"""SELECT p_partkey AS case_id, {R('ln(p_size)')} AS log_mean, {R('(ln(p_size * 2.0) - ln(p_size / 2.0)) / 2.5631031310892007')} AS log_sd
  FROM part""")
def interval_to_normal(spark, sf):
    m = F.col("p_size").cast("double")
    mean, sd = numeric.interval_to_normal(m, m / 2.0, m * 2.0, "log")
    return rounded(table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), mean.alias("log_mean"), sd.alias("log_sd")))


UNIFORM_SOURCE = "SELECT o_orderkey, o_custkey AS case_id, o_orderkey % 1000 AS counter FROM orders"
ORDER_KEY = "concat_ws(':', '7', case_id::VARCHAR)"


@query("uniform_draws", f"SELECT o_orderkey, {R('u0', 9)} AS u0, {R('u1', 9)} AS u1 FROM ({uniforms_sql(UNIFORM_SOURCE, ORDER_KEY, 7, 'counter', 2)})")
def uniform_draws(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS case_id", "o_orderkey % 1000 AS counter")
    df = draws.with_uniforms(draws.with_stream(df, ["case_id"], 7), "counter", 2)
    return rounded(df.select("o_orderkey", "u0", "u1"), 9)


def config_sql(specs, n: int, seed: int, source: str) -> str:
    rows = ", ".join(f"('{s.name}', '{s.dist}', {s.lo if s.lo is not None else 'NULL'}, {s.hi if s.hi is not None else 'NULL'}, "
                     f"{s.value if s.value is not None else 'NULL'})" for s in specs)
    base = (f"SELECT case_id, param, dist, lo::DOUBLE AS lo, hi::DOUBLE AS hi, fixed::DOUBLE AS fixed, unnest(range({n}))::BIGINT AS particle "
            f"FROM ({source}), (VALUES {rows}) s(param, dist, lo, hi, fixed)")
    u = uniforms_sql(base, f"concat_ws(':', '{seed}', case_id::VARCHAR, param)", seed, "particle", 1)
    return (f"SELECT case_id, printf('p%06d', particle) AS particle_id, param, CASE dist WHEN 'fixed' THEN fixed WHEN 'uniform' THEN lo + (hi - lo) * u0 "
            f"ELSE pow(10, log10(lo) + (log10(hi) - log10(lo)) * u0) END AS value FROM ({u})")


MIXED = tuple(priors.Spec("growth_rate", "log_uniform", 0.001, 0.014) if s.param == "growth_rate" else s for s in priors.GENERIC)
SUPPLIERS = "SELECT s_suppkey AS case_id FROM supplier"


def suppliers(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"))


@query("prior_config_draws", f"SELECT case_id, particle_id, param, {R('value')} AS value FROM ({config_sql(MIXED, 20, 11, SUPPLIERS)})")
def prior_config_draws(spark, sf):
    return rounded(priors.config_draws(suppliers(spark, sf), ["case_id"], MIXED, 20, 11))


VARIANTS = ("full", "active_drugs_only", "fixed_core", "shared_chemo_fixed_core")


@query("prior_variants", " UNION ALL ".join(f"""SELECT '{v}' AS variant, param, count(*) AS n, {R('avg(value)', 7)} AS mean_value, {R('min(value)')} AS low, {R('max(value)')} AS high
  FROM (SELECT case_id, particle_id, param, {"CASE WHEN param IN ('drug_sensitivity.anthracycline', 'drug_sensitivity.taxane') THEN avg(value) FILTER (param LIKE 'drug_sensitivity.%') OVER (PARTITION BY case_id, particle_id) ELSE value END" if v.startswith('shared') else 'value'} AS value
    FROM ({config_sql(priors.prior_variant(priors.GENERIC, v, ['anthracycline', 'taxane'], 0.12), 10, 13, SUPPLIERS)})) GROUP BY param""" for v in VARIANTS))
def prior_variants(spark, sf):
    out = None
    for v in VARIANTS:
        specs = priors.prior_variant(priors.GENERIC, v, ["anthracycline", "taxane"], 0.12)
        df = priors.config_draws(suppliers(spark, sf), ["case_id"], specs, 10, 13)
        if v == "shared_chemo_fixed_core":
            maps = df.groupBy("case_id", "particle_id").agg(F.map_from_entries(F.collect_list(F.struct(
                F.replace("param", F.lit("drug_sensitivity."), F.lit("")).alias("k"), "value"))).alias("drug_sensitivity"))
            tied = priors.tie_chemo(maps).select("case_id", "particle_id", F.explode("drug_sensitivity").alias("param", "value"))
            df = tied.withColumn("param", F.when(F.col("param").isin("anthracycline", "taxane"),
                                                 F.concat(F.lit("drug_sensitivity."), "param")).otherwise(F.col("param")))
        part = df.groupBy("param").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.min("value").alias("low"),
                                       F.max("value").alias("high")).withColumn("variant", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return rounded(rounded(out, 7, ["mean_value"]), 8, ["low", "high"])


@query("normal_particles", f"""SELECT layer, particle, count(*) AS n, {R('avg(growth)')} AS growth, {R('avg(sensitivity)')} AS sensitivity, {R('avg(resistant)')} AS resistant
  FROM ({particles_sql(PRIORS, 20, SEED)}) GROUP BY layer, particle""")
def normal_particles(spark, sf):
    long = evaluation.layered_priors(facts(spark, sf, inside=True), ["case_id"])
    got = priors.particles(long, 20, SEED, ["case_id", "layer"])
    return rounded(got.groupBy("layer", "particle").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("growth", "sensitivity", "resistant")]))


NOISY = "SELECT o_orderkey AS obs_id, o_custkey AS case_id, o_totalprice / 8192.0::DOUBLE AS v, o_orderkey AS counter FROM orders"


@query("noisy_obs", f"""SELECT obs_id, {R('greatest(0, v + greatest(0.12 * greatest(v, 1), 0.1) * z0)')} AS observed
  FROM ({normals_sql(NOISY, "concat_ws(':', '5', case_id::VARCHAR)", 5, 'counter', 1)})""")
def noisy_obs(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS obs_id", "o_custkey AS case_id", "o_totalprice / 8192.0D AS v", "o_orderkey AS counter")
    return rounded(priors.noisy_observations(df, ["case_id"], "counter", "v", 0.12, 5).select("obs_id", "observed"))


@query("adapter_fan_out", f"""SELECT layer, param, count(*) AS n, {R('avg(value)', 7)} AS mean_value FROM (
  SELECT case_id, layer, particle, unnest([{{'param': 'growth', 'value': growth}}, {{'param': 'resistant', 'value': resistant}},
    {{'param': 'drug_sensitivity.anthracycline', 'value': sensitivity}}, {{'param': 'drug_sensitivity.taxane', 'value': sensitivity}},
    {{'param': 'drug_sensitivity.endocrine_agent', 'value': 0.01::DOUBLE}}], recursive := true)
  FROM ({particles_sql(PRIORS, 10, SEED)})) GROUP BY layer, param""")
def adapter_fan_out(spark, sf):
    long = evaluation.layered_priors(facts(spark, sf, inside=True), ["case_id"])
    got = priors.particles(long, 10, SEED, ["case_id", "layer"])
    decay = {"anthracycline": 0.25, "taxane": 0.2, "endocrine_agent": 0.06}
    ec50 = {"anthracycline": 0.5, "taxane": 0.5, "endocrine_agent": 0.7}
    full = priors.fan_out_drugs(got, list(rules.ACTIVE_DRUGS), {"endocrine_agent": 0.01}, "v1_prior_particle", decay, ec50)
    flat = priors.flatten_params(full, ["case_id", "layer", "particle_id"], ["growth", "resistant"])
    return rounded(flat.groupBy("layer", "param").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")), 7)


@query("prior_predictive_bands", f"""SELECT case_id, layer, {', '.join(f'{R(b, 6)} AS {b}' for b in priors.BANDS)}
  FROM ({bands_sql(LAYERED, N, SEED)})""")
def prior_predictive_bands(spark, sf):
    """Flagship: 95/80% bands and median per case and layer from keyed particles."""
    df = evaluation.scoped(case_table(spark, sf).filter((F.col("n_points") >= 2) & (F.col("final_day") > F.col("baseline_day"))))
    df = df.withColumn("days", F.col("final_day") - F.col("baseline_day"))
    return rounded(evaluation.layer_bands(df, "case_id", N, SEED), 6)


SIMPLE = " UNION ALL ".join(
    f"SELECT case_id, '{m}' AS method, {m} AS point, final_volume_ml AS observed, NULL::DOUBLE AS lo80, NULL::DOUBLE AS hi80, "
    f"NULL::DOUBLE AS lo95, NULL::DOUBLE AS hi95 FROM t" for m in ("baseline_no_change", "linear_early", "exponential_early"))
LAYER_CASE = "CASE layer WHEN 2 THEN 'layer2_population' WHEN 3 THEN 'layer3_pathology' ELSE 'layer4_mri_qc' END"
EVAL = f"""WITH t AS (SELECT * FROM ({TWO_POINT}) WHERE n_points >= 2 AND final_day > baseline_day)
  {SIMPLE} UNION ALL SELECT b.case_id, {LAYER_CASE}, point, final_volume_ml, lo80, hi80, lo95, hi95
  FROM ({bands_sql(LAYERED, N, SEED)}) b JOIN t USING (case_id)"""


@query("layer_evaluation", f"""SELECT method, count(point) AS n, {nine('avg(abs(point - observed))')} AS mae_ml, {nine('sqrt(avg((point - observed) * (point - observed)))')} AS rmse_ml,
  {nine('sqrt(avg(pow(ln(greatest(point, 1e-6)) - ln(observed), 2)))')} AS log_volume_rmse,
  {nine('quantile_cont(abs(point - observed) / observed, 0.5)')} AS median_ape,
  {nine('avg(CASE WHEN lo80 IS NOT NULL THEN (observed BETWEEN lo80 AND hi80)::INT END)')} AS coverage_80,
  {nine('avg(CASE WHEN lo95 IS NOT NULL THEN (observed BETWEEN lo95 AND hi95)::INT END)')} AS coverage_95,
  {nine('avg(hi80 - lo80)')} AS width_80_ml FROM ({EVAL}) WHERE point IS NOT NULL GROUP BY method""")
def layer_evaluation(spark, sf):
    """The whole layered evaluation, scored per method."""
    return in_nine(evaluation.evaluate(case_table(spark, sf), n=N, seed=SEED)["metrics"])


@query("layer_helped_harmed", f"""WITH w AS (SELECT case_id, max(observed) AS o, max(CASE WHEN method = 'layer2_population' THEN abs(point - observed) END) AS e2,
  max(CASE WHEN method = 'layer3_pathology' THEN abs(point - observed) END) AS e3, max(CASE WHEN method = 'layer4_mri_qc' THEN abs(point - observed) END) AS e4
  FROM ({EVAL}) GROUP BY case_id)
  SELECT 'layer3_vs_layer2' AS comparison, count(e2) AS n, count(*) FILTER (e2 > e3) AS helped, count(*) FILTER (e2 < e3) AS harmed, {R('avg(e2 - e3)', 6)} AS mean_mae_delta_ml FROM w
  UNION ALL SELECT 'layer4_vs_layer3', count(e3), count(*) FILTER (e3 > e4), count(*) FILTER (e3 < e4), {R('avg(e3 - e4)', 6)} FROM w""")
def layer_helped_harmed(spark, sf):
    return rounded(evaluation.evaluate(case_table(spark, sf), n=N, seed=SEED)["deltas"], 6)
