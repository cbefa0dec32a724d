"""Catalogue: checks, curation, cohort files and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import checks, curate, priors, rules
from cohortlab.plans import standins as S
from cohortlab.plans.catalog_rules import MIXED, SCOPED, SUPPLIERS, config_sql, particles_sql, PRIORS, SEED, facts
from cohortlab.plans import evaluation
from cohortlab.plans.catalog_trends import POINTS, points
from cohortlab.plans.registry import R, query, rounded, table
from cohortlab.session import scratch
from cohortlab.sources import cohorts, sinks

CHECKED = f"""SELECT *, [x FOR x IN [CASE WHEN NOT coalesce(final_day > baseline_day, false) THEN 'invalid_time_order' END,
  CASE WHEN n_points < 2 THEN 'fewer_than_two_points' END] IF x IS NOT NULL] AS reasons FROM ({POINTS})"""


@query("case_checks", f"SELECT case_id, array_to_string(reasons, ',') AS reasons, len(reasons)::INT AS n_reasons FROM ({CHECKED})")
def case_checks(spark, sf):
    df = checks.with_reasons(points(spark, sf), checks.case_constraints())
    return df.select("case_id", F.concat_ws(",", "reasons").alias("reasons"), F.size("reasons").alias("n_reasons"))


@query("case_rejects", f"""SELECT case_id::VARCHAR AS case_id, 'case_validity' AS op, reasons[1] AS reason FROM ({CHECKED}) WHERE len(reasons) > 0""")
def case_rejects(spark, sf):
    df = checks.with_reasons(points(spark, sf), checks.case_constraints())
    return checks.split(df, "case_validity")[1].select("case_id", "op", "reason")


# rows of a cohort as they arrive: one per order, with the defects of the columns
# (most rows have a case of their own, every twentieth shares its customer's)
COHORT = """SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 20 = 1 THEN -o_custkey ELSE o_orderkey END AS case_id, o_orderkey,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN -1.0 ELSE o_totalprice / 8192.0::DOUBLE END AS baseline_volume_ml,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 0.0 ELSE 2.0 END::DOUBLE AS final_volume_ml,
  CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE END AS early_volume_ml, 0.0::DOUBLE AS baseline_day, (o_orderkey % 29)::DOUBLE AS final_day,
  CASE o_orderstatus WHEN 'F' THEN 'tnbc' WHEN 'O' THEN 'unknown' ELSE 'her2' END AS subtype_text,
  CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE 'chemo' END AS treatment_text, o_orderpriority LIKE '5%' AS is_demo,
  o_orderstatus = 'F' AS is_tnbc FROM orders"""
EXCLUDED = f"""SELECT *, [x FOR x IN [CASE WHEN case_id IS NULL THEN 'missing_case_id' END, CASE WHEN baseline_volume_ml IS NULL THEN 'missing_baseline_volume' END,
  CASE WHEN final_volume_ml IS NULL THEN 'missing_final_volume' END, CASE WHEN baseline_volume_ml <= 0 THEN 'non_positive_baseline_volume' END,
  CASE WHEN final_volume_ml <= 0 THEN 'non_positive_final_volume' END, CASE WHEN final_day <= baseline_day THEN 'invalid_time_order' END,
  CASE WHEN subtype_text = 'unknown' THEN 'unresolved_subtype' END, CASE WHEN contract_id <> 'tnbc_chemo' THEN 'out_of_v1a_scope' END,
  CASE WHEN is_demo THEN 'synthetic_or_demo_data' END, CASE WHEN copies > 1 THEN 'duplicate_case_id' END,
  CASE WHEN treatment_text = '' THEN 'unsupported_treatment_context' END] IF x IS NOT NULL] AS reasons
  FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS copies,
    CASE WHEN is_tnbc AND treatment_text = 'chemo' THEN 'tnbc_chemo' ELSE 'conservative_generic' END AS contract_id FROM ({COHORT}))"""


def excluded(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 20 = 1 THEN -o_custkey ELSE o_orderkey END AS case_id", "o_orderkey",
        "CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN -1.0D ELSE o_totalprice / 8192.0D END AS baseline_volume_ml",
        "CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 0.0D ELSE 2.0D END AS final_volume_ml",
        "CASE WHEN o_orderkey % 3 = 0 THEN 1.0D END AS early_volume_ml", "0.0D AS baseline_day", "cast(o_orderkey % 29 AS double) AS final_day",
        "CASE o_orderstatus WHEN 'F' THEN 'tnbc' WHEN 'O' THEN 'unknown' ELSE 'her2' END AS subtype_text",
        "CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE 'chemo' END AS treatment_text", "o_orderpriority LIKE '5%' AS is_demo",
        "o_orderstatus = 'F' AS is_tnbc")
    df = df.withColumn("contract_id", F.when(F.col("is_tnbc") & (F.col("treatment_text") == "chemo"), "tnbc_chemo").otherwise("conservative_generic"))
    return curate.exclusion_reasons(curate.flag_duplicates(df))


@query("exclusion_reasons", f"SELECT o_orderkey, array_to_string(reasons, ',') AS reasons, reasons[1] AS reason FROM ({EXCLUDED})")
def exclusion_reasons(spark, sf):
    return excluded(spark, sf).select("o_orderkey", F.concat_ws(",", "reasons").alias("reasons"), "reason")


@query("reject_reasons", f"""SELECT any_reason, count(*) AS n_rows, count(*) FILTER (any_reason = reason) AS n_first
  FROM (SELECT unnest(reasons) AS any_reason, reasons[1] AS reason FROM ({EXCLUDED})) GROUP BY any_reason""")
def reject_reasons(spark, sf):
    return curate.reason_counts(excluded(spark, sf))


@query("cohort_summary", f"""SELECT count(*) AS total_input_rows, count(*) FILTER (len(reasons) = 0) AS included_rows, count(*) FILTER (len(reasons) > 0) AS excluded_rows,
  count(*) FILTER (is_tnbc) AS tnbc_count, count(*) FILTER (NOT is_tnbc) AS non_tnbc_count, count(*) FILTER (contract_id = 'tnbc_chemo') AS v1a_in_scope_count,
  count(baseline_volume_ml) AS baseline_volume_available_count, count(final_volume_ml) AS final_volume_available_count,
  count(early_volume_ml) AS early_followup_available_count, {R('avg((subtype_text <> $$unknown$$)::INT)')} AS biomarker_completeness,
  {R('avg((early_volume_ml IS NOT NULL)::INT)')} AS mri_feature_completeness FROM ({EXCLUDED})""")
def cohort_summary(spark, sf):
    df = excluded(spark, sf).withColumns({"biomarkers_known": (F.col("subtype_text") != "unknown").cast("double"),
                                          "imaging_known": F.col("early_volume_ml").isNotNull().cast("double")})
    return rounded(curate.cohort_summary(df))


@query("scope_counts", f"""SELECT count(*) AS case_count, count(*) FILTER (in_scope) AS in_scope_case_count,
  CASE WHEN count(*) FILTER (in_scope) = 0 THEN 'no_case_in_scope' WHEN count(*) < 20 THEN 'small_cohort' END AS warning FROM ({SCOPED})""")
def scope_counts(spark, sf):
    df = rules.scope(S.customer_context(spark, sf)).agg(
        F.count("*").alias("case_count"), F.count_if(F.col("contract_id") == "tnbc_chemo").alias("in_scope_case_count"))
    return df.withColumn("warning", curate.small_cohort_warning(F.col("case_count"), F.col("in_scope_case_count")))


@query("skipped_cases", f"""SELECT c_mktsegment AS segment, CASE WHEN is_tnbc AND c_nationkey % 4 = 3 THEN 'treatment_unknown' ELSE 'outside_scope' END AS scope_warning,
  count(*) AS n FROM ({SCOPED}) WHERE NOT in_scope GROUP BY ALL""")
def skipped_cases(spark, sf):
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"))
    df = rules.scope(S.customer_context(spark, sf)).select("case_id", "contract_id", "scope_warning").join(who, "case_id")
    return df.filter(F.col("contract_id") != "tnbc_chemo").groupBy("segment", "scope_warning").agg(F.count("*").alias("n"))


# every fifth path holds one of the tokens, in either case
PATHS = "concat('cohorts/', CASE doc_id % 10 WHEN 0 THEN 'Demo' WHEN 5 THEN 'synthetic' WHEN 7 THEN 'toy_FIXTURE' ELSE 'site' END, '/', source, ' ', text)"


@query("demo_guard", f"""SELECT source, count(*) AS n_rows, count(*) FILTER (len(found) > 0) AS n_refused, coalesce(string_agg(DISTINCT found[1], ',' ORDER BY found[1]), '') AS tokens
  FROM (SELECT source, [t for t in ['demo', 'synthetic', 'simulated', 'toy', 'fixture'] if contains(lower({PATHS}), t)] AS found FROM documents) GROUP BY source""")
def demo_guard(spark, sf):
    df = table(spark, sf, "documents").select("source", checks.demo_tokens(F.expr(PATHS)).alias("found"))
    return df.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count_if(F.size("found") > 0).alias("n_refused"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.try_element_at("found", F.lit(1))))).alias("tokens"))


@query("demo_excluded", f"""SELECT lang, count(*) AS n_kept FROM documents WHERE NOT regexp_matches(lower({PATHS}), 'demo|synthetic|simulated|toy|fixture') GROUP BY lang""")
def demo_excluded(spark, sf):
    kept = checks.demo_guard(table(spark, sf, "documents"), F.expr(PATHS), "exclude")
    return kept.groupBy("lang").agg(F.count("*").alias("n_kept"))


@query("schedule_checks", f"""SELECT drug, reasons, count(*) AS n FROM (SELECT drug, concat_ws(',', CASE WHEN day < 0 THEN 'day_negative_or_missing' END,
  CASE WHEN relative_dose < 0 THEN 'dose_negative_or_missing' END, CASE WHEN drug = 'error' THEN 'decay_unknown' END) AS reasons FROM (
  SELECT drug, day - 0.5 AS day, relative_dose - 0.01 AS relative_dose FROM ({S.DOSES}))) GROUP BY drug, reasons""")
def schedule_checks(spark, sf):
    df = S.doses(spark, sf).withColumns({"day": F.col("day") - 0.5, "relative_dose": F.col("relative_dose") - 0.01})
    drugs = S.doses(spark, sf).select("drug").distinct().filter(F.col("drug") != "error").withColumn("decay", F.lit(0.1))
    got = checks.schedule_reasons(df, drugs)
    return got.groupBy("drug", F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


# headers of schedules, with the defects of the columns
HEADERS = """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_suppkey::VARCHAR END AS schedule_id, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS regimen_name,
  CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS total_duration_days, s_suppkey % 9 > 0 AS has_events FROM supplier"""


@query("schedule_headers", f"""SELECT s_suppkey, concat_ws(',', CASE WHEN schedule_id = '' THEN 'schedule_id_missing' END, CASE WHEN regimen_name IS NULL THEN 'regimen_name_missing' END,
  CASE WHEN total_duration_days IS NULL THEN 'duration_missing' END, CASE WHEN total_duration_days < 0 THEN 'duration_negative' END, CASE WHEN NOT has_events THEN 'events_missing' END) AS reasons FROM ({HEADERS})""")
def schedule_headers(spark, sf):
    """Headers written as documents, read back and checked."""
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", """to_json(named_struct('schedule_id', CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE cast(s_suppkey AS string) END,
      'regimen_name', CASE WHEN s_suppkey % 5 > 0 THEN s_name END, 'total_duration_days', CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END,
      'events', CASE WHEN s_suppkey % 9 > 0 THEN cast(array() AS array<string>) END, 'supplier', s_suppkey)) AS value""")
    return checks.header_reasons(cohorts.headers(rows, "value", ["s_suppkey"])).select("s_suppkey", F.concat_ws(",", "reasons").alias("reasons"))


@query("particle_checks", """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 23 = 0 THEN 'growth_law_unknown' END, CASE WHEN p_partkey % 6 = 0 THEN 'decay_missing' END,
  CASE WHEN g > 0.1 THEN 'growth_rate_range' END, CASE WHEN cap <= 0 THEN 'carrying_capacity_not_positive' END,
  CASE WHEN p_partkey % 6 = 0 THEN 'sensitivity_missing' END, CASE WHEN p_partkey % 6 = 0 THEN 'ec50_missing' END,
  CASE WHEN t > 1 THEN 'sensitivity_range' END, CASE WHEN r > 1 THEN 'resistant_fraction_range' END) AS errors,
  concat_ws(',', CASE WHEN g > 0.05 THEN 'high_growth_rate' END, CASE WHEN t > 0.5 THEN 'high_sensitivity' END, CASE WHEN r > 0.6 THEN 'high_resistant_fraction' END) AS warnings
  FROM (SELECT p_partkey, p_size / 256.0::DOUBLE AS g, p_retailprice - 1000 AS cap, (p_partkey % 80) / 64.0::DOUBLE AS t, (p_partkey % 70) / 64.0::DOUBLE AS r FROM part)""")
def particle_checks(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_size / 256.0D AS growth_rate", "p_retailprice - 1000 AS carrying_capacity_ml", "(p_partkey % 70) / 64.0D AS resistant_fraction",
        "0.1D AS resistant_sensitivity_scale", "0.1D AS observation_noise_fraction", "map('taxane', (p_partkey % 80) / 64.0D) AS drug_sensitivity",
        "map('taxane', 0.5D) AS drug_ec50", "map('taxane', 0.2D) AS drug_decay", "CASE p_partkey % 23 WHEN 0 THEN 'exponential' WHEN 1 THEN 'logistic' END AS growth_law",
        "CASE p_partkey % 6 WHEN 0 THEN array('taxane', 'endocrine_agent') WHEN 1 THEN array('taxane') END AS scheduled")
    got = checks.particle_reasons(df, F.col("scheduled"))
    return got.select("p_partkey", F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings"))


@query("bounds_levels", f"""SELECT layer, param, level, count(*) AS n FROM (
  SELECT layer, 'growth_rate_per_day' AS param, CASE WHEN growth > 0.1 THEN 'hard' WHEN growth BETWEEN 0.0005 AND 0.02 THEN 'normal' WHEN growth > 0.03 THEN 'high' ELSE 'outside_normal' END AS level FROM p
  UNION ALL SELECT layer, 'active_treatment_sensitivity', CASE WHEN sensitivity > 0.5 THEN 'hard' WHEN sensitivity BETWEEN 0.015 AND 0.2 THEN 'normal' WHEN sensitivity > 0.3 THEN 'high' ELSE 'outside_normal' END FROM p
  UNION ALL SELECT layer, 'resistant_fraction', CASE WHEN resistant > 0.9 THEN 'hard' WHEN resistant BETWEEN 0 AND 0.65 THEN 'normal' WHEN resistant > 0.75 THEN 'high' ELSE 'outside_normal' END FROM p)
  GROUP BY layer, param, level""".replace(" FROM p\n", f" FROM ({particles_sql(PRIORS, 50, SEED)})\n").replace(" FROM p)", f" FROM ({particles_sql(PRIORS, 50, SEED)}))"))
def bounds_levels(spark, sf):
    got = priors.particles(evaluation.layered_priors(facts(spark, sf, inside=True), ["case_id"]), 50, SEED, ["case_id", "layer"])
    long = got.select("layer", F.col("growth").alias("growth_rate_per_day"), F.col("sensitivity").alias("active_treatment_sensitivity"),
                      F.col("resistant").alias("resistant_fraction")).unpivot(["layer"], list(rules.LEARNABLE), "param", "value")
    return long.groupBy("layer", "param", checks.bound_level(F.col("param"), F.col("value")).alias("level")).agg(F.count("*").alias("n"))


@query("name_contract", """SELECT o_orderkey, concat_ws(',', CASE WHEN NOT list_contains(l, 1) THEN 'active_treatment_sensitivity' END, CASE WHEN NOT list_contains(l, 2) THEN 'growth_rate_per_day' END,
  CASE WHEN NOT list_contains(l, 3) THEN 'resistant_fraction' END) AS missing, CASE WHEN list_contains(l, 4) THEN 'drug_ec50' ELSE '' END AS unexpected,
  CASE WHEN list_contains(l, 4) THEN 'drug_ec50' ELSE '' END AS conflicts FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_linenumber) AS l FROM lineitem GROUP BY l_orderkey)""")
def name_contract(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.when(F.col("l_linenumber") <= 4, F.expr("try_element_at(map(1, 'active_treatment_sensitivity', 2, 'growth_rate_per_day', 3, 'resistant_fraction', 4, 'drug_ec50'), l_linenumber)"))).alias("names"))
    parts = checks.name_contract(F.col("names"), F.array(*[F.lit(x) for x in rules.LEARNABLE]), F.array(*[F.lit(x) for x in rules.FIXED]))
    return sets.select("o_orderkey", *[F.concat_ws(",", c).alias(k) for k, c in parts.items()])


@query("kinetics_gaps", """SELECT DISTINCT user_id AS schedule_id, event_type AS drug FROM events e
  WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.event_type = e.event_type AND k.user_id = e.user_id AND k.value > 50)""")
def kinetics_gaps(spark, sf):
    d = S.doses(spark, sf)
    return checks.kinetics_gaps(d.select("schedule_id", "drug").distinct(), d.filter(F.col("relative_dose") * 512 > 50), ["schedule_id", "drug"])


@query("grid_consistency", """WITH p AS (SELECT DISTINCT l_returnflag, l_linenumber, date_trunc('month', l_shipdate)::DATE AS day FROM lineitem),
  c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT l_returnflag, count(DISTINCT day) AS grid_days FROM p GROUP BY ALL)
  SELECT l_returnflag, count(*) AS n_particles, min(n) AS min_days, max(n) AS max_days, max(grid_days) AS grid_days, min(n) = max(grid_days) AS same_grid FROM c JOIN g USING (l_returnflag) GROUP BY l_returnflag""")
def grid_consistency(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", F.trunc("l_shipdate", "month").alias("day"))
    return checks.grid_consistency(df, ["l_returnflag"], ["l_linenumber"], "day")


# the unsafe phrases once more, written out, and three that the given texts hold
PHRASES = ("will cure", "guaranteed", "best treatment", "you should take", "clinical pcr prediction", "cancer is gone", "this treatment will work", "this treatment will cure",
           "you should choose this treatment", "guaranteed response", "and the", "on the", "que la")
PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


@query("phrase_scan", f"""SELECT kind, phrase, count(*) AS n_texts FROM (SELECT kind, unnest([p for p in {PHRASE_SQL} if contains(lower(text), p)]) AS phrase FROM (
  SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages)) GROUP BY kind, phrase""")
def phrase_scan(spark, sf):
    texts = (table(spark, sf, "documents").select(F.lit("documents").alias("kind"), "text")
             .union(table(spark, sf, "conversations").select(F.lit("conversations"), "text"))
             .union(table(spark, sf, "pages").select(F.lit("pages"), "html")))
    return checks.phrase_scan(texts, "text", (*checks.UNSAFE_PHRASES, "and the", "on the", "que la")).select("kind", F.explode("phrases").alias("phrase")).groupBy(
        "kind", "phrase").agg(F.count("*").alias("n_texts"))


# measurements as they arrive, with the defects of the columns
ARRIVING = """SELECT event_id, CASE WHEN user_id % 31 = 0 THEN '' ELSE user_id::VARCHAR END AS case_id, date_diff('day', DATE '2024-01-03', ts::DATE)::DOUBLE AS day,
  CASE event_type WHEN 'click' THEN 'manual' WHEN 'view' THEN 'mask_derived' WHEN 'purchase' THEN 'metadata' ELSE 'phone' END AS source,
  CASE WHEN event_id % 13 > 0 THEN 'high' END AS confidence, CASE WHEN event_id % 3 > 0 THEN value - 1 END AS tumor_volume_ml, CASE WHEN event_id % 4 = 0 THEN value / 10 END AS longest_diameter_cm FROM events"""


@query("document_constraints", f"""SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN case_id = '' THEN 'case_id_missing' END, CASE WHEN day < 0 THEN 'day_minimum' END,
  CASE WHEN source NOT IN ('manual', 'metadata', 'mask_derived', 'synthetic', 'demo') THEN 'source_enum' END, CASE WHEN confidence IS NULL THEN 'confidence_missing' END,
  CASE WHEN tumor_volume_ml IS NULL AND longest_diameter_cm IS NULL THEN 'any_of_volume_diameter' END, CASE WHEN tumor_volume_ml < 0 THEN 'tumor_volume_ml_minimum' END) AS reasons FROM ({ARRIVING})) GROUP BY reasons""")
def document_constraints(spark, sf):
    df = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 31 == 0, "").otherwise(F.col("user_id").cast("string")).alias("case_id"), F.datediff("ts", F.lit("2024-01-03").cast("date")).cast("double").alias("day"),
        F.when(F.col("event_type") == "click", "manual").when(F.col("event_type") == "view", "mask_derived").when(F.col("event_type") == "purchase", "metadata").otherwise("phone").alias("source"),
        F.when(F.col("event_id") % 13 > 0, "high").alias("confidence"), F.when(F.col("event_id") % 3 > 0, F.col("value") - 1).alias("tumor_volume_ml"),
        F.when(F.col("event_id") % 4 == 0, F.col("value") / 10).alias("longest_diameter_cm"), F.lit(None).cast("double").alias("true_tumor_volume_ml"))
    got = checks.with_reasons(df, checks.measurement_constraints())
    return got.groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


@query("event_constraints", f"""SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN drug = '' THEN 'drug_missing' END, CASE WHEN day < 0 THEN 'day_minimum' END,
  CASE WHEN relative_dose IS NULL THEN 'dose_minimum' END) AS reasons FROM (
  SELECT CASE WHEN drug = 'error' THEN '' ELSE drug END AS drug, day - 0.5 AS day, CASE WHEN relative_dose > 0.1 THEN relative_dose END AS relative_dose FROM ({S.DOSES}))) GROUP BY reasons""")
def event_constraints(spark, sf):
    df = S.doses(spark, sf).select(F.when(F.col("drug") == "error", "").otherwise(F.col("drug")).alias("drug"), (F.col("day") - 0.5).alias("day"),
                                   F.when(F.col("relative_dose") > 0.1, F.col("relative_dose")).alias("relative_dose"))
    got = checks.with_reasons(df, checks.event_constraints())
    return got.groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


def split_sql(key: str) -> str:
    return f"CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END", f"('0x' || substr(md5(concat_ws(':', 'split0', {key}::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


LABEL, U = split_sql("o_custkey")


@query("split_counts", f"""SELECT split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_cases FROM (SELECT o_custkey, {LABEL} AS split FROM (SELECT o_custkey, {U} AS u FROM orders)) GROUP BY split""")
def split_counts(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", curate.split_of(F.col("o_custkey")).alias("split"))
    per_case = df.groupBy("split", "o_custkey").agg(F.count("*").alias("n"))
    return per_case.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_cases"))


@query("split_leak", f"""SELECT o_custkey FROM (SELECT o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'test' ELSE {LABEL} END AS split FROM (SELECT o_custkey, o_orderkey, {U} AS u FROM orders))
  GROUP BY o_custkey HAVING count(DISTINCT split) > 1""")
def split_leak(spark, sf):
    split = F.when(F.col("o_orderkey") % 97 == 0, "test").otherwise(curate.split_of(F.col("o_custkey")))
    return curate.split_leaks(table(spark, sf, "orders").withColumn("split", split), "o_custkey", "split")


@query("feature_merge", """SELECT has_features, count(*) AS n, count(quality)::BIGINT AS n_quality FROM (SELECT doc_id, l.doc_id IS NOT NULL AS has_features, quality FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY has_features""")
def feature_merge(spark, sf):
    got = curate.merge_features(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return got.groupBy("has_features").agg(F.count("*").alias("n"), F.count("quality").alias("n_quality"))


VOXELS = """SELECT vec_id, label, (i - 1) % 4 AS x, ((i - 1) // 4) % 4 AS y, (i - 1) // 16 AS z, embedding[i]::DOUBLE AS intensity, embedding[i]::DOUBLE > 0 AS mask
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65))::INT AS i FROM embeddings)"""
BOX = [f"{f}_{c}" for c in "xyz" for f in ("min", "max")]
BOX_SQL = ", ".join(f"{b[:3]}({b[-1]}) FILTER (mask) AS {b}" for b in BOX)
MASKS = f"""SELECT vec_id, count(v) AS mask_voxels, count(*) AS total_voxels, count(v) * 0.5::DOUBLE AS volume_ml, avg(v) AS enhancement_mean, stddev_pop(v) AS enhancement_std,
  avg((v < 0.05)::INT) AS low_enhancement_fraction, avg((v >= 0.1)::INT) AS enhancing_fraction, count(*) FILTER (v >= 0.1) * 0.5::DOUBLE AS functional_tumor_volume_ml,
  avg(x) FILTER (mask) AS centroid_x, avg(y) FILTER (mask) AS centroid_y, avg(z) FILTER (mask) AS centroid_z, {BOX_SQL}, max(intensity) AS max_intensity
  FROM (SELECT *, CASE WHEN mask THEN intensity END AS v FROM ({VOXELS})) GROUP BY vec_id"""
MASK_COLS = ("enhancement_mean", "enhancement_std", "low_enhancement_fraction", "enhancing_fraction", "centroid_x", "centroid_y", "centroid_z", "max_intensity")


def masks(spark, sf):
    voxels = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select(
        "vec_id", (F.col("i") % 4).alias("x"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("y"), F.floor(F.col("i") / 16).cast("int").alias("z"),
        F.col("v").cast("double").alias("intensity"), (F.col("v") > 0).alias("mask"))
    return curate.mask_features(voxels, ["vec_id"], 0.5, 0.1, 0.05)


@query("mask_features", f"SELECT vec_id, mask_voxels, total_voxels, volume_ml, functional_tumor_volume_ml, {', '.join(BOX)}, {', '.join(f'{R(c)} AS {c}' for c in MASK_COLS)} FROM ({MASKS})")
def mask_features(spark, sf):
    return rounded(masks(spark, sf).select("vec_id", "mask_voxels", "total_voxels", "volume_ml", "functional_tumor_volume_ml", *BOX, *MASK_COLS))


@query("qc_gate", f"""SELECT vec_id, CASE WHEN mask_voxels >= 38 OR max_intensity <= 0 THEN 'failed' WHEN s >= 0.8 THEN 'high' WHEN s < 0.5 THEN 'low' ELSE 'medium' END AS qc_label,
  CASE WHEN mask_voxels >= 38 OR max_intensity <= 0 THEN 'ignore' WHEN s >= 0.8 THEN 'use' WHEN s < 0.5 THEN 'widen_only' ELSE 'use_mild_widening' END AS layer4_behavior
  FROM (SELECT *, (vec_id % 11) / 10.0 AS s FROM ({MASKS}))""")
def qc_gate(spark, sf):
    score = (F.col("vec_id") % 11) / 10.0
    level = F.when(score >= 0.8, "high").when(score < 0.5, "low").otherwise("medium")
    df = masks(spark, sf).withColumns({"spacing_mm": F.lit(1.0), "volume_ml": F.col("volume_ml") * 1.0})
    return curate.qc_gate(df, level, max_volume_ml=18.5).select("vec_id", "qc_label", "layer4_behavior")


@query("manifest_union", """SELECT source, missing_fields, count(*) AS n FROM (
  SELECT 'customers' AS source, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance' END, 'size') AS missing_fields FROM customer
  UNION ALL SELECT 'parts', concat_ws(',', 'balance') FROM part
  UNION ALL SELECT 'suppliers', concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'balance' END, 'size') FROM supplier) GROUP BY source, missing_fields""")
def manifest_union(spark, sf):
    usable = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias("balance")
    got = curate.manifest({
        "customers": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), usable("c_acctbal")),
        "parts": table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")),
        "suppliers": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), usable("s_acctbal"))}, ["balance", "size"])
    return got.groupBy("source", F.concat_ws(",", "missing_fields").alias("missing_fields")).agg(F.count("*").alias("n"))


@query("days_ordered", """SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (o_orderdate < before) AS n_falls FROM (
  SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) GROUP BY o_custkey""")
def days_ordered(spark, sf):
    return curate.days_ordered(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")


# ---- cohort files: the same JSON a file would hold, built from the tables -----------------
@query("cohort_lines", """SELECT c_custkey::VARCHAR AS case_id, 0.0::DOUBLE AS baseline_day, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE NULL END AS baseline_volume_ml,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 30.0 END::DOUBLE AS final_day, concat_ws(',', CASE WHEN NOT c_acctbal > 0 THEN 'baseline_unusable' END, CASE WHEN c_custkey % 5 = 0 THEN 'final_unusable' END,
  CASE WHEN NOT c_acctbal > 0 THEN 'non_positive_volume' END, CASE WHEN c_custkey % 5 = 0 THEN 'invalid_time_order' END) AS reasons FROM customer""")
def cohort_lines(spark, sf):
    lines = table(spark, sf, "customer").selectExpr("""to_json(named_struct('patient_id', c_custkey, 'baseline_volume_ml', CASE WHEN c_custkey % 2 = 0 THEN '' END,
      'initial_volume_ml', CASE WHEN c_acctbal > 0 THEN cast(c_acctbal AS string) ELSE 'n/a' END, 'heldout_day', CASE WHEN c_custkey % 5 <> 0 THEN 30 END, 'final_volume_ml', 2.5D)) AS value""")
    got = cohorts.cases(cohorts.rows_from_lines(lines, "value"))
    return got.select("case_id", "baseline_day", "baseline_volume_ml", "final_day", F.concat_ws(",", "reasons").alias("reasons"))


@query("cohort_documents", """SELECT o_orderkey::VARCHAR AS case_id, min(l_linenumber)::DOUBLE AS baseline_day, max(l_linenumber)::DOUBLE AS final_day, count(*)::INT AS n_points,
  CASE WHEN count(*) < 2 THEN 'fewer_than_two_points,invalid_time_order' ELSE '' END AS reasons FROM (
  SELECT DISTINCT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey""")
def cohort_documents(spark, sf):
    """Documents of one to many records: a list, an object with a list ``cases``, or single objects; a record's measurements are an order's lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("price"))
    docs = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_linenumber").alias("day"), F.col("price").alias("tumor_volume_ml"))).alias("measurements"))
    keyed = docs.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    record = F.struct(F.col("l_orderkey").alias("case_id"), "measurements")
    many = keyed.filter("l_orderkey % 3 > 0").groupBy((F.floor(F.col("l_orderkey") / 12)).alias("d")).agg(F.collect_list(record).alias("cases"))
    text = many.select(F.when(F.col("d") % 2 == 0, F.to_json("cases")).otherwise(F.to_json(F.struct("cases"))).alias("value"))
    text = text.unionByName(keyed.filter("l_orderkey % 3 = 0").select(F.to_json(record).alias("value")))
    got = cohorts.cases(cohorts.rows_from_documents(text, "value"))
    return got.select("case_id", "baseline_day", "final_day", "n_points", F.concat_ws(",", "reasons").alias("reasons"))


@query("cohort_csv", """SELECT s_suppkey::VARCHAR AS case_id, 0.0::DOUBLE AS baseline_day, s_acctbal AS baseline_volume_ml, CASE WHEN s_suppkey % 3 > 0 THEN 60.0 END::DOUBLE AS final_day,
  concat_ws(',', CASE WHEN s_suppkey % 3 = 0 THEN 'final_unusable' END, CASE WHEN s_acctbal <= 0 THEN 'non_positive_volume' END, CASE WHEN s_suppkey % 3 = 0 THEN 'invalid_time_order' END) AS reasons FROM supplier""")
def cohort_csv(spark, sf):
    """A cohort written as CSV with a header and empty cells, and read back."""
    path = f"{scratch(spark, 'cohort')}.csv"
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_acctbal").alias("baseline_volume_ml"),
                                               F.when(F.col("s_suppkey") % 3 > 0, 60).alias("final_day"), F.lit(2.5).alias("final_volume_ml"))
    rows.write.option("header", True).csv(path)
    got = cohorts.cases(cohorts.read_rows(spark, path))
    return got.select("case_id", "baseline_day", "baseline_volume_ml", "final_day", F.concat_ws(",", "reasons").alias("reasons"))


@query("schedule_documents", f"""SELECT schedule_id::VARCHAR AS schedule_id, 'regimen ' || (schedule_id % 3) AS regimen_name, 'weekly' AS schedule_type, (schedule_id % 90 + 1)::DOUBLE AS total_duration_days,
  count(*) AS n_events, {R('sum(relative_dose)', 12)} AS total_dose, count(DISTINCT drug) AS n_drugs, count(*) FILTER (day > schedule_id % 90 + 1) AS n_late FROM ({S.DOSES}) GROUP BY ALL""".replace("'weekly' AS", "CASE WHEN schedule_id % 2 = 0 THEN 'weekly' END AS"))
def schedule_documents(spark, sf):
    """Schedule documents written from the dose events (a document for each schedule and week), read back, and joined to their headers."""
    d = S.doses(spark, sf)
    per_week = d.groupBy("schedule_id", F.floor(F.col("day") / 7).alias("week")).agg(F.collect_list(F.struct("drug", "day", "relative_dose")).alias("events"))
    text = per_week.select(F.to_json(F.struct(
        F.col("schedule_id").cast("string").alias("schedule_id"), F.concat(F.lit("regimen "), (F.col("schedule_id") % 3).cast("string")).alias("regimen_name"),
        F.when(F.col("schedule_id") % 2 == 0, "weekly").alias("schedule_type"), (F.col("schedule_id") % 90 + 1).cast("double").alias("total_duration_days"), "events")).alias("value"))
    headers, events = cohorts.schedules(text, "value")
    met = cohorts.with_schedule(events, headers.distinct())
    per = met.groupBy("schedule_id", "regimen_name", "schedule_type", "total_duration_days", "drug").agg(
        F.count("*").alias("n"), F.sum("relative_dose").alias("dose"), F.count_if(F.col("day") > F.col("total_duration_days")).alias("late"))
    got = per.groupBy("schedule_id", "regimen_name", "schedule_type", "total_duration_days").agg(
        F.sum("n").alias("n_events"), F.sum("dose").alias("total_dose"), F.count("*").alias("n_drugs"), F.sum("late").alias("n_late"))
    return rounded(got, 12, ["total_dose"])


@query("lookup_long", "SELECT p_partkey::VARCHAR AS id, unnest(['anthracycline', 'taxane']) AS name, unnest([p_size::DOUBLE, p_retailprice]) AS value FROM part")
def lookup_long(spark, sf):
    docs = table(spark, sf, "part").selectExpr("""to_json(named_struct('param_set_id', cast(p_partkey AS string),
      'drug_sensitivity', map('anthracycline', cast(p_size AS double), 'taxane', p_retailprice))) AS value""")
    return cohorts.lookup(docs, "value", "param_set_id", "drug_sensitivity")


@query("alias_numbers", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN c_custkey::DOUBLE ELSE 7.0 END::DOUBLE AS value FROM customer""")
def alias_numbers(spark, sf):
    from cohortlab.functions.numeric import first_number
    df = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN cast(c_acctbal AS string) ELSE '' END AS a",
                                                 "CASE WHEN c_custkey % 3 = 1 THEN cast(c_custkey AS string) END AS b")
    return df.select("c_custkey", first_number([F.col("a"), F.col("b")], 7.0).alias("value"))


@query("suite_status", """SELECT 'order_volume' AS name, CASE WHEN count(*) > 0 THEN 'pass' ELSE 'unavailable' END AS status, 0 AS n_missing FROM orders
  UNION ALL SELECT 'never_toxic', CASE WHEN count(*) FILTER (toxic > 1) > 0 THEN 'pass' ELSE 'unavailable' END, 1 FROM labels""")
def suite_status(spark, sf):
    a = sinks.status(table(spark, sf, "orders").agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("mean_price")),
                     "order_volume", "orders seen", "n")
    b = sinks.status(table(spark, sf, "labels").agg(F.count_if(F.col("toxic") > 1).cast("double").alias("n_over")), "never_toxic", "labels over one", "n_over")
    return sinks.suite([a, b]).select("name", "status", F.size("missing_components").alias("n_missing"))
