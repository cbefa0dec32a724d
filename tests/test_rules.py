"""Markers, scope, noise and rules on small contexts."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import markers
from cohortlab.functions.context import Context, stage
from cohortlab.functions.gauss import COVS, MEANS
from cohortlab.operators import checks, priors, rules
from cohortlab.plans import evaluation
from cohortlab.plans.catalog_rules import trace_content
from cohortlab.sources import cohorts


def contexts(spark, items):
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(items)], "case_id long, js string")
    return df.select("case_id", F.parse_json("js").alias("context"))


def marker(spark, values, fn, absent=True):
    df = contexts(spark, [{"k": v} for v in values] + ([{}] if absent else []))
    df, x, _ = stage(df, {"k": Context().get("k")})
    out = fn(x["k"])
    cols = out if isinstance(out, tuple) else (out,)
    rows = df.select("case_id", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).orderBy("case_id").collect()
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in rows]


def test_percent_over_the_null_matrix(spark):
    got = marker(spark, [5, 5.1, 29.9, 30, 101, -1, None, "", "unknown", True, "35%", " 80 ", "high"], markers.percent)
    assert got == [(5.0, False), (5.1, False), (29.9, False), (30.0, False), (None, True), (None, True), (None, False), (None, False),
                   (None, False), (None, True), (35.0, False), (80.0, False), (None, True), (None, False)]


def test_grade_forms(spark):
    got = marker(spark, [1, 2.0, 2.5, 4, "iii", "II", "Grade 3", "grade 3.0", "high", "unknown", None, True], markers.grade)
    assert got == [(1, False), (2, False), (None, True), (None, True), (3, False), (2, False), (3, False), (3, False), (None, True),
                   (None, False), (None, False), (None, True), (None, False)]


def test_status_forms_and_the_hyphen_quirk(spark):
    values = [True, False, "Positive", "wild_type", "BRCA1-positive", "HRD+", "pending", "odd", None, "not detected"]
    assert marker(spark, values, markers.status) == ["positive", "negative", "positive", "negative", "negative", "positive", "unknown", "unknown", None,
                                                    "negative", None]
    assert marker(spark, ["BRCA1-positive"], lambda v: markers.status(v, word_boundary=True), absent=False) == ["positive"]


def test_qc_level_edges(spark):
    assert marker(spark, [0.49, 0.50, 0.79, 0.80, 2, "Low-quality", "good", "so so", None], markers.qc_level) == [
        "low", "medium", "medium", "high", None, "low", "high", None, None, None]


def test_first_present_key_wins_even_when_null_and_nested_wins(spark):
    df = contexts(spark, [{"a": None, "b": 3}, {"b": 3}, {"a": 1, "pathology": {"a": 2}}, {"a": 1, "biomarkers": {"a": 9}, "pathology": {"a": 2}}])
    df, x, _ = stage(df, {"ab": Context().first(("a", "b"))})
    assert [(r[0], r[1]) for r in df.orderBy("case_id").select(x["ab"].kind, x["ab"].number).collect()] == [
        ("NULL", None), ("NUMBER", 3.0), ("NUMBER", 2.0), ("NUMBER", 9.0)]


def test_each_object_is_opened_once_however_many_keys_are_wanted(spark):
    df = contexts(spark, [{"a": 1, "pathology": {"c": None, "d": [2]}, "mri_features": {"a": "x"}, "biomarkers": 5}, {"b": True, "biomarkers": {"c": 7}}, [1], None])
    ctx = Context()
    looked_up = lambda keys: stage(df, {k: ctx.get(k) for k in keys})[0].select(
        "case_id", *[f"x_{k}" for k in keys])._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get(")
    assert looked_up("abcd") == looked_up("a")
    df, x, _ = stage(df, {k: ctx.get(k) for k in "abcd"})
    got = df.orderBy("case_id").select(*[x[k].kind for k in "abcd"], *[x[k].text for k in "abc"], x["d"].listed).collect()
    assert [tuple(r) for r in got] == [("TEXT", None, "NULL", "OTHER", "x", None, None, "2"), (None, "BOOLEAN", "NUMBER", None, None, "true", "7", None),
                                       (None,) * 8, (None,) * 8]


def test_no_generated_method_is_too_long_for_the_jvm_to_compile(spark):
    df = rules.with_facts(contexts(spark, [{"ki67": "35%", "pathology": {"grade": 3}}]))
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_texts_of_markers_are_normalised_once_and_objects_opened_straight_from_the_context(spark):
    items = [{"er_status": "Not_Detected", "pathology": {"tumor_grade": "Grade  3"}, "biomarkers": {"brca_status": "no_mutation", "hrd_status": None}, "mri_features": {"segmentation_qc": "Manual-Review", "registration_qc": 0.9}},
             {"pathology": None, "mri_features": 3, "ki67": "35 %", "brca1_status": "PENDING"}]
    df = rules.with_facts(contexts(spark, items))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 8 and "try_variant_get(try_variant_get(" not in plan
    got = df.orderBy("case_id").select("er", "grade", "repair", "segmentation_level", "registration_level", "ki67").collect()
    assert [tuple(r) for r in got] == [("negative", 3, ["negative"], "low", "high", None), (None, None, ["unknown"], None, None, 35.0)]


def test_cases_out_of_scope_may_go_before_their_facts_are_read(spark):
    tnbc = {"subtype": "TNBC", "treatment_regimen": "weekly_paclitaxel"}
    df = contexts(spark, [tnbc, tnbc | {"ki67": 40}, {"subtype": "TNBC"}, {"subtype": "HR positive", "treatment_regimen": "taxane"}, None, tnbc | {"grade": "odd"}, tnbc])
    df = df.withColumn("case_id", F.when(F.col("case_id") < 6, F.col("case_id")))
    whole, inside = evaluation.scoped(df), evaluation.scoped(df, inside=True)
    assert sorted(map(str, inside.collect())) == sorted(map(str, whole.filter("contract_id = 'tnbc_chemo'").collect())) and inside.count() == 4
    priors_of = lambda d: sorted(map(str, evaluation.layered_priors(d, ["case_id"]).collect()))
    assert priors_of(inside) == priors_of(whole) and len(priors_of(inside)) == 9
    plan = inside._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ki67_percent") < plan.index("Filter (") < plan.index("schedule_type"), "facts are read above the filter, the scope below it"


def test_kinds_of_all_scalars(spark):
    df = contexts(spark, [{"k": v} for v in (True, 7, 2.5, 1e300, 10**12, "x", "", None, [1], {"a": 1})] + [{}])
    df, x, _ = stage(df, {"k": Context().get("k")})
    got = df.orderBy("case_id").select(x["k"].kind, x["k"].text, x["k"].number).collect()
    assert [r[0] for r in got] == ["BOOLEAN", "NUMBER", "NUMBER", "NUMBER", "NUMBER", "TEXT", "TEXT", "NULL", "OTHER", "OTHER", None]
    assert [r[2] for r in got] == [None, 7.0, 2.5, 1e300, 1e12, None, None, None, None, None, None]


def test_keys_that_differ_in_case_or_name_a_path(spark):
    ctx = Context()
    df, x, _ = stage(contexts(spark, [{"k": 1, "K": 2, "m": {"n": 3}, "pathology": {"K": 4}}, {"K": 5, "m.n": 6}]), {
        "small": ctx.get("k"), "large": ctx.get("K"), "both": ctx.first(("k", "K")), "path": ctx.get("m.n")})
    got = df.orderBy("case_id").select(*[x[n].number for n in ("small", "large", "both", "path")]).collect()
    assert [tuple(r) for r in got] == [(1.0, 4.0, 1.0, 3.0), (None, 5.0, 5.0, None)]


def test_scope(spark):
    df = rules.scope(contexts(spark, [
        {"subtype": "Triple_Negative", "treatment_regimen": "AC-T"}, {"subtype": "tnbc"}, {"subtype": "TNBC", "treatment_context": "unknown"},
        {"subtype": "her2", "treatment_regimen": "chemotherapy"}]))
    assert [(r["contract_id"], r["scope_warning"]) for r in df.orderBy("case_id").collect()] == [
        ("tnbc_chemo", None), ("conservative_generic", "treatment_unknown"), ("conservative_generic", "treatment_unknown"),
        ("conservative_generic", "outside_scope")]


def test_noise_policy(spark):
    df = contexts(spark, [
        {"source": "longest-diameter"}, {"source": "manual MRI"}, {"source": "DCE-MRI", "segmentation_confidence": 0.9},
        {"source": "mri", "segmentation_confidence": 0.4}, {"source": "mri", "qc": "motion"}, {"source": "mri", "qc_flags": ["Manual_review"]},
        {"source": "mri", "qc": "good"}, {"source": "mri"}, {}, {"longest_diameter_cm": 2.0}, {"derived_from_diameter": True, "source": "mri"}])
    got = rules.noise_kind(df).orderBy("case_id").collect()
    assert [r["noise_kind"] for r in got] == [
        "diameter_derived_volume", "manual_volume", "high_qc_mri_volume", "low_qc_mri_volume", "low_qc_mri_volume", "low_qc_mri_volume",
        "high_qc_mri_volume", "medium_qc_mri_volume", "manual_volume", "diameter_derived_volume", "diameter_derived_volume"]
    assert [r["noise_warning"] for r in got][8] == "source_unknown" and got[0]["log_scale_noise"] == 0.35


def test_imaging_defaults_fill_absent_keys_only(spark):
    df = contexts(spark, [{"volume_ml": 3.0, "segmentation_qc": 0.9}, {"diameter_cm": 3.0}, {"volume_ml": 3.0, "source": "manual"},
                          {"volume_ml": 3.0, "segmentation_quality": "poor"}])
    got = [r["noise_kind"] for r in rules.noise_kind(df, Context(), imaging=True).orderBy("case_id").collect()]
    assert got == ["high_qc_mri_volume", "diameter_derived_volume", "manual_volume", "low_qc_mri_volume"]


def hits(spark, items):
    df = rules.with_facts(contexts(spark, items))
    df = rules.with_trace(df, [3, 4])
    return df.orderBy("case_id").select("rule_ids", "uncertainty_drivers", "warnings", "fact_errors").collect()


def test_rules_hold_where_they_should(spark):
    quiet = {"ki67_percent": 10, "brca_status": "negative"}
    got = hits(spark, [
        quiet, {"brca_status": "negative"}, {**quiet, "ki67_percent": 5}, {**quiet, "ki67_percent": 30}, {**quiet, "grade": 3},
        {**quiet, "grade": "i"}, {**quiet, "er_status": True}, {"ki67": 10, "hrd_positive": True, "brca_status": "pending"}, {"ki67": 10},
        {"ki67": 10, "brca_status": None}, {**quiet, "segmentation_qc": 0.49}, {**quiet, "registration_qc": "poor"}, {**quiet, "enhancement_std": 0.3},
        {**quiet, "low_enhancement_fraction": 0.35}, {**quiet, "volume_ml": 10, "ftv": 0.49}, {**quiet, "volume_ml": 10, "ftv": 0.5},
        {**quiet, "longest_diameter_cm": 2, "segmentation_qc": 0.1}, {**quiet, "ki67_percent": 101}, {**quiet, "volume_ml": 0, "ftv": 1}])
    ids = [r["rule_ids"] for r in got]
    assert ids == [
        [], ["ki67_missing_v1"], ["ki67_low_v1"], ["ki67_high_v1"], ["grade3_high_growth_v1"], ["grade1_lower_growth_v1"],
        ["tnbc_receptor_inconsistency_v1"], ["brca_hrd_positive_v1"], ["brca_hrd_missing_v1"], ["brca_hrd_missing_v1"], ["low_segmentation_qc_v1"],
        ["low_registration_qc_v1"], ["high_enhancement_heterogeneity_v1"], ["low_enhancement_fraction_v1"],
        ["ftv_anatomic_volume_inconsistency_v1"], [], ["diameter_only_report_only_v1"], [], []]
    assert got[6]["warnings"] == ["receptors_conflict"] and got[6]["uncertainty_drivers"] == ["tnbc_receptor_inconsistency_v1"]
    assert got[17]["fact_errors"] == ["ki67_invalid"] and got[18]["fact_errors"] == ["volume_range"]


def test_layers_fold_means_and_variances(spark):
    df = rules.with_facts(contexts(spark, [{"ki67_percent": 40, "brca_status": "positive", "enhancement_std": 0.5}])).withColumns(priors.population_columns())
    base = df.select(*MEANS, *COVS).first()
    after = rules.apply_layer(rules.apply_layer(df, 3), 4).select(*MEANS, *COVS).first()
    assert after["m0"] - base["m0"] == pytest.approx(math.log(1.5))
    assert after["m1"] - base["m1"] == pytest.approx(math.log(1.10) + math.log(1.15))
    assert after["m2"] - base["m2"] == pytest.approx(math.log(0.90) + math.log(0.85))
    assert after["c00"] / base["c00"] == pytest.approx(1.10)
    assert after["c11"] / base["c11"] == pytest.approx(1.05)
    assert after["c22"] / base["c22"] == pytest.approx(1.25)
    assert after["c02"] / base["c02"] == pytest.approx(math.sqrt(1.10 * 1.25))


def test_traces_say_when_why_and_how(spark):
    df = rules.with_facts(contexts(spark, [{"ki67_percent": 40, "volume_ml": 3.0, "segmentation_qc": 0.2}, {"diameter_cm": 2.0}]))
    got = sorted(rules.with_trace(df.withColumn("noise_warning", F.lit("source_unknown")), [3, 4]).collect(), key=lambda r: r["update_mode"])
    only, full = got
    by_id = {h["rule_id"]: h for h in full["trace"]}
    assert full["update_mode"] == "volume_update" and by_id["ki67_high_v1"]["condition"] == "ki67 >= 30"
    assert by_id["low_segmentation_qc_v1"]["observation_noise"] == "low_qc_mri_volume" and by_id["ki67_high_v1"]["observation_noise"] is None
    assert all(len(h["explanation"]) > 20 for h in full["trace"]) and set(rules.EXPLANATIONS) == {r.rule_id for r in rules.RULES}
    assert only["update_mode"] == "report_only" and "diameter_only_report_only_v1" in only["rule_ids"]
    assert full["warnings"][0] == "source_unknown" and only["warnings"] == ["source_unknown", "report_only"]


def test_traces_are_made_once_before_they_are_counted(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}", i % 25, 10.0 * i, "BUILDING") for i in range(40)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).write.parquet(f"{tmp_path}/customer.parquet")
    df = trace_content(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ki67_missing_v1") == 1
    got = {r["rule_id"]: (r["n_cases"], r["observation_noise"], r["explained"]) for r in df.collect()}
    assert got["ki67_missing_v1"] == (14, None, True) and got["low_segmentation_qc_v1"][1] == "low_qc_mri_volume"


def test_listed_sources_and_quality_flags_count(spark):
    got = [r["noise_kind"] for r in rules.noise_kind(contexts(spark, [
        {"source": ["DCE", "MRI"], "qc": ["motion", "artifact"]}, {"source": ["clinician", "entered"]}, {"source": "mri", "quality": ["good"]}, {"source": []}])).orderBy("case_id").collect()]
    assert got == ["low_qc_mri_volume", "manual_volume", "high_qc_mri_volume", "manual_volume"]


def test_header_and_particle_checks(spark):
    docs = spark.createDataFrame([(1, '{"schedule_id": "a", "regimen_name": "r", "total_duration_days": 3, "events": []}'), (2, '{"regimen_name": "", "total_duration_days": -1}'),
                                  (3, "no json"), (4, '{"schedule_id": "a", "regimen_name": "r", "total_duration_days": "x", "events": {}}')], "id int, js string")
    got = {r["id"]: r["reasons"] for r in checks.header_reasons(cohorts.headers(docs, "js", ["id"])).collect()}
    assert got == {1: [], 2: ["schedule_id_missing", "regimen_name_missing", "duration_negative", "events_missing"],
                   3: ["schedule_id_missing", "regimen_name_missing", "duration_missing", "events_missing"], 4: ["duration_missing", "events_missing"]}


def test_measurements_need_a_size_and_a_known_source(spark):
    rows = [("a", 0.0, "manual", "x", 1.0, None, None), ("", -1.0, "phone", None, None, None, None), ("a", 1.0, "demo", "x", None, 2.0, -3.0)]
    df = spark.createDataFrame(rows, "case_id string, day double, source string, confidence string, tumor_volume_ml double, longest_diameter_cm double, true_tumor_volume_ml double")
    got = [r["reasons"] for r in checks.with_reasons(df, checks.measurement_constraints()).collect()]
    assert got == [[], ["case_id_missing", "day_minimum", "source_enum", "confidence_missing", "any_of_volume_diameter"], ["true_tumor_volume_ml_minimum"]]
