"""Cohort files, the whole evaluation on a tiny cohort, and the streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import posterior
from cohortlab.plans import evaluation
from cohortlab.session import materialize
from cohortlab.sources import cohorts, sinks, stored
from cohortlab.streaming import checkins, updates

FLAT = {"case_id": "a", "subtype": "TNBC", "treatment_regimen": "AC-T", "baseline_volume_ml": 30.0, "early_day": 21, "early_volume_ml": 20.0,
        "final_day": 84, "final_volume_ml": 8.0, "ki67_percent": 45, "grade": 3, "brca_status": "positive"}
NESTED = {"patient_id": "b", "subtype": "triple negative", "treatment_context": "paclitaxel", "pathology": {"ki67": "unknown"}, "mri_features": {"segmentation_qc": 0.3},
          "measurements": [{"day": 84, "tumor_volume_ml": 9.0}, {"day": 0, "volume_ml": 25.0}, {"day": 30, "tumor_volume_ml": 15.0}]}
OTHER = {"case_id": "c", "subtype": "HR positive", "treatment_regimen": "endocrine", "baseline_volume_ml": "12.5", "final_day": "90", "outcome_volume_ml": 10}
BROKEN = {"case_id": "d", "baseline_volume_ml": True, "final_day": 5, "final_volume_ml": 1}
COHORT = [FLAT, NESTED, OTHER, BROKEN]


@pytest.mark.parametrize("shape", ["list", "object", "lines"])
def test_json_shapes_give_the_same_cases(spark, tmp_path, shape):
    path = tmp_path / ("c.jsonl" if shape == "lines" else "c.json")
    path.write_text({"list": json.dumps(COHORT), "object": json.dumps({"cases": COHORT}),
                     "lines": "\n\n".join(json.dumps(c) for c in COHORT) + "\n"}[shape])
    got = {r["case_id"]: r for r in cohorts.cases(cohorts.read_rows(spark, str(path))).drop("context").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["b"]["baseline_day"], got["b"]["baseline_volume_ml"], got["b"]["early_volume_ml"], got["b"]["final_volume_ml"]) == (0.0, 25.0, 15.0, 9.0)
    assert got["c"]["baseline_volume_ml"] == 12.5 and got["c"]["baseline_day"] == 0.0 and got["c"]["reasons"] == []
    assert "baseline_unusable" in got["d"]["reasons"]


def test_single_object_and_csv(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(FLAT))
    assert cohorts.cases(cohorts.read_rows(spark, str(tmp_path / "one.json"))).count() == 1
    (tmp_path / "c.csv").write_text("case_id,baseline_volume_ml,final_day,final_volume_ml,early_day\nx,3.5,10,2,\ny,,10,2,\n")
    got = {r["case_id"]: r for r in cohorts.cases(cohorts.read_rows(spark, str(tmp_path / "c.csv"))).drop("context").collect()}
    assert got["x"]["baseline_volume_ml"] == 3.5 and got["x"]["reasons"] == [] and "baseline_unusable" in got["y"]["reasons"]
    with pytest.raises(ValueError):
        cohorts.read_rows(spark, "c.xml")


def test_layered_evaluation_of_a_tiny_cohort(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps(c) for c in COHORT))
    cases = cohorts.cases(cohorts.read_rows(spark, str(path))).filter(F.size("reasons") == 0).drop("reasons", "source_file")
    got = evaluation.evaluate(cases, n=200, ctx=cohorts.case_context())
    scores = {r["method"]: r for r in got["metrics"].collect()}
    assert scores["baseline_no_change"]["n"] == 3
    for layer in ("layer2_population", "layer3_pathology", "layer4_mri_qc"):
        assert scores[layer]["n"] == 2 and scores[layer]["width_80_ml"] > 0 and 0 <= scores[layer]["coverage_80"] <= scores[layer]["coverage_95"] <= 1
    bands = got["forecasts"].filter("lo95 is not null").collect()
    assert len(bands) == 6 and all(r["lo95"] <= r["lo80"] <= r["point"] <= r["hi80"] <= r["hi95"] for r in bands)
    assert [r["case_id"] for r in got["skipped"].collect()] == ["c"]
    assert got["counts"].first().asDict() == {"case_count": 3, "in_scope_case_count": 2, "warning": "small_cohort"}
    for d in got["deltas"].collect():
        assert d["helped"] + d["harmed"] <= d["n"] == 2
    with pytest.raises(ValueError):
        evaluation.evaluate(cases, n=50)
    with pytest.raises(Exception, match="demo or synthetic"):
        evaluation.evaluate(cases, n=200, ctx=cohorts.case_context(), demo_text=F.concat(F.lit("data/demo.jsonl "), "case_id"))
    with pytest.raises(Exception, match="no case is in scope"):
        evaluation.evaluate(cases.filter("false"), n=200, ctx=cohorts.case_context())["counts"].collect()


def test_sinks_round_trip_and_status(spark, tmp_path):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    sinks.write(df, str(tmp_path / "t"), partition_by=["g"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
    assert materialize(df).count() == 10
    got = sinks.suite([sinks.status(df.agg(F.count("*").cast("double").alias("n")), "x", "s", "n"), sinks.unavailable(spark, "y", "s", ["cohort"])])
    assert {r["name"]: r["status"] for r in got.collect()} == {"x": "pass", "y": "unavailable"}


def test_late_and_repeated_checkins(spark, tmp_path):
    base = datetime(2024, 1, 1)
    first = [(i, base + timedelta(minutes=10 * i), "fatigue", float(i)) for i in range(40)]
    second = [(100, base + timedelta(minutes=5), "fatigue", 99.0), (39, base + timedelta(minutes=390), "fatigue", 39.0), (101, base + timedelta(hours=9), "fatigue", 1.0)]
    schema = "event_id long, ts timestamp, symptom string, value double"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: checkins.drain(checkins.window_averages(checkins.clean(checkins.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)),
                                                          ["symptom"], "ts", "value", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r["window_start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the very late entry is dropped, the repeated one counted once
    assert got[base] == 6 and got[base + timedelta(hours=6)] == 4


def test_update_stream_equals_the_batch(spark, tmp_path):
    traj = spark.createDataFrame([(c, p, float(d), 10.0 + p + d / 10) for c in (1, 2) for p in range(5) for d in (0, 7, 14)], "case_id int, particle_id int, day double, predicted double")
    meas = spark.createDataFrame([(1, 0.0, 12.0), (1, 7.0, 12.0), (2, 0.0, 14.0), (1, 14.0, 13.0)], "case_id int, day double, volume_ml double")
    meas.filter("day < 14").coalesce(1).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("store", "out", "ck")]
    go = lambda: updates.run(spark, spark.readStream.schema(meas.schema).parquet(str(tmp_path / "in")), traj, *paths)
    go()
    meas.filter("day = 14").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    got = {(r["case_id"], r["particle_id"]): r["weight"] for r in updates.latest(spark.read.parquet(paths[1])).collect()}
    want = {(r["case_id"], r["particle_id"]): r["weight"] for r in updates.touched_weights(meas, traj, meas.select("case_id").distinct(), 0.12).collect()}
    assert got == pytest.approx(want)


def test_stored_tables_meet_without_a_shuffle(spark):
    pred = spark.range(4000).select((F.col("id") % 40).alias("case_id"), (F.col("id") % 7).alias("particle_id"), (F.col("id") % 3 * 7).cast("double").alias("day"), (F.col("id") % 11 + 5.0).alias("predicted"))
    seen = pred.filter("day < 14").groupBy("case_id", "day").agg(F.avg("predicted").alias("observed"))
    store = stored.CaseStore(spark, 8)
    store.save(pred, "pred")
    store.save(seen, "seen")
    before = spark.conf.get(stored.PARTIAL_KEYS)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of any size
    try:
        with stored.by_case_alone(spark):
            plan = store.log_likelihood("pred", "seen", F.lit(0.2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.conf.get(stored.PARTIAL_KEYS) == before
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    got = {(r["case_id"], r["particle_id"]): (r["loglik"], r["n_obs"]) for r in store.scored("pred", "seen", F.lit(0.2)).collect()}
    want = posterior.log_likelihood(posterior.with_observed(pred, seen, ["case_id", "day"]), ["case_id"], ["particle_id"], F.lit(0.2)).collect()
    assert len(got) == len(want) and all(got[r["case_id"], r["particle_id"]] == pytest.approx((r["loglik"], r["n_obs"])) for r in want)
    tables = list(store.tables.values())
    store.close()
    assert not any(spark.catalog.tableExists(t) for t in tables)
