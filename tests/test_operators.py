"""Trends, metrics, checks, exposure, posterior, curation, symptoms on small inputs."""

import itertools
import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import checks, curate, exposure, metrics, outcomes, pairs, posterior, summarize, symptoms, trends


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_key_points_and_two_point_forecasts(spark):
    df = spark.createDataFrame([("a", 0.0, 30.0), ("a", 42.0, 18.0), ("a", 84.0, 10.5), ("a", 126.0, 7.5), ("b", 0.0, 5.0), ("b", 7.0, 4.0), ("c", 1.0, 1.0),
                                ("d", 0.0, 9.0), ("d", 0.0, 8.0), ("d", 5.0, 7.0)], "case_id string, day double, volume_ml double")
    got = {r["case_id"]: r for r in trends.two_point_forecasts(trends.key_points(df)).collect()}
    a = got["a"]
    assert (a["baseline_day"], a["early_volume_ml"], a["final_volume_ml"], a["n_points"]) == (0.0, 18.0, 7.5, 4)
    assert a["linear_early"] == 1e-6 and a["exponential_early"] == pytest.approx(30 * 0.6 ** 3)
    assert got["b"]["early_day"] is None and got["b"]["linear_early"] == 5.0
    assert got["d"]["baseline_volume_ml"] == 8.0 and got["d"]["linear_early"] is None  # zero day gap


def test_series_forecasts(spark):
    df = spark.createDataFrame([("a", 0.0, 30.0), ("a", 42.0, 15.0), ("a", 84.0, 8.0), ("b", 3.0, 4.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)],
                               "case_id string, day double, volume_ml double")
    got = {r["case_id"]: r for r in trends.series_forecasts(trends.series_fits(df), F.lit(126.0)).collect()}
    a = got["a"]
    assert a["last_observation"] == 8.0 and a["last_slope"] == 1.0
    assert a["linear"] == 0.0
    slope = (math.log(8) - math.log(30)) / 84
    assert a["exponential"] == pytest.approx(math.exp((math.log(30) + math.log(15) + math.log(8)) / 3 + slope * 84))
    assert all(got["b"][m] == 4.0 for m in trends.SERIES) and all(got["c"][m] == 3.0 for m in trends.SERIES)


def test_forecast_metrics_and_deltas(spark):
    df = spark.createDataFrame([("1", "x", 1.0, 2.0, 1.0, 3.0), ("2", "x", 4.0, 2.0, 0.0, 1.0), ("1", "y", 2.0, 2.0, None, None), ("2", "y", 2.5, 2.0, None, None)],
                               "case_id string, method string, point double, observed double, lo80 double, hi80 double")
    df = df.withColumns({"lo95": F.col("lo80"), "hi95": F.col("hi80")})
    got = {r["method"]: r for r in metrics.forecast_metrics(df, ["method"]).collect()}
    assert got["x"]["mae_ml"] == 1.5 and got["x"]["median_ape"] == 0.75 and got["x"]["coverage_80"] == 0.5 and got["x"]["width_80_ml"] == 1.5
    assert got["y"]["coverage_80"] is None and got["y"]["n"] == 2
    delta = metrics.paired_delta(df, [("y_vs_x", "y", "x")]).first()
    assert (delta["n"], delta["helped"], delta["harmed"], delta["mean_mae_delta_ml"]) == (2, 2, 0, 1.25)


def test_wins_break_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (2, "a", 3.0), (2, "b", 2.0)], "run int, method string, abs_error double")
    got = {r["method"]: r["win_count"] for r in metrics.method_comparison(df, ["run"]).collect()}
    assert got == {"a": 1, "b": 1}


def test_bands_of_three_particles(spark):
    data = [(p, d, v) for p, vs in enumerate([(10.0, 8.0), (12.0, 10.0), (14.0, 12.0)]) for d, v in zip((0, 7), vs)]
    df = spark.createDataFrame([("c", *r) for r in data], "case_id string, p int, day int, v double")
    bands = summarize.bands_by_day(df, ["case_id"], "day", "v")
    assert [r["median"] for r in rows(bands, "day")] == [12.0, 10.0]
    score = summarize.band_score(bands, ["case_id"], "day").first()
    assert score["widest_day"] == 0 and score["uncertainty_score"] == pytest.approx(3.2 / 11)
    tail = summarize.tail_share(summarize.last_day_rows(df, ["case_id"], "day"), ["case_id"], "v", 9.0).first()
    assert tail["share_below"] == pytest.approx(1 / 3)


def test_correlation_of_constants_is_zero(spark):
    df = spark.createDataFrame([("c", "a", 1.0, 2.0), ("c", "a", 1.0, 3.0), ("c", "a", 1.0, 4.0), ("c", "b", 1.0, 2.0), ("c", "b", 2.0, 3.0), ("c", "b", 3.0, 4.0), ("c", "d", 1.0, 1.0)],
                               "case_id string, param string, v double, y double")
    got = {r["param"]: r for r in summarize.driver_correlation(df, ["case_id"], "param", "v", "y").collect()}
    assert got["a"]["correlation"] == 0.0 and got["b"]["correlation"] == pytest.approx(1.0) and got["d"]["correlation"] == 0.0
    assert got["b"]["dominant"] and got["a"]["prior_dominated"]


def test_exposure_against_brute_force(spark):
    rnd = random.Random(4)
    doses = [(s, d, round(rnd.uniform(0, 40), 3), rnd.uniform(0, 2)) for s in (1, 2) for d in ("a", "b") for _ in range(15)] + [(3, "a", 7.0, 1.0), (3, "a", 0.0, 1.0)]
    df = spark.createDataFrame(doses, "schedule_id int, drug string, day double, relative_dose double")
    sched = spark.createDataFrame([(1, 40.0), (2, 33.0), (3, 14.0)], "schedule_id int, total_days double")
    decay = {"a": 0.25, "b": 0.06}
    got = exposure.exposure(df, sched, F.when(F.col("drug") == "a", 0.25).otherwise(0.06)).collect()
    totals = {1: 40.0, 2: 33.0, 3: 14.0}
    assert len(got) == 2 * 7 + 2 * 6 + 3
    for r in got:
        want = sum(x * math.exp(-decay[r["drug"]] * (r["grid_day"] - t)) for s, d, t, x in doses
                   if s == r["schedule_id"] and d == r["drug"] and t <= r["grid_day"] and t <= totals[s])
        assert r["exposure"] == pytest.approx(want)
    effect = {(r["schedule_id"], r["grid_day"]): r["effect"] for r in exposure.saturating_effect(spark.createDataFrame(got), F.lit(0.1), F.lit(0.5)).collect()}
    e = {r["grid_day"]: r["exposure"] for r in got if r["schedule_id"] == 3}
    assert effect[(3, 7.0)] == pytest.approx(0.1 * e[7.0] / (e[7.0] + 0.5))


def test_output_grid_appends_the_last_day(spark):
    df = spark.createDataFrame([(1, 16.0), (2, 14.0), (3, 0.0)], "schedule_id int, total_days double")
    got = {}
    for r in exposure.grid_rows(df).collect():
        got.setdefault(r["schedule_id"], []).append(r["grid_day"])
    assert got == {1: [0.0, 7.0, 14.0, 16.0], 2: [0.0, 7.0, 14.0], 3: [0.0]}


def test_weights_sum_to_one_and_shift_means(spark):
    data = [("c", p, d, (10 + p) * (1 - d / 200), 14 * (1 - d / 200)) for p in range(12) for d in (0, 42, 84)]
    df = spark.createDataFrame([(c, p, float(d), a, b) for c, p, d, a, b in data], "case_id string, particle_id int, day double, predicted double, observed double")
    w = posterior.weights(posterior.log_likelihood(df, ["case_id"], ["particle_id"], F.lit(0.08)), ["case_id"]).cache()
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert w.orderBy(F.desc("weight")).first()["particle_id"] == 4
    e = posterior.effective_size(w, ["case_id"]).first()
    assert 1 <= e["ess"] <= 12 and e["low_ess"]
    fit = metrics.fit_rmse(posterior.mean_predictions(df.join(w, ["case_id", "particle_id"]), ["case_id", "day"]).join(
        df.select("case_id", "day", "observed").distinct(), ["case_id", "day"]), ["case_id"]).first()
    assert fit["posterior_rmse"] < fit["prior_rmse"] and 0 < fit["improvement_fraction"] <= 1


def test_predictions_meet_their_observations(spark):
    pred = spark.createDataFrame([(c, p, d, float(p)) for c in (1, 2) for p in range(6) for d in (0, 7)], "case_id int, particle_id int, day int, predicted double")
    obs = spark.createDataFrame([(1, 0, 5.0), (2, 7, 6.0), (3, 0, 1.0)], "case_id int, day int, observed double")
    got = posterior.with_observed(pred, obs, ["case_id", "day"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pred.join(obs, ["case_id", "day"]).select(got.columns).collect()))
    assert got.count() == 12


def test_underflow_of_likelihoods_is_survived(spark):
    df = spark.createDataFrame([("c", 1, -5000.0), ("c", 2, -5001.0)], "case_id string, particle_id int, loglik double")
    got = {r["particle_id"]: r["weight"] for r in posterior.weights(df, ["case_id"]).collect()}
    assert got[1] == pytest.approx(1 / (1 + math.exp(-1)))


def test_parameter_class_order(spark):
    df = spark.createDataFrame([(0.2, 5, False, False), (0.2, 5, True, False), (0.4, 5, False, False), (0.9, 5, False, False), (0.2, 2, False, False), (0.2, 5, False, True)],
                               "width_ratio double, n int, low boolean, gone boolean")
    got = [r["classification"] for r in posterior.parameter_class(df, F.col("gone"), F.col("n"), F.col("low")).collect()]
    assert got == ["constrained", "weakly constrained", "weakly constrained", "prior-dominated", "prior-dominated", "prior-dominated"]


def test_near_equal_pairs_against_all_pairs(spark):
    rnd = random.Random(2)
    parts = [(c, i, [rnd.choice([0.4, 1.0, 3.0]) * (1 + rnd.uniform(-0.12, 0.12)) for _ in range(3)], [rnd.random(), rnd.random()]) for c in (1, 2) for i in range(40)]
    df = spark.createDataFrame(parts, "case_id int, pid int, path array<double>, params array<double>")
    got = {(r["case_id"], r["pid"]): (r["n_partners"], r["closest"]) for r in pairs.near_equal(df, "case_id", "pid", "path", "params").collect()}
    want = {}
    for c in (1, 2):
        mine = [p for p in parts if p[0] == c]
        span = [max(p[3][k] for p in mine) - min(p[3][k] for p in mine) for k in (0, 1)]
        for a in mine:
            near = []
            for b in mine:
                rmse = math.sqrt(sum((x - y) ** 2 for x, y in zip(a[2], b[2])) / 3) / max((sum(a[2]) + sum(b[2])) / 6, 1.0)
                if a is not b and rmse <= 0.08 and sum(abs(x - y) / s for x, y, s in zip(a[3], b[3], span)) / 2 >= 0.25:
                    near.append((rmse, b[1]))
            if near:
                want[c, a[1]] = (len(near), min(near)[1])
    assert want and got == want


def test_tiles_meet_as_matrices_and_give_one_row_per_particle(monkeypatch):
    monkeypatch.setattr(pairs, "STRIP", 7)
    rnd, wide = random.Random(5), {"c": pa.string(), "i": pa.int64(), "j": pa.int64(), "id": pa.int32(), "m": pa.float64(), "x": pa.list_(pa.float64()), "p": pa.list_(pa.float64()), "ranges": pa.list_(pa.float64())}
    paths = [[1 + rnd.uniform(-0.05, 0.05) for _ in range(4)] for _ in range(60)]
    paths += [paths[3], [1e200] * 4, [1e200] * 4, [1.0, 1.0]]  # a copy, paths whose squares overflow, and a shorter one
    params = [[rnd.random(), rnd.random() * 3] for _ in range(61)] + [[0.0, 0.0], [1.0, 3.0], [5.0, 5.0]]
    rows = [{"c": "a", "i": 4, "j": 4, "id": k, "m": sum(x) / len(x), "x": x, "p": p, "ranges": [1.0, 3.0]} for k, (x, p) in enumerate(zip(paths, params))]
    tile = lambda chosen, j: pa.Table.from_pylist([{**r, "j": j} for r in chosen], schema=pa.schema(list(wide.items())))

    def near(a, b):
        rmse = math.sqrt(sum((x - y) * (x - y) for x, y in zip(a["x"], b["x"])) / 4) / max((a["m"] + b["m"]) / 2, 1.0)
        return rmse if len(a["x"]) == len(b["x"]) and a is not b and rmse <= 0.03 and sum(abs(x - y) / r for x, y, r in zip(a["p"], b["p"], (1.0, 3.0))) / 2 >= 0.25 else None

    for left, right, j in ((rows, rows, 4), (rows[:25], rows[25:], 5)):
        got = {r["id"]: (r["n"], r["partner"], pytest.approx(r["rmse"], abs=1e-15)) for r in pairs._meet(tile(left, j), tile(right, j), 0.03, 0.25).to_pylist()}
        met = [(a["id"], near(a, b), b["id"]) for a in left for b in right if near(a, b) is not None]
        met += [] if left is right else [(b, d, a) for a, d, b in met]
        want = {k: (sum(x[0] == k for x in met), min(x[1:] for x in met if x[0] == k)[1], min(x[1:] for x in met if x[0] == k)[0]) for k in {x[0] for x in met}}
        assert got == want and (j == 5 or {61, 62} <= set(got)) and len(met) > len(got)


def test_paths_and_parameters_with_gaps_are_near_nothing(spark):
    rows = [(1, 1, [1.0, 1.0], [0.0, 0.0]), (1, 2, [1.0, 1.01], [1.0, 1.0]), (1, 3, [1.0, None], [0.5, 0.0]), (1, 4, [1.0, float("nan")], [0.5, 0.5]), (1, 5, None, [0.5, 0.5]),
            (1, 6, [1.0, 1.0], [1.0, None]), (1, 7, [1.0, 1.0], None), (None, 8, [1.0, 1.0], [0.0, 0.0]), (1, 9, [float("inf"), 1.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "case_id int, pid int, path array<double>, params array<double>")
    assert {(r["pid"], r["n_partners"], r["closest"]) for r in pairs.near_equal(df, "case_id", "pid", "path", "params").collect()} == {(1, 1, 2), (2, 1, 1)}


def test_edge_rollup_counts_a_gene_once_in_tasks_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(outcomes, "tasks_for", lambda df, rows: rows + 4)
    genes = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.25), ("a", 2, 1.0), ("a", None, 3.0), ("b", 9, 2.0), ("b", 3, None), (None, 2, 1.0)], "case_id string, gene int, effect double")
    first = spark.createDataFrame([(1, 10, 2.0), (1, 11, 4.0), (1, 11, 1.0), (2, 11, 1.0), (2, 12, 5.0), (3, 10, 1.0)], "gene int, pathway int, gene_weight double")
    second = spark.createDataFrame([(10, "p", 1.0), (11, "p", -1.0), (11, "q", 0.5)], "pathway int, phenotype string, pathway_weight double")
    df = outcomes.edge_rollup(genes, first, second)
    got = {(r["case_id"], r["phenotype"]): (r["shift"], r["n_genes"]) for r in df.collect()}
    assert got == {("a", "p"): (0.75 * -3.0 - 1.0, 2), ("a", "q"): (0.75 * 2.5 + 0.5, 2), ("a", "missing_driver"): (0.0, 1), ("b", "missing_driver"): (0.0, 1),
                   ("b", "p"): (0.0, 1), (None, "p"): (-1.0, 1), (None, "q"): (0.5, 1), (None, "missing_driver"): (0.0, 1)}
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_checks_split_accounts_for_every_row(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 0.0, 5.0, None, None, 2), ("b", -1.0, 2.0, 0.0, 5.0, None, None, 2), ("c", 1.0, 2.0, 5.0, 5.0, 1.0, None, 3)],
                               "case_id string, baseline_volume_ml double, final_volume_ml double, baseline_day double, final_day double, early_day double, early_volume_ml double, n_points int")
    checked = checks.with_reasons(df, checks.case_constraints())
    ok, bad = checks.split(checked, "case")
    assert ok.count() + bad.count() == 3
    assert {r["case_id"]: r["reasons"] for r in bad.collect()} == {"b": ["non_positive_baseline_volume"], "c": ["invalid_time_order", "early_point_incomplete"]}
    with pytest.raises(Exception):
        checks.split(checked, "case", on_error="fail")[0].collect()


def test_demo_guard(spark):
    df = spark.createDataFrame([("real",), ("Synthetic one",)], "t string")
    with pytest.raises(Exception, match="demo or synthetic"):
        checks.demo_guard(df, F.col("t")).collect()
    assert checks.demo_guard(df, F.col("t"), "exclude").count() == 1
    assert checks.demo_guard(df.limit(1), F.col("t")).count() == 1


def test_bound_levels(spark):
    cases = [("growth_rate_per_day", 0.0004, "outside_normal"), ("growth_rate_per_day", 0.02, "normal"), ("growth_rate_per_day", 0.025, "outside_normal"),
             ("growth_rate_per_day", 0.031, "high"), ("growth_rate_per_day", 0.1001, "hard"), ("resistant_fraction", 0.9, "high"), ("resistant_fraction", -0.1, "hard"), ("other", 1.0, None)]
    df = spark.createDataFrame([(n, v) for n, v, _ in cases], "n string, v double")
    assert [r[0] for r in df.select(checks.bound_level(F.col("n"), F.col("v"))).collect()] == [c[2] for c in cases]


def test_grid_consistency(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 7), ("a", 2, 0), ("a", 2, 7), ("b", 1, 0), ("b", 2, 7), ("b", 2, 0)], "c string, p int, d int")
    assert {r["c"]: r["same_grid"] for r in checks.grid_consistency(df, ["c"], ["p"], "d").collect()} == {"a": True, "b": False}


def test_split_keeps_cases_together(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("c")).withColumn("split", curate.split_of(F.col("c")))
    assert curate.split_leaks(df, "c", "split").count() == 0
    share = {r["split"]: r["count"] / 2000 for r in df.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.06 and abs(share["test"] - 0.15) < 0.05


def test_mask_features_of_a_box(spark):
    grid = spark.range(1000).selectExpr("1 AS c", "cast(id % 10 AS int) AS x", "cast(floor(id / 10) % 10 AS int) AS y", "cast(floor(id / 100) AS int) AS z")
    grid = grid.withColumns({"mask": F.expr("x between 2 and 5 and y between 1 and 2 and z = 7"), "intensity": F.col("x").cast("double")})
    r = curate.mask_features(grid, ["c"], 0.001, 5.0, 3.0).first()
    assert r["mask_voxels"] == 8 and r["volume_ml"] == pytest.approx(0.008) and r["centroid_x"] == 3.5 and r["centroid_z"] == 7.0
    assert (r["min_x"], r["max_x"], r["min_y"], r["max_y"]) == (2, 5, 1, 2) and r["low_enhancement_fraction"] == 0.25 and r["enhancing_fraction"] == 0.25


def test_auc_ks_and_conformal_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int").withColumn("g", F.lit(1))
    assert outcomes.roc_auc(df, ["g"], "s", "y").first()["auc"] == pytest.approx((2 + 1 + 0.5) / 4)
    assert outcomes.ks_two_sample(df, ["g"], "s", F.col("y") == 1).first()["ks"] == pytest.approx(0.5)
    cal = spark.createDataFrame([(1, float(i), 0.0) for i in range(1, 10)], "g int, observed double, point double")
    assert outcomes.conformal_width(cal, ["g"], 0.2).first()["half_width"] == 8.0


def test_symptom_slices_agree_with_a_plain_scan(spark):
    rnd = random.Random(9)
    start = datetime(2024, 1, 1)
    log, t = [], start
    for i in range(400):
        t = t + timedelta(minutes=rnd.choice([1, 5, 50, 200]))
        log.append((rnd.choice([1, 1, 2]), t, i, rnd.choice(["dose", "note"]), float(rnd.choice([1, 9]))))
    df = spark.createDataFrame(log, "p int, ts timestamp, id int, kind string, v double")
    runs = {r["p"]: r["longest_run"] for r in symptoms.longest_run(df, ["p"], "ts", "id", F.col("v") >= 5).collect()}
    gaps = {r["p"]: r["longest_gap"] for r in symptoms.longest_gap(df, ["p"], "ts").collect()}
    since = {r["id"]: r["since"] for r in symptoms.asof_previous(df, ["p"], "ts", "id", F.col("kind") == "dose", F.col("ts"), "since").collect()}
    for p in (1, 2):
        mine = [r for r in log if r[0] == p]
        best = run = 0
        last, longest = None, 0.0
        for a, b in zip([None] + mine, mine):
            run = run + 1 if b[4] >= 5 else 0
            best = max(best, run)
            if a:
                longest = max(longest, (b[1] - a[1]).total_seconds())
            if b[3] == "dose":
                last = b[1]
            assert since[b[2]] == last
        assert runs[p] == best and gaps[p] == longest


def test_days_in_order_over_gaps_and_stretches(spark):
    rows = [("a", 0, 5.0), ("a", 2, 3.0), ("a", 5, 1.0), ("b", 4095, 2.0), ("b", 4096, 1.0), ("b", 90000, 1.0), ("c", 1, None), ("c", 2, 1.0)]
    got = curate.days_ordered(spark.createDataFrame(rows, "case_id string, position int, day double"), ["case_id"], "position", "day")
    assert {r["case_id"]: (r["n_rows"], r["n_falls"]) for r in got.collect()} == {"a": (3, 2), "b": (3, 1), "c": (2, 0)}


def test_sweep_medians_count_runs_without_a_metric(spark):
    runs = spark.createDataFrame([("x", 1.0), ("x", None), ("x", 3.0), ("y", None)], "g string, ess double")
    got = {r["value"]: (r["n_runs"], r["median_ess"]) for r in metrics.sweep_medians(runs, {"by": "g"}, ("ess",)).collect()}
    assert got == {"x": (3, 2.0), "y": (1, None)}


def test_exposure_over_stretches_of_decay(spark):
    # a decay so fast, and a horizon so long, that the running sums are cut into many stretches
    doses = [("s", "a", float(d), 1.0 + d % 3) for d in range(0, 4000, 11)] + [("s", "slow", 3.0, 2.0), ("s", "slow", 9000.0, 1.0), ("s", "unknown", 1.0, 1.0)]
    df = spark.createDataFrame(doses, "schedule_id string, drug string, day double, relative_dose double")
    decay = F.when(F.col("drug") == "a", 0.9).when(F.col("drug") == "slow", 0.0001)
    got = {(r["drug"], r["grid_day"]): r["exposure"] for r in exposure.exposure(df, spark.createDataFrame([("s", 4001.0)], "schedule_id string, total_days double"), decay).collect()}
    days = [float(d) for d in range(0, 4001, 7)] + [4001.0]
    assert len(got) == 3 * len(days)
    for g in days:
        for drug, rate in (("a", 0.9), ("slow", 0.0001)):
            want = sum(x * math.exp(-rate * (g - d)) for _, n, d, x in doses if n == drug and d <= g)
            assert got[drug, g] == pytest.approx(want, rel=1e-9, abs=1e-12), (drug, g)
        assert got["unknown", g] is None


def test_interval_scores_and_horizons(spark):
    df = spark.createDataFrame([("m", 1, 10.0, 10.0, 8.0, 12.0, 6.0, 14.0), ("m", 2, 15.0, 10.0, 8.0, 12.0, 6.0, 14.0)], "method string, horizon int, observed double, point double, lo80 double, hi80 double, lo95 double, hi95 double")
    got = {(r["method"], r["horizon"]): r for r in metrics.leaderboard_rollup(df, ["method", "horizon"], intervals=True).collect()}
    assert got["m", 1]["score_80"] == 4.0 and got["m", 2]["score_80"] == 4.0 + 10 * 3 and got["m", 2]["score_95"] == 8.0 + 40 * 1
    assert got["m", None]["coverage_80"] == 0.5 and got[None, None]["n"] == 2


def test_weights_of_likelihoods_far_apart(spark):
    rows = [("a", i, -1e5 + 70.0 * i) for i in range(60)] + [("b", 0, -1e9), ("b", 1, -1e9), ("c", 0, 700.0)]
    got = {(r["case_id"], r["p"]): r["weight"] for r in posterior.weights(spark.createDataFrame(rows, "case_id string, p int, loglik double"), ["case_id"]).collect()}
    total = sum(math.exp(70.0 * (i - 59)) for i in range(60))
    assert all(got["a", i] == pytest.approx(math.exp(70.0 * (i - 59)) / total, rel=1e-12, abs=1e-300) for i in range(60))
    assert got["b", 0] == got["b", 1] == pytest.approx(0.5) and got["c", 0] == pytest.approx(1)


def test_response_slope(spark):
    df = spark.createDataFrame([(0.0, 10.0), (5.0, 20.0), (10.0, 0.0)], "day double, volume_ml double").withColumns({"baseline_volume_ml": F.lit(10.0), "baseline_day": F.lit(0.0)})
    got = [r["response_slope"] for r in trends.change_features(df).collect()]
    assert got[0] is None and got[1] == pytest.approx(math.log(2) / 5) and got[2] is None


def test_tiles_lose_no_pair_and_bound_a_task(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 8)
    r = random.Random(5)
    shapes = [[r.random() * 4 for _ in range(13)] for _ in range(6)]
    data = [(c, i, [x + r.random() * 0.05 for x in shapes[i % 6]], [r.random(), r.random()]) for c in (1, 2) for i in range(90 if c == 1 else 20)]
    data += [(3, i, [float(i)] * 13, [0.0, float(i)]) for i in range(40)]
    df = spark.createDataFrame(data, "case_id int, pid int, path array<double>, params array<double>")
    rows = pairs.tiles(df, "case_id", "pid", "path", "params")
    assert rows.groupBy("case_id", "tile").count().agg(F.max("count")).first()[0] <= 8
    got = {(x["case_id"], x["pid"]): (x["n_partners"], x["closest"]) for x in pairs.near_equal(df, "case_id", "pid", "path", "params").collect()}
    want = {}
    for c in (1, 2, 3):
        mine = [d for d in data if d[0] == c]
        span = [max(max(d[3][k] for d in mine) - min(d[3][k] for d in mine), 1e-9) for k in range(2)]
        for a in mine:
            near = []
            for b in mine:
                rmse = math.sqrt(sum((x - y) ** 2 for x, y in zip(a[2], b[2])) / 13) / max((sum(a[2]) + sum(b[2])) / 26, 1.0)
                if a[1] != b[1] and rmse <= 0.08 and sum(abs(x - y) / s for x, y, s in zip(a[3], b[3], span)) / 2 >= 0.25:
                    near.append((rmse, b[1]))
            if near:
                want[c, a[1]] = (len(near), min(near)[1])
    assert got == want and len(want) > 20
    # tiles far apart never meet
    met = pairs.tile_pairs(rows, "case_id", 0.08).filter("case_id = 3").count()
    n = rows.filter("case_id = 3").select("tile").distinct().count()
    assert met < n * (n + 1) / 2
    lower = rows.alias("a").crossJoin(rows.limit(20).alias("b")).filter("a.case_id = b.case_id").select(
        F.sqrt(F.aggregate(F.zip_with("a.segments", "b.segments", lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x)).alias("low"),
        F.sqrt(F.aggregate(F.zip_with("a.path", "b.path", lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x) / 13).alias("rmse"))
    assert lower.filter("low > rmse + 1e-9").count() == 0
