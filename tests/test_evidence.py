"""Curves with back-off, scenarios by particle, paths along edges, and significance, against plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import curate, edges, outcomes, significance


def test_back_off_goes_to_the_first_stratum_with_enough_rows(spark):
    rows = [(1, "a", "x", 1.0, 10.0, 20.0, True), (2, "a", "x", 2.0, 10.0, 30.0, True), (3, "a", "y", 9.0, 10.0, 40.0, True), (4, "b", "y", 9.0, 10.0, 80.0, True),
            (5, "a", "x", 1.0, 10.0, 99.0, False), (6, "a", "y", 10.0, 10.0, 99.0, False), (7, "c", "z", 9.0, 10.0, 99.0, False), (8, None, "x", 1.0, 10.0, 99.0, False), (9, "c", "z", 90.0, 10.0, 99.0, False)]
    df = spark.createDataFrame(rows, "id int, s string, t string, day double, baseline_volume_ml double, volume_ml double, train boolean")
    curves = curate.curve_lattice(df, ["s", "t"], "day", 8, F.col("train"))
    assert {(r["s"], r["t"], r["day_bin"], r["mask"]): (r["mean_ratio"], r["n_rows"]) for r in curves.filter("mask in (1, 3)").collect()} == {
        ("a", None, 0, 1): (2.5, 2), ("a", None, 1, 1): (4.0, 1), ("b", None, 1, 1): (8.0, 1), (None, None, 0, 3): (2.5, 2), (None, None, 1, 3): (6.0, 2)}
    got = {r["id"]: (r["level"], r["used_bin"], r["point"]) for r in curate.stratum_forecast(df.filter("NOT train"), curves, ["s", "t"], "day", 8, 2).collect()}
    assert got == {5: ("s+t", 0, 25.0), 6: ("s", 0, 25.0), 7: ("population", 1, 60.0), 8: ("t", 0, 25.0), 9: (None, None, None)}


def test_held_out_rows_never_reach_a_curve(spark):
    df = spark.createDataFrame([(i, "a", float(i % 30), 10.0, 10.0 + i, i % 3 > 0) for i in range(60)], "id int, s string, day double, baseline_volume_ml double, volume_ml double, train boolean")
    other = df.withColumn("volume_ml", F.when(F.col("train"), F.col("volume_ml")).otherwise(1e9))
    make = lambda d: sorted(map(str, curate.stratum_forecast(df.filter("NOT train"), curate.curve_lattice(d, ["s"], "day", 8, F.col("train")), ["s"], "day", 8, 3).collect()))
    assert make(df) == make(other)


def test_scenarios_are_compared_particle_by_particle(spark):
    r = random.Random(2)
    rows = [(c, p, s, r.choice([1.0, 2.0, r.random() * 3]) + i * 0.3) for c in (1, 2) for p in range(200) for i, s in enumerate("xyz") if (c, s) != (2, "z")]
    df = spark.createDataFrame(rows + [(1, 999, "x", None)], "case_id int, p int, s string, v double")
    got = {(g["case_id"], g["s"]): g for n in (1, 7) for g in outcomes.scenario_bands(df.repartition(n), ["case_id"], "p", "s", "v").collect()}
    by = defaultdict(list)
    for c, p, s, v in rows:
        by[c, p].append((-v, s))
    ranks = defaultdict(list)
    for (c, _), all_ in by.items():
        for at, (_, s) in enumerate(sorted(all_)):
            ranks[c, s].append(at + 1)
    assert set(got) == set(ranks) and len(ranks) == 5
    for k, mine in ranks.items():
        assert got[k]["n_particles"] == 200 and got[k]["chance_best"] == pytest.approx(sum(x == 1 for x in mine) / 200)
        assert got[k]["mean_rank"] == pytest.approx(sum(mine) / 200) and got[k]["v_lo"] <= got[k]["v_mid"] <= got[k]["v_hi"]
    assert sum(got[1, s]["chance_best"] for s in "xyz") == pytest.approx(1)


def test_paths_multiply_and_cycles_end(spark):
    links = [("a", "b", 2.0), ("b", "c", -1.0), ("c", "a", 5.0), ("b", "d", 0.5), ("a", "d", 3.0), ("d", "d", 9.0), ("a", "d", 1.0), (None, "a", 1.0), ("a", None, 1.0)]
    out = edges.edge_paths(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame([("a",), ("a",), ("c",), ("q",), (None,)], "node string"))
    got = {(r["source"], r["target"]): (r["weight"], r["n_paths"], r["depth"]) for r in out.collect()}
    assert got == {("a", "b"): (2.0, 1, 1), ("a", "c"): (-2.0, 1, 2), ("a", "d"): (3.0 + 1.0 + 1.0, 3, 1),
                   ("c", "a"): (5.0, 1, 1), ("c", "b"): (10.0, 1, 2), ("c", "d"): (15.0 + 5.0 + 5.0, 3, 2)}
    short = edges.edge_paths(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame([("c",)], "node string"), max_depth=1)
    assert [(r["source"], r["target"]) for r in short.collect()] == [("c", "a")]


def test_effects_and_missing_drivers(spark):
    genes = spark.createDataFrame([(1, "g", 1.0), (1, "g", 1.0), (1, "h", 3.0), (2, "q", 1.0)], "case_id int, gene string, effect double")
    first = spark.createDataFrame([("g", "a", 0.5), ("h", "b", -1.0)], "gene string, node string, weight double")
    paths = edges.edge_paths(spark.createDataFrame([("a", "p", 2.0), ("b", "p", 1.0)], "src string, dst string, weight double"), first.select("node"))
    got = edges.edge_effects(genes, first, paths, spark.createDataFrame([("p",)], "target string")).collect()
    assert [(r["case_id"], r["target"], r["shift"], r["n_genes"]) for r in got] == [(1, "p", -1.0, 2)] and got[0]["modifier"] == pytest.approx(math.exp(-1))
    assert [tuple(r) for r in edges.missing_drivers(genes, first).collect()] == [(2, "q")]


def test_chi_square_tail(spark):
    # even degrees have a closed form; the 95 % points of odd ones are well known
    close = lambda x, dof: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
    for dof in (2, 4, 10, 40):
        xs = [0.0, 0.01, 1.0, dof - 1.0, dof, dof + 2.5, 3.0 * dof, 200.0]
        rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", significance.chi_square_tail(F.col("x"), dof).alias("q")).collect()
        for r in rows:
            assert r["q"] == pytest.approx(close(r["x"], dof), rel=1e-8)
    for dof, x in ((1, 3.841458820694124), (3, 7.814727903251179), (9, 16.918977604620448)):
        assert spark.range(1).select(significance.chi_square_tail(F.lit(x), dof)).first()[0] == pytest.approx(0.05, rel=1e-9)


def test_permutation_p_values_are_uniform_without_a_difference(spark):
    rows = spark.range(40 * 120).select((F.col("id") % 40).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(50))).cast("double").alias("v"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) < 2).alias("first"))
    test = lambda df: [r["p_value"] for r in significance.ks_permutation(df, ["g"], "v", F.col("first"), F.col("id"), 39).collect()]
    null = test(rows)
    assert len(null) == 40 and 0.35 < sum(null) / 40 < 0.65 and sum(p <= 0.1 for p in null) <= 10 and min(null) >= 1 / 40
    assert max(test(rows.withColumn("v", F.col("v") + F.when(F.col("first"), 25).otherwise(0)))) == 1 / 40
    assert sorted(null) == sorted(test(rows.repartition(7)))


def test_one_sample_has_no_p_value_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([(1, 1, 1.0, True), (1, 2, 2.0, True), (2, 3, 1.0, True), (2, 4, 1.0, False), (2, 5, None, False), (2, 6, 3.0, None)], "g int, id int, v double, first boolean")
    got = {r["g"]: r for r in significance.ks_permutation(df, ["g"], "v", F.col("first"), F.col("id"), 5).collect()}
    assert set(got) == {2} and (got[2]["n_a"], got[2]["n_b"], got[2]["ks"]) == (1, 2, 0.5)


def test_relabelled_gaps_cross_ranges_and_ties(spark, monkeypatch):
    monkeypatch.setattr(significance, "tasks_for", lambda df, rows: 13)
    rows = [(g, i, None if i % 29 == 0 else float(i * 7 % 23 - 11) * (0.0 if i % 31 == 0 else 1.0) if i % 37 else float("nan"), i % 3 == 0) for g in ("x", None) for i in range(200)] + [("y", 1, 1.0, True), ("y", 2, 1.0, False)]
    df = spark.createDataFrame(rows, "g string, id int, v double, first boolean")
    n, got = 63, {}  # more labels than one word holds
    for r in significance.ks_permutation(df, ["g"], "v", F.col("first"), F.col("id"), 63).collect():
        got[r["g"]] = (r["n_a"], r["n_b"], r["ks"], r["p_value"])
    want = {}
    for g in ("x", None, "y"):
        mine = [(i, math.inf if math.isnan(v) else v, f) for h, i, v, f in rows if h == g and v is not None]
        share = sum(f for *_, f in mine) / len(mine)
        drawn = lambda i, b: int(hashlib.md5(f"{i}:{b // 4}".encode()).hexdigest()[8 * (b % 4):8 * (b % 4) + 8], 16) / 4294967296 < share

        def gap(labels):
            a, rest = sum(labels), len(labels) - sum(labels)
            cum = lambda top, side: sum(1 for (_, v, _), x in zip(mine, labels) if v <= top and x == side)
            return max(abs(cum(t, True) / a - cum(t, False) / rest) for t in {v for _, v, _ in mine}) if a and rest else -1.0

        ks = gap([f for *_, f in mine])
        null = [gap([drawn(i, b) for i, *_ in mine]) for b in range(n)]
        want[g] = (sum(f for *_, f in mine), sum(not f for *_, f in mine), ks, (1 + sum(x >= ks for x in null)) / (n + 1))
    assert got == {g: pytest.approx(w, abs=1e-12) for g, w in want.items()}


def test_a_shuffle_by_group_alone_is_gone(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id", F.col("id").cast("double").alias("v"), (F.col("id") % 3 == 0).alias("first"))
    plan = significance.ks_permutation(df, ["g"], "v", F.col("first"), F.col("id"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "rangepartitioning" in plan


def test_rank_histogram_counts_empty_bins(spark):
    ranks = spark.createDataFrame([("flat", i * 10 + 5, 99) for i in range(10)] * 3 + [("steep", 3, 99)] * 30, "k string, rank long, n_particles long")
    got = {r["k"]: r for r in significance.rank_histogram_test(ranks, ["k"]).collect()}
    assert got["flat"]["chi_square"] == pytest.approx(0) and got["flat"]["p_value"] == pytest.approx(1)
    assert got["steep"]["chi_square"] == pytest.approx(270) and got["steep"]["p_value"] < 1e-50
