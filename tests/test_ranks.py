"""Selection by refinement against Spark's exact percentiles and plain Python."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import ranks

SPECIAL = [0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1.0, 0), 2.0, math.nextafter(2.0, 0), 1e300, 1.7976931348623157e308,
           float("inf"), float("nan"), 3.5, 0.1]


def test_codes_are_the_bits_of_the_double(spark):
    values = [v for x in SPECIAL for v in (x, -x)] + [(-1) ** i * 1.37 ** (i - 1000) for i in range(2000) if 1.37 ** (i - 1000) < 1e308]
    rows = ranks.with_code(spark.createDataFrame([(v,) for v in values], "v double"), "v", "code").withColumn("slice", ranks._slice(F.col("v"))).collect()
    assert len(rows) == len(values)
    for r in rows:
        if not math.isnan(r["v"]):
            bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
            assert r["code"] == (-bits - 1 if r["v"] < 0 else bits), r["v"]
    rows.sort(key=lambda r: (math.isnan(r["v"]), r["v"]))
    assert all(a["code"] <= b["code"] and a["slice"] <= b["slice"] for a, b in zip(rows, rows[1:]))


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of the rows in one group, a null key, repeated values, nulls, values of every size
    h = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n))
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, h(9, 300)).alias("k"), F.when(h(1, 10) > 0, h(2, 20_000) / 7 - 500).alias("v"),
        (F.pow(F.lit(10.0), h(3, 600) - 300) * h(4, 50)).alias("w")).cache()


@pytest.mark.parametrize("rows_at_once", [1 << 20, 4])
def test_quantiles_equal_percentiles(spark, skewed, monkeypatch, rows_at_once):
    monkeypatch.setattr(ranks, "WINDOW_ROWS", rows_at_once)
    probs = {"a": 0.025, "m": 0.5, "z": 1.0}
    got = ranks.quantiles(skewed, ["k"], {"v": F.col("v"), "w": F.col("w")}, probs)
    q = lambda c: F.percentile(c, F.array(*[F.lit(p) for p in probs.values()])).alias(f"q{c}")
    want = skewed.groupBy("k").agg(F.count("v").alias("nv"), F.count("w").alias("nw"), q("v"), q("w"))
    both = got.join(want.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")))
    near = lambda a, b: (F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))) | (a == b)
    right = (F.col("n_v") == F.col("nv")) & (F.col("n_w") == F.col("nw"))
    for i, p in enumerate(probs):
        right &= near(F.col(f"v_{p}"), F.col("qv")[i]) & near(F.col(f"w_{p}"), F.col("qw")[i])
    assert got.count() == want.count() == both.filter(right).count() == 301


def test_a_million_tiny_values_part(spark, monkeypatch):
    df = spark.range(1_000_000).select((F.col("id") * 1e-22 + 1e-19).alias("v"))
    passes = []
    real = ranks._hits
    monkeypatch.setattr(ranks, "_hits", lambda slices, *a: passes.append(slices) or real(slices, *a))
    got = ranks.quantiles_of(df, [], "v", {"m": 0.5, "p": 0.9}).first()
    assert got["n"] == 1_000_000 and got["m"] == pytest.approx(499_999.5e-22 + 1e-19, rel=1e-12) and got["p"] == pytest.approx(899_999.1e-22 + 1e-19, rel=1e-12)
    # the passes move a small share of the rows
    assert len(passes) == 2 and passes[0].count() < 1000
    assert passes[1].count() < 50_000


def test_rows_in_several_groups_at_once(spark):
    df = spark.createDataFrame([(1, "x", 3.0), (1, "y", 5.0), (2, "x", None), (None, "y", 9.0)], "a int, b string, v double")
    groups = F.array(F.struct(F.lit("a").alias("g"), F.col("a").cast("string").alias("value")), F.struct(F.lit("b").alias("g"), F.col("b").alias("value")))
    got = {(r["g"], r["value"]): (r["n_v"], r["v_m"]) for r in ranks.quantiles(df, ["g", "value"], {"v": F.col("v")}, {"m": 0.5}, groups, ["a", "b"]).collect()}
    assert got == {("a", "1"): (2, 4.0), ("a", None): (1, 9.0), ("b", "x"): (1, 3.0), ("b", "y"): (2, 7.0)}


def test_order_statistics_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 3.0), (1, 4.0), (2, 1.0), (3, None)], "k int, v double")
    got = {r["k"]: (r["n"], r["v"]) for r in ranks.order_statistic(df, ["k"], "v", lambda n: F.ceil((n + 1) * F.lit(0.6))).collect()}
    assert got == {1: (3, 5.0), 2: (1, None)}
    assert ranks.quantiles_of(df.filter("k = 3"), ["k"], "v", {"m": 0.5}).count() == 0
    assert ranks.quantiles_of(df.filter("false"), ["k"], "v", {"m": 0.5}).count() == 0


def test_results_do_not_depend_on_partitions(spark, skewed):
    out = [sorted(map(str, ranks.quantiles_of(skewed.repartition(n), ["k"], "w", {"m": 0.5, "q": 0.77}).collect())) for n in (1, 5, 13)]
    assert out[0] == out[1] == out[2]


def test_bands_of_more_particles_than_are_gathered(spark, monkeypatch):
    from cohortlab.functions import draws
    from cohortlab.operators import priors
    cases = spark.createDataFrame([(1, 10.0, 30.0), (2, 4.0, 90.0)], "case_id int, baseline_volume_ml double, days double").withColumns(priors.population_columns())
    take = lambda: {r["case_id"]: r for r in priors.predictive_bands(priors.particles(cases, 700, 7, ["case_id"]), ["case_id"], 700).collect()}
    gathered = take()
    monkeypatch.setattr(priors, "GATHERED", 100)
    monkeypatch.setattr(draws, "BLOCK", 64)
    selected = take()
    for case, want in gathered.items():
        for b in priors.BANDS:
            assert selected[case][b] == pytest.approx(want[b], rel=1e-9)


@pytest.mark.parametrize("rows_at_once", [1 << 20, 4])
def test_weighted_quantiles_follow_the_definition(spark, skewed, monkeypatch, rows_at_once):
    monkeypatch.setattr(ranks, "WINDOW_ROWS", rows_at_once)
    few = skewed.filter("k in (0, 7) OR k IS NULL").withColumn("m", F.when(F.col("k") == 7, 0.0).otherwise((F.pmod(F.xxhash64("v"), F.lit(9)) + 1) / 1024)).select("k", "v", "m").cache()
    probs = {"a": 0.0, "b": 0.1, "c": 0.9, "d": 1.0}
    got = {r["k"]: [r[f"v_{p}"] for p in probs] + [r["v_q"]] for r in ranks.quantiles(few, ["k"], {"v": F.col("v")}, {"q": 0.5}, weight=F.col("m"), weighted=probs).collect()}
    alone = {r["k"]: [r[p] for p in probs] for r in ranks.weighted_quantiles(few.repartition(5), ["k"], "v", "m", probs).collect()}
    for k in (0, 7, None):
        rows = sorted((r["v"], r["m"]) for r in few.filter(F.col("k").eqNullSafe(F.lit(k))).collect() if r["v"] is not None)
        total, want = sum(w for _, w in rows), []
        for p in probs.values():
            cum = 0.0
            for v, w in rows:  # sums of 1024ths are exact
                cum += w
                if cum >= p * total:
                    want.append(v)
                    break
        assert got[k][:4] == want == alone[k]
