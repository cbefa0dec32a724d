"""Operations on groups of any size against plain Spark aggregates and brute force."""

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of the rows sit in key 0, values repeat
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(20_000)) / 7).alias("v"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) + 1).cast("double").alias("w")).cache()


def test_exact_quantiles_equal_percentiles(skewed):
    got = scale.exact_quantiles(skewed, ["k"], "v", {"a": 0.025, "m": 0.5, "b": 0.9})
    want = skewed.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.9))).alias("q"), F.count("*").alias("n2"))
    bad = got.join(want, "k").filter((F.abs(F.col("a") - F.col("q")[0]) > 1e-7) | (F.abs(F.col("m") - F.col("q")[1]) > 1e-7)
                                     | (F.abs(F.col("b") - F.col("q")[2]) > 1e-7) | (F.col("n") != F.col("n2")))
    assert got.count() == want.count() and bad.count() == 0


def test_groups_are_cut_by_value_in_order(spark):
    df = spark.range(-2000, 2000).select((F.pow(F.col("id") / 100.0, F.lit(3.0)) * F.when(F.col("id") % 2 == 0, 1e-3).otherwise(1e3)).alias("v"))
    df = df.union(spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.0,)], "v double"))
    rows = sorted((r["v"], r["s"]) for r in df.select("v", scale._slice(F.col("v")).alias("s")).filter("NOT isnan(v)").collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:])) and len({s for _, s in rows}) > 3900
    runs = scale.prefix_totals(df, [], "v", {"n": F.count("*")}).collect()
    assert max(r["cum_n"] for r in runs) == 4004 == runs[0]["all_n"] and max(runs, key=lambda r: r["cum_n"])["v"] != 0.0


def test_many_equal_groups_and_a_third_in_one(spark):
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 2000).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") * 0.5).alias("v"))
    got = scale.exact_quantiles(df, ["k"], "v", {"m": 0.5})
    want = df.groupBy("k").agg(F.percentile("v", 0.5).alias("w"), F.count("v").alias("c"))
    assert got.join(want, "k").filter((F.abs(F.col("m") - F.col("w")) < 1e-9) & (F.col("n") == F.col("c"))).count() == want.count()


def test_nothing_runs_while_a_query_is_built(spark, skewed):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    scale.exact_quantiles(scale.attach(skewed, skewed.groupBy("k").agg(F.max("v").alias("top")), ["k"]), ["k"], "v", {"m": 0.5})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_weighted_quantiles_follow_the_definition(skewed):
    small = skewed.filter("k in (0, 7)").cache()
    got = {r["k"]: (r["p"], r["q"]) for r in scale.weighted_quantiles(small, ["k"], "v", "w", {"p": 0.1, "q": 0.9}).collect()}
    for k in (0, 7):
        rows = sorted((r["v"], r["w"]) for r in small.filter(F.col("k") == k).collect())
        total, want = sum(w for _, w in rows), []
        for p in (0.1, 0.9):
            cum = 0.0
            for v, w in rows:
                cum += w
                if cum >= p * total:
                    want.append(v)
                    break
        assert got[k] == pytest.approx(tuple(want))


def test_attach_keeps_every_row_and_value(skewed):
    stats = skewed.groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    got = scale.attach(skewed, stats, ["k"])
    want = skewed.join(stats.drop("n"), "k")
    assert got.columns == ["k", "v", "w", "top"]
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == skewed.count()


def test_attach_matches_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    stats = df.groupBy("k").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    assert {(r["k"], r["s"]) for r in scale.attach(df, stats, ["k"]).collect()} == {(None, 1), (1, 2)}


def test_order_statistic_and_first_rows(skewed):
    got = scale.order_statistic(skewed, ["k"], "v", F.ceil(F.col("all_n") / 2)).filter("k = 0").first()
    values = sorted(r["v"] for r in skewed.filter("k = 0").collect())
    assert got["v"] == values[-(-len(values) // 2) - 1]
    top = scale.first_rows(skewed, ["k"], [F.col("v"), F.col("w")], 2)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 2
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_results_do_not_depend_on_partitions(spark, skewed):
    out = []
    for n in (1, 4, 17):
        got = scale.exact_quantiles(skewed.repartition(n), ["k"], "v", {"m": 0.5})
        out.append(sorted((r["k"], r["n"], r["m"]) for r in got.collect()))
    assert out[0] == out[1] == out[2]


def test_few_rows_are_broadcast_and_tasks_follow_the_rows(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [scale.tasks_for(spark.range(1), n) for n in (0, 1, least * scale.TASK_ROWS, least * scale.TASK_ROWS + 1)] == [least, least, least, least + 1]
    hinted = lambda: "broadcast" in scale.few(spark.range(3))._jdf.queryExecution().logical().toString().lower()
    assert hinted()
    monkeypatch.setattr(scale, "FEW", 2)
    assert not hinted()
