"""Draws: distribution, independence, reproducibility."""

from pyspark.sql import functions as F

from cohortlab.functions import draws, gauss
from cohortlab.operators import priors


def _normals(spark, parts, n=4000):
    df = draws.with_stream(spark.range(10).withColumnRenamed("id", "case_id"), ["case_id"], 11)
    return draws.with_normals(draws.fan_out(df, n).repartition(parts), "particle", 3)


def test_normals_have_unit_moments_and_no_correlation(spark):
    r = _normals(spark, 3).agg(*[F.avg(f"z{i}").alias(f"m{i}") for i in range(3)], *[F.var_pop(f"z{i}").alias(f"v{i}") for i in range(3)],
                               F.corr("z0", "z1").alias("a"), F.corr("z0", "z2").alias("b"), F.corr("z1", "z2").alias("c"),
                               F.skewness("z0").alias("s"), F.kurtosis("z0").alias("k")).first()
    for i in range(3):
        assert abs(r[f"m{i}"]) < 0.02 and abs(r[f"v{i}"] - 1) < 0.03
    assert max(abs(r[x]) for x in "abc") < 0.02 and abs(r["s"]) < 0.05 and abs(r["k"]) < 0.1


def test_neighbouring_counters_and_keys_are_unrelated(spark):
    df = _normals(spark, 2).select("case_id", "particle", "z0")
    nxt = df.select("case_id", (F.col("particle") - 1).alias("particle"), F.col("z0").alias("n0"))
    other = df.select((F.col("case_id") - 1).alias("case_id"), "particle", F.col("z0").alias("o0"))
    r = df.join(nxt, ["case_id", "particle"]).join(other, ["case_id", "particle"]).agg(F.corr("z0", "n0"), F.corr("z0", "o0")).first()
    assert abs(r[0]) < 0.02 and abs(r[1]) < 0.02


def test_draws_do_not_depend_on_partitions(spark):
    a = {(r["case_id"], r["particle"]): r["z1"] for r in _normals(spark, 1, 50).collect()}
    b = {(r["case_id"], r["particle"]): r["z1"] for r in _normals(spark, 7, 50).collect()}
    assert a == b


def test_uniforms_are_flat(spark):
    df = draws.with_uniforms(draws.fan_out(draws.with_stream(spark.range(4), ["id"], 3), 10_000), "particle", 2)
    counts = [r["count"] for r in df.groupBy(F.floor(F.col("u0") * 20).alias("b")).count().collect()]
    assert len(counts) == 20 and max(counts) < 2300 and min(counts) > 1700
    assert df.filter("u0 <= 0 or u0 >= 1").count() == 0


def test_population_particles_reproduce_medians_intervals_and_correlations(spark):
    base = spark.range(1).select(F.lit("a").alias("case_id"), F.lit(2).alias("layer")).withColumns(priors.population_columns())
    got = priors.particles(base, 6000, 2026, ["case_id", "layer"])
    q = got.agg(*[F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias(c) for c in ("growth", "sensitivity", "resistant")],
                F.corr(F.ln("growth"), F.ln("sensitivity")).alias("gs"), F.corr(F.ln("sensitivity"), F.ln(F.col("resistant") / (1 - F.col("resistant")))).alias("sr")).first()
    for c, (_, m, lo, hi, _s) in zip(("growth", "sensitivity", "resistant"), priors.POPULATION):
        assert abs(q[c][1] / m - 1) < 0.05
    # the growth prior is symmetric in log space, so its 80% ends come back too
    assert abs(q["growth"][0] / 0.0030 - 1) < 0.08 and abs(q["growth"][2] / 0.0150 - 1) < 0.08
    assert abs(q["gs"] - 0.25) < 0.05 and abs(q["sr"] + 0.40) < 0.05


def test_same_seed_same_particles_other_seed_others(spark):
    keys = spark.range(3).withColumnRenamed("id", "case_id")
    read = lambda seed: sorted((r["case_id"], r["particle_id"], r["param"], r["value"]) for r in priors.config_draws(keys, ["case_id"], priors.GENERIC, 5, seed).collect())
    assert read(1) == read(1) and read(1) != read(2)
    for _, _, name, value in read(1):
        spec = next(s for s in priors.GENERIC if s.name == name)
        assert value == spec.value if spec.dist == "fixed" else spec.lo <= value <= spec.hi


def test_cholesky_rejects_indefinite_and_accepts_singular(spark):
    rows = [(1.0, 0.0, 0.0, 1.0, 0.0, 1.0, True), (1.0, 2.0, 0.0, 1.0, 0.0, 1.0, False), (0.0, 0.0, 0.0, 1.0, 0.5, 1.0, True),
            (0.0, 0.5, 0.0, 1.0, 0.0, 1.0, False), (1.0, 1.0, 0.0, 1.0, 0.0, 1.0, True), (float("nan"), 0.0, 0.0, 1.0, 0.0, 1.0, False)]
    df = spark.createDataFrame(rows, "c00 double, c01 double, c02 double, c11 double, c12 double, c22 double, want boolean")
    assert all(r["psd"] == r["want"] for r in gauss.with_cholesky(df).collect())


def test_variants_and_tying(spark):
    names = lambda v: {s.name for s in priors.prior_variant(priors.GENERIC, v, ["anthracycline", "taxane"], 0.12)}
    assert "drug_sensitivity.endocrine_agent" in names("full") and "drug_sensitivity.endocrine_agent" not in names("active_drugs_only")
    fixed = {s.name: s.value for s in priors.prior_variant(priors.GENERIC, "fixed_core", ["anthracycline", "taxane"], 0.12) if s.dist == "fixed"}
    assert fixed["carrying_capacity_ml"] == 260.0 and fixed["resistant_sensitivity_scale"] == 0.1 and fixed["observation_noise_fraction"] == 0.12
    df = spark.sql("select map('anthracycline', 0.1D, 'taxane', 0.3D, 'x', 0.7D) drug_sensitivity union all select map('taxane', 0.3D)")
    got = [r["drug_sensitivity"] for r in priors.tie_chemo(df).collect()]
    assert got[0]["anthracycline"] == got[0]["taxane"] == 0.2 and got[0]["x"] == 0.7 and got[1] == {"taxane": 0.3}
