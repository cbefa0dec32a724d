"""Population prior, reproducible particles and prior-predictive forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions import draws
from cohortlab.functions.gauss import MEANS, from_transformed, with_cholesky
from cohortlab.functions.numeric import interval_to_normal
from cohortlab.operators.ranks import quantiles

# Median, 80% low, 80% high and space of each learnable parameter.
POPULATION = (("growth_rate_per_day", 0.0067, 0.0030, 0.0150, "log"),
              ("active_treatment_sensitivity", 0.090, 0.040, 0.180, "log"),
              ("resistant_fraction", 0.20, 0.08, 0.45, "logit"))
# Correlations growth-sensitivity, growth-resistant, sensitivity-resistant.
CORRELATIONS = {(0, 1): 0.25, (0, 2): -0.05, (1, 2): -0.40}
LAYER_NAMES = {2: "layer2_population", 3: "layer3_pathology", 4: "layer4_mri_qc"}
BANDS = {"lo95": 0.025, "lo80": 0.1, "point": 0.5, "hi80": 0.9, "hi95": 0.975}
#: Up to so many particles a key are gathered and sorted; the bands of more are selected by refinement.
GATHERED = 10_000


def population_columns() -> dict[str, Column]:
    """Mean and covariance of the population prior as constant columns."""
    moments = [interval_to_normal(F.lit(m), F.lit(lo), F.lit(hi), space) for _, m, lo, hi, space in POPULATION]
    out = {f"m{i}": mean for i, (mean, _) in enumerate(moments)}
    for i in range(3):
        for j in range(i, 3):
            rho = 1.0 if i == j else CORRELATIONS[(i, j)]
            out[f"c{i}{j}"] = F.lit(rho) * moments[i][1] * moments[j][1]
    return out


def particles(priors: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` correlated draws per prior row in parameter space.

    Draws are keyed by ``seed`` and the ``key`` columns. Rows keep ``key`` and the
    columns of ``priors`` other than the Gaussian ones.
    """
    if n < 1:
        raise ValueError("a case needs at least one particle")
    df = draws.with_stream(with_cholesky(priors), key, seed)
    df = draws.with_normals(draws.fan_out(df, n), "particle", 3)
    df = df.withColumns({
        "t0": F.expr("m0 + l00 * z0"), "t1": F.expr("m1 + l10 * z0 + l11 * z1"),
        "t2": F.expr("m2 + l20 * z0 + l21 * z1 + l22 * z2")})
    growth, sensitivity, resistant = from_transformed(F.col("t0"), F.col("t1"), F.col("t2"))
    df = df.withColumns({"growth": growth, "sensitivity": sensitivity, "resistant": resistant})
    gone = ["s_a", "s_b", "z0", "z1", "z2", "t0", "t1", "t2", "l00", "l10", "l11", "l20", "l21", "l22", "psd",
            *MEANS, "c00", "c01", "c02", "c11", "c12", "c22"]
    return df.drop(*gone)


def predicted_volume(days: Column, baseline: Column, rate: Column) -> Column:
    """Baseline times exp of the clipped log change, floored."""
    change = F.least(F.greatest(rate * days, F.lit(-30.0)), F.lit(30.0))
    return F.greatest(baseline * F.exp(change), F.lit(1e-6))


def predictive_bands(sampled: DataFrame, key: list[str], n: int, bands: dict[str, float] = BANDS) -> DataFrame:
    """Quantile bands of the predicted final volume per ``key``.

    The volume rises with the net rate, so up to ``GATHERED`` particles only the rates are gathered (exactly ``n``
    doubles per key, a fixed parameter) and only the order statistics that a band
    needs are turned into volumes. More are counted in slices where they are drawn.
    """
    if n > GATHERED:
        rate = F.expr("growth - sensitivity * (1.0D - resistant)")
        return quantiles(sampled, key, {"v": predicted_volume(F.col("days"), F.col("baseline_volume_ml"), rate)}, bands).select(*key, *[F.col(f"v_{b}").alias(b) for b in bands])
    rates = (sampled.select(*key, "days", "baseline_volume_ml",
                            F.expr("growth - sensitivity * (1.0D - resistant)").alias("rate"))
             .groupBy(*key, "days", "baseline_volume_ml")
             .agg(F.sort_array(F.collect_list("rate")).alias("rates")))
    volume = lambda i: predicted_volume(F.col("days"), F.col("baseline_volume_ml"), F.col("rates")[i])
    out = {}
    for name, p in bands.items():
        pos = p * (n - 1)
        low = int(pos)
        part = pos - low
        out[name] = volume(low) if part == 0 else volume(low) * (1.0 - part) + volume(low + 1) * part
    return rates.select(*key, *[e.alias(k) for k, e in out.items()])


@dataclass(frozen=True)
class Spec:
    """One configured parameter: fixed value, or a uniform or log10-uniform range."""

    param: str
    dist: str
    lo: float | None = None
    hi: float | None = None
    value: float | None = None
    drug: str | None = None

    def __post_init__(self):
        if self.dist == "fixed" and self.value is None:
            raise ValueError(f"{self.param}: a fixed parameter needs a value")
        if self.dist in ("uniform", "log_uniform"):
            if self.lo is None or self.hi is None or self.hi < self.lo:
                raise ValueError(f"{self.param}: bounds must be ordered")
            if self.dist == "log_uniform" and self.lo <= 0:
                raise ValueError(f"{self.param}: log-uniform bounds must be positive")
        elif self.dist != "fixed":
            raise ValueError(f"{self.param}: unknown distribution {self.dist}")

    @property
    def name(self) -> str:
        return f"{self.param}.{self.drug}" if self.drug else self.param


# The generic demonstration prior.
GENERIC = (
    Spec("growth_rate", "uniform", 0.001, 0.014), Spec("carrying_capacity_ml", "uniform", 120.0, 500.0),
    Spec("resistant_fraction", "uniform", 0.02, 0.35), Spec("resistant_sensitivity_scale", "uniform", 0.02, 0.25),
    Spec("observation_noise_fraction", "uniform", 0.06, 0.18),
    Spec("drug_sensitivity", "uniform", 0.015, 0.13, drug="anthracycline"),
    Spec("drug_sensitivity", "uniform", 0.015, 0.13, drug="taxane"),
    Spec("drug_sensitivity", "uniform", 0.003, 0.04, drug="endocrine_agent"),
    Spec("drug_sensitivity", "uniform", 0.02, 0.15, drug="her2_directed_agent"),
    Spec("drug_ec50", "fixed", value=0.5, drug="anthracycline"), Spec("drug_ec50", "fixed", value=0.5, drug="taxane"),
    Spec("drug_ec50", "fixed", value=0.7, drug="endocrine_agent"),
    Spec("drug_ec50", "fixed", value=0.5, drug="her2_directed_agent"),
    Spec("drug_decay", "fixed", value=0.25, drug="anthracycline"), Spec("drug_decay", "fixed", value=0.2, drug="taxane"),
    Spec("drug_decay", "fixed", value=0.06, drug="endocrine_agent"),
    Spec("drug_decay", "fixed", value=0.16, drug="her2_directed_agent"),
)


def config_draws(keys: DataFrame, key: list[str], specs, n: int, seed: int) -> DataFrame:
    """``n`` independent draws per key and configured parameter, long form.

    Each parameter has its own stream, so adding one leaves the others unchanged. The
    configuration is a constant array in the plan: there is nothing to join.
    """
    number = lambda v: F.lit(v).cast("double")
    table = F.array(*[F.struct(F.lit(s.name).alias("param"), F.lit(s.dist).alias("dist"), number(s.lo).alias("lo"),
                               number(s.hi).alias("hi"), number(s.value).alias("fixed")) for s in specs])
    df = keys.select(*key, F.explode(table).alias("s")).select(*key, "s.*")
    df = draws.with_uniforms(draws.fan_out(draws.with_stream(df, [*key, "param"], seed), n), "particle", 1)
    value = (F.when(F.col("dist") == "fixed", F.col("fixed"))
             .when(F.col("dist") == "uniform", F.expr("lo + (hi - lo) * u0"))
             .when(F.col("dist") == "log_uniform",
                   F.pow(F.lit(10.0), F.expr("log10(lo) + (log10(hi) - log10(lo)) * u0"))))
    return df.select(*key, F.format_string("p%06d", "particle").alias("particle_id"), "param", value.alias("value"))


def prior_variant(specs, variant: str, active: list[str], noise: float) -> tuple[Spec, ...]:
    """A reduced prior configuration for ablation runs.

    Drugs outside ``active`` go in all reduced variants; the core parameters become
    fixed in the two ``fixed_core`` ones.
    """
    if variant not in ("full", "active_drugs_only", "fixed_core", "shared_chemo_fixed_core"):
        raise ValueError(f"unknown prior variant: {variant}")
    if variant == "full":
        return tuple(specs)
    kept = [s for s in specs if s.drug is None or s.drug in active]
    if variant == "active_drugs_only":
        return tuple(kept)
    # The core of the fixed variants.
    core = {"carrying_capacity_ml": 260.0, "resistant_sensitivity_scale": 0.1, "observation_noise_fraction": noise}
    kept = [s for s in kept if s.param not in core]
    return tuple(kept) + tuple(Spec(name, "fixed", value=value) for name, value in core.items())


def tie_chemo(df: DataFrame, sensitivity: str = "drug_sensitivity", drugs=("anthracycline", "taxane")) -> DataFrame:
    """Give two drugs of a particle their mean sensitivity; untouched unless both are there."""
    a, b = (F.try_element_at(sensitivity, F.lit(d)) for d in drugs)
    mean = 0.5 * (a + b)
    tied = F.transform_values(sensitivity, lambda k, v: F.when(k.isin(*drugs), mean).otherwise(v))
    return df.withColumn(sensitivity, F.when(a.isNotNull() & b.isNotNull(), tied).otherwise(F.col(sensitivity)))


def noisy_observations(df: DataFrame, key: list[str], index: str, volume: str, noise: float, seed: int) -> DataFrame:
    """Add ``observed``: volume plus a normal error of sd max(noise * max(v, 1), 0.1), floored at 0."""
    df = draws.with_normals(draws.with_stream(df, key, seed), index, 1)
    sd = F.greatest(F.lit(noise) * F.greatest(F.col(volume), F.lit(1.0)), F.lit(0.1))
    return df.withColumn("observed", F.greatest(F.lit(0.0), F.col(volume) + sd * F.col("z0"))).drop("s_a", "s_b", "z0")


def fan_out_drugs(df: DataFrame, active: list[str], inactive: dict[str, float], prefix: str,
                  decay: dict[str, float], ec50: dict[str, float]) -> DataFrame:
    """Sampled particles as simulator parameters: the shared sensitivity goes to every active drug."""
    overlap = sorted(set(active) & set(inactive))
    gaps = sorted((set(active) | set(inactive)) - (set(decay) & set(ec50)))
    if overlap or gaps:
        raise ValueError(f"inactive drugs also active: {overlap}; drugs without kinetics: {gaps}")
    shared = F.create_map(*[x for d in active for x in (F.lit(d), F.col("sensitivity"))])
    rest = F.create_map(*[F.lit(x) for kv in sorted(inactive.items()) for x in kv])
    literal = lambda m: F.create_map(*[F.lit(x) for kv in sorted(m.items()) for x in kv])
    return df.select(
        "*", F.format_string(f"{prefix}_%04d", "particle").alias("particle_id"), F.lit("logistic").alias("growth_law"),
        F.map_concat(shared, rest).alias("drug_sensitivity") if inactive else shared.alias("drug_sensitivity"),
        literal(decay).alias("drug_decay"), literal(ec50).alias("drug_ec50"))


def flatten_params(df: DataFrame, ids: list[str], scalars: list[str], sensitivity: str = "drug_sensitivity") -> DataFrame:
    """Long ``(ids.., param, value)`` of the scalars and the per-drug sensitivities."""
    plain = F.array(*[F.struct(F.lit(s).alias("param"), F.col(s).cast("double").alias("value")) for s in scalars])
    drugs = F.transform(F.map_entries(sensitivity), lambda e: F.struct(
        F.concat(F.lit("drug_sensitivity."), e["key"]).alias("param"), e["value"].cast("double").alias("value")))
    return df.select(*ids, F.explode(F.concat(plain, drugs)).alias("p")).select(*ids, "p.*").filter("value is not null")
