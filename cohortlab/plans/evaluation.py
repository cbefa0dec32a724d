"""The layered cohort evaluation: contract, priors, particles, bands, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.context import Context, fence
from cohortlab.functions.gauss import COVS, MEANS
from cohortlab.operators import metrics, priors, rules, trends
from cohortlab.operators.checks import case_constraints, demo_guard, with_reasons
from cohortlab.session import materialize

GAUSS = [*MEANS, *COVS]
#: Cases below which scores are early evidence only.
SMALL_COHORT = 20


def scoped(cases: DataFrame, ctx: Context | None = None, inside: bool = False) -> DataFrame:
    """Cases with contract, facts, fact errors and ``usable`` (in scope, no errors).

    With ``inside`` cases out of scope are left out as soon as their contract is known, for results that are made of usable cases only.
    """
    ctx = ctx or Context()
    df = rules.scope(cases, ctx)
    if inside:
        df = fence(df).filter(F.col("contract_id") == "tnbc_chemo")
    df = rules.with_facts(df, ctx)
    return df.withColumn("usable", (F.col("contract_id") == "tnbc_chemo") & (F.size("fact_errors") == 0))


def layered_priors(facts: DataFrame, keep: list[str], layers=(2, 3, 4)) -> DataFrame:
    """One row per usable case and layer with its Gaussian.

    The layers are chained in one row and only then fanned out, so there is no
    shuffle between them. Unusable cases fan out to nothing.
    """
    df = facts.withColumns(priors.population_columns())
    df = df.withColumn("g2", F.struct(F.lit(2).alias("layer"), *GAUSS))
    for layer in (3, 4):
        df = rules.apply_layer(df, layer).withColumn(f"g{layer}", F.struct(F.lit(layer).alias("layer"), *GAUSS))
    chosen = F.array(*[F.col(f"g{n}") for n in layers])
    return df.select(*keep, F.explode(F.when(F.col("usable"), chosen)).alias("g")).select(*keep, "g.*")


def with_lineage(priors_: DataFrame) -> DataFrame:
    """Add the version of each layer's prior and of the one it was made from (none for the population)."""
    names = F.create_map(*[F.lit(x) for pair in priors.LAYER_NAMES.items() for x in pair])
    return priors_.withColumns({"prior_version": F.try_element_at(names, F.col("layer")), "base_prior_version": F.try_element_at(names, F.col("layer") - 1)})


def layer_bands(facts: DataFrame, case: str, n: int, seed: int, layers=(2, 3, 4), carry=()) -> DataFrame:
    """Prior-predictive bands per case and layer.

    Needs ``baseline_volume_ml`` and ``days``; cases out of scope or with unusable
    facts have no bands. ``carry`` names per-case columns to keep.
    """
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [case, "layer", *carry]
    long = layered_priors(facts, [case, "baseline_volume_ml", "days", *carry], layers)
    # Shuffle the one small row per case and layer before it fans out: the particles are
    # then already grouped where they are drawn and never cross the network. The number
    # of partitions is explicit, because the rows are tiny here and n times more later.
    sampled = priors.particles(long.repartition(parts, case, "layer"), n, seed, [case, "layer"])
    return priors.predictive_bands(sampled, key, n)


def evaluate(cases: DataFrame, case: str = "case_id", n: int = 2000, seed: int = 2026,
             ctx: Context | None = None, demo_text: Column | None = None, allow_demo: bool = False) -> dict[str, DataFrame]:
    """Baselines and layers against the held-out final volumes.

    A row that holds a demo token fails the run unless ``allow_demo``; ``demo_text`` is the text that is looked through, by default the
    case's name, its ``source_file`` if there is one, and its whole context. ``counts`` warns of a small cohort, and reading it fails
    when no case is in scope.

    ``cases`` holds the key points and ``context``. Out-of-scope cases still count in
    the baselines, so methods differ in ``n``. The checked cases and the forecasts are
    each written once, since several results read them.
    """
    if n < 100:
        raise ValueError("n must be at least 100")
    if not allow_demo:
        named = [F.col(c).cast("string") for c in (case, "source_file") if c in cases.columns]
        cases = demo_guard(cases, demo_text if demo_text is not None else F.concat_ws(" ", *named, F.to_json(F.col((ctx or Context()).column))))
    df = with_reasons(cases, case_constraints(), "case_errors")
    df = df.withColumns({"days": F.col("final_day") - F.col("baseline_day"), "observed": F.col("final_volume_ml")})
    df = materialize(df.filter(F.size("case_errors") == 0).drop("case_errors"))
    simple = trends.long_forecasts(trends.two_point_forecasts(df), trends.TWO_POINT, [case], "observed")
    name = F.lit(None).cast("string")
    for layer, label in priors.LAYER_NAMES.items():
        name = F.when(F.col("layer") == layer, label).otherwise(name)
    layered = layer_bands(scoped(df, ctx), case, n, seed, carry=("observed",)).withColumn("method", name).drop("layer")
    forecasts = materialize(simple.drop("abs_error").unionByName(layered, allowMissingColumns=True))
    scope = rules.scope(df, ctx)
    counts = scope.agg(F.count("*").alias("case_count"), F.count_if(F.col("contract_id") == "tnbc_chemo").alias("in_scope_case_count"))
    return {
        "forecasts": forecasts,
        "metrics": metrics.forecast_metrics(forecasts, ["method"]),
        "deltas": metrics.paired_delta(forecasts, [
            ("layer3_vs_layer2", "layer3_pathology", "layer2_population"),
            ("layer4_vs_layer3", "layer4_mri_qc", "layer3_pathology")], case),
        "skipped": scope.filter(F.col("contract_id") != "tnbc_chemo").select(
            F.col(case).cast("string").alias("case_id"), "contract_id", "scope_warning"),
        "counts": counts.select(
            "case_count", F.when(F.col("in_scope_case_count") > 0, F.col("in_scope_case_count")).otherwise(
                F.raise_error(F.lit("no case is in scope")).cast("bigint")).alias("in_scope_case_count"),
            F.when(F.col("case_count") < SMALL_COHORT, F.lit("small_cohort")).alias("warning")),
    }
