"""Scores of probabilities and distributions, rankings, and edge roll-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.functions.numeric import CENTRAL_Z
from cohortlab.operators.ranks import order_statistic, quantiles
from cohortlab.operators.scale import attach, prefix_totals, tasks_for
from cohortlab.session import materialize


def probabilistic_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaussian negative log likelihood, 50/80/95 coverage and sharpness.

    Needs ``observed, mean, sd``.
    """
    z = (F.col("observed") - F.col("mean")) / F.col("sd")
    nll = F.lit(0.5 * math.log(2 * math.pi)) + F.ln("sd") + 0.5 * z * z
    cover = lambda mass: F.avg((F.abs(z) <= CENTRAL_Z[mass]).cast("double"))
    return df.filter(F.col("sd") > 0).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(nll).alias("nll"), cover(0.5).alias("coverage_50"),
        cover(0.8).alias("coverage_80"), cover(0.95).alias("coverage_95"),
        F.avg(F.col("sd") * 2 * CENTRAL_Z[0.8]).alias("sharpness_80"))


def calibration_bins(df: DataFrame, keys: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and event rate per equal-width score bin, with the weighted gap."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, at.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("event_rate"))


def calibration_error(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error: bin gaps weighted by bin size."""
    gap = F.abs(F.col("mean_score") - F.col("event_rate"))
    return binned.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def binary_scores(df: DataFrame, keys: list[str], score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Brier score, sensitivity, specificity and balanced accuracy at a cut."""
    y, s = F.col(label).cast("double"), F.col(score)
    hit = lambda truth, positive: F.count_if((F.col(label) == truth) & ((s >= cut) if positive else (s < cut)))
    got = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(y).cast("bigint").alias("n_events"), F.avg((s - y) * (s - y)).alias("brier"),
        hit(1, True).alias("tp"), hit(0, False).alias("tn"))
    sens = F.try_divide(F.col("tp"), F.col("n_events"))
    spec = F.try_divide(F.col("tn"), F.col("n") - F.col("n_events"))
    return got.select(*keys, "n", "n_events", "brier", sens.alias("sensitivity"), spec.alias("specificity"),
                      ((sens + spec) / 2).alias("balanced_accuracy"))


def roc_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve with ties counted half, from running class totals."""
    y = F.col(label).cast("bigint")
    runs = prefix_totals(df, keys, score, {"pos": F.sum(y), "neg": F.sum(1 - y)})
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    got = runs.groupBy(*keys).agg(F.sum(F.col("pos") * below).alias("won"), F.max("all_pos").alias("p"),
                                  F.max("all_neg").alias("q"))
    return got.select(*keys, F.try_divide(F.col("won"), F.col("p") * F.col("q")).alias("auc"))


def conformal_width(calibration: DataFrame, strata: list[str], miss: float = 0.2) -> DataFrame:
    """Half-width that covers 1 - miss of the absolute residuals per stratum.

    The value of rank ceil((n + 1)(1 - miss)); NULL when a stratum is too small for it.
    """
    rows = calibration.withColumn("half_width", F.abs(F.col("observed") - F.col("point")))
    return order_statistic(rows, strata, "half_width", lambda n: F.ceil((n + 1) * F.lit(1.0 - miss)))


def ks_two_sample(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """Largest gap between the two running shares, with both sample sizes."""
    runs = prefix_totals(df, keys, value, {"a": F.count_if(first), "b": F.count_if(~first)})
    gap = F.abs(F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))
    return runs.filter((F.col("all_a") > 0) & (F.col("all_b") > 0)).groupBy(*keys).agg(
        F.max("all_a").alias("n_a"), F.max("all_b").alias("n_b"), F.max(gap).alias("ks"))


def truth_ranks(particles: DataFrame, truths: DataFrame, case: list[str], value: str, truth: str) -> DataFrame:
    """Rank of the truth among its particles. ``truths`` has one row per case and count ``n``."""
    rows = attach(particles, truths, case)
    return rows.filter(F.col(truth).isNotNull()).groupBy(*case).agg(
        F.count("*").alias("n_particles"), F.count_if(F.col(value) < F.col(truth)).alias("rank"))


def rank_histogram(ranks: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of relative ranks and each bin's part of the chi-square against uniform."""
    at = F.least(F.floor(F.col("rank") * bins / (F.col("n_particles") + 1)), F.lit(bins - 1)).cast("int")
    got = ranks.groupBy(at.alias("bin")).agg(F.count("*").alias("n_cases"))
    total = ranks.agg(F.count("*")).scalar()
    flat = total / F.lit(float(bins))
    return got.withColumn("chi_square_part", (F.col("n_cases") - flat) * (F.col("n_cases") - flat) / flat)


def level_of(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "low").when(value < high, "moderate").otherwise("high")


def uncertainty_components(df: DataFrame) -> DataFrame:
    """Low / moderate / high per component and which components drive it.

    Needs ``uncertainty_score, mean_width_ratio, qc_share, completeness``.
    """
    df = df.withColumns({
        "trajectory_uncertainty": level_of(F.col("uncertainty_score"), 0.5, 1.0),
        "parameter_uncertainty": level_of(F.col("mean_width_ratio"), 0.35, 0.55),
        "data_quality_uncertainty": level_of(1.0 - F.col("qc_share"), 0.2, 0.5),
        "missing_data_uncertainty": level_of(1.0 - F.col("completeness"), 0.2, 0.5)})
    names = ("trajectory", "parameter", "data_quality", "missing_data")
    return df.withColumn("top_drivers", F.array_compact(F.array(
        *[F.when(F.col(f"{n}_uncertainty") == "high", F.lit(n)) for n in names])))


# Hand-set importance of the data that may be missing.
IMPORTANCE = {"early_mri": 1.0, "brca_hrd": 0.8, "ki67": 0.6, "grade": 0.5, "segmentation_review": 0.4}


def missing_value_rank(df: DataFrame, case: str, missing: dict[str, Column], uncertainty: str) -> DataFrame:
    """Missing items of each case by importance times current uncertainty, ranked.

    The items are a handful per case and stay in the row until they are listed.
    """
    items = F.array_compact(F.array(*[
        F.when(col, F.struct((-F.lit(IMPORTANCE[name]) * F.col(uncertainty)).alias("neg"), F.lit(name).alias("item")))
        for name, col in missing.items()]))
    return df.select(case, F.posexplode(F.array_sort(items)).alias("pos", "it")).select(
        case, (F.col("pos") + 1).alias("rank"), F.col("it.item").alias("item"), (-F.col("it.neg")).alias("value"))


def scenario_rank(scored: DataFrame, case: list[str], weights=(1.0, 0.5, 0.25)) -> DataFrame:
    """Trade-off w1 response - w2 toxicity - w3 uncertainty, ranked among a case's scenarios.

    ``scored`` has one row per case and scenario (``scenario, response, toxicity,
    uncertainty``): aggregates, so a case has as many rows as it has candidates.
    """
    w1, w2, w3 = weights
    scored = scored.withColumn("tradeoff", w1 * F.col("response") - w2 * F.col("toxicity") - w3 * F.col("uncertainty"))
    order = Window.partitionBy(*case).orderBy(F.col("tradeoff").desc(), "scenario")
    return scored.withColumn("rank", F.row_number().over(order))


def scenario_bands(draws: DataFrame, case: list[str], particle: str, scenario: str, value: str, probs: dict[str, float] | None = None) -> DataFrame:
    """Scenarios compared under the same draws: bands of the value, chance to be the best, bands of the rank.

    ``draws`` has one row per case, particle and scenario. A particle ranks the scenarios it has a value for, ties by
    name; it has as many as there are candidates, whatever the number of particles.
    """
    probs = probs or {"lo": 0.1, "mid": 0.5, "hi": 0.9}
    rows = draws.filter(F.col(value).isNotNull()).groupBy(*case, particle).agg(
        F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("neg"), F.col(scenario).alias("s")))).alias("all"))
    rows = materialize(rows.select(*case, F.posexplode("all").alias("at", "x")).select(
        *case, F.col("x.s").alias(scenario), (-F.col("x.neg")).alias(value), (F.col("at") + 1).cast("double").alias("rank")))
    keys = [*case, scenario]
    best = rows.groupBy(*keys).agg(F.count("*").alias("n_particles"), F.avg((F.col("rank") == 1).cast("double")).alias("chance_best"), F.avg("rank").alias("mean_rank"))
    bands = quantiles(rows, keys, {value: F.col(value), "rank": F.col("rank")}, probs).drop(f"n_{value}", "n_rank")
    return attach(best, bands, keys)


def edge_rollup(genes: DataFrame, gene_pathway: DataFrame, pathway_phenotype: DataFrame) -> DataFrame:
    """Sum of signed weights along gene -> pathway -> phenotype per case.

    Genes without an edge are listed as missing drivers. Gene rows are first added up
    per (case, gene), so repeats do not multiply along the chain, in tasks whose number follows the rows; a gene's ways
    to each phenotype are added up once for all cases, so a gene is counted without telling genes apart again.
    A gene or pathway may occur in most cases: small edge tables are broadcast and large joins split at run time.
    """
    dealt = genes.select("case_id", "gene", "effect").repartition(tasks_for(genes, genes.count()), "case_id", "gene")
    g = dealt.groupBy("case_id", "gene").agg(F.sum("effect").alias("effect"))
    ways = gene_pathway.join(pathway_phenotype, "pathway", "left").groupBy("gene", F.coalesce("phenotype", F.lit("missing_driver")).alias("phenotype")).agg(
        F.sum(F.col("gene_weight") * F.col("pathway_weight")).alias("way"))
    chain = g.join(ways, "gene", "left")
    return chain.groupBy("case_id", F.coalesce("phenotype", F.lit("missing_driver")).alias("phenotype")).agg(
        F.coalesce(F.sum(F.col("effect") * F.col("way")), F.lit(0.0)).alias("shift"), F.count("gene").alias("n_genes"))


def output_audit(df: DataFrame, text: str, disclaimer: str, ranking: str, band: str, claims) -> DataFrame:
    """Rules an output text breaks: ranking without disclaimer or band, banned claims."""
    t = F.lower(F.col(text))
    ranks = F.contains(t, F.lit(ranking))
    broken = F.array_compact(F.array(
        F.when(ranks & ~F.contains(t, F.lit(disclaimer)), "disclaimer_missing"),
        F.when(ranks & ~F.contains(t, F.lit(band)), "uncertainty_missing"),
        *[F.when(F.contains(t, F.lit(c)), F.lit(f"claim: {c}")) for c in claims]))
    return df.withColumn("broken_rules", broken)


