"""Building a cohort: exclusion reasons, splits, feature merges, quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators.checks import with_reasons
from cohortlab.operators.scale import attach

#: Positions of a stretch that one window holds.
STRETCH = 4096


def flag_duplicates(df: DataFrame, case: str = "case_id") -> DataFrame:
    """Add ``copies``: how many rows carry the case id."""
    sizes = df.groupBy(case).agg(F.count("*").alias("n"), F.count("*").alias("copies"))
    return attach(df, sizes, [case])


def exclusion_reasons(df: DataFrame) -> DataFrame:
    """Stable exclusion reasons in order; ``reason`` is the first one that applies.

    Needs ``case_id, baseline_volume_ml, final_volume_ml, baseline_day, final_day,
    subtype_text, treatment_text, contract_id, is_demo, copies``.
    """
    base, final = F.col("baseline_volume_ml"), F.col("final_volume_ml")
    known = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "unknown")
    df = with_reasons(df, [
        ("missing_case_id", F.col("case_id").isNotNull()),
        ("missing_baseline_volume", base.isNotNull()), ("missing_final_volume", final.isNotNull()),
        ("non_positive_baseline_volume", base.isNull() | (base > 0)),
        ("non_positive_final_volume", final.isNull() | (final > 0)),
        ("invalid_time_order", F.col("final_day") > F.col("baseline_day")),
        ("unresolved_subtype", known("subtype_text")),
        ("out_of_v1a_scope", F.col("contract_id") == "tnbc_chemo"),
        ("synthetic_or_demo_data", ~F.col("is_demo")),
        ("duplicate_case_id", F.col("copies") == 1),
        ("unsupported_treatment_context", known("treatment_text"))])
    return df.withColumn("reason", F.try_element_at("reasons", F.lit(1)))


def cohort_summary(df: DataFrame) -> DataFrame:
    """Row, scope and availability counts of a cohort with ``reasons``; one pass."""
    have = lambda c: F.count_if(F.col(c).isNotNull())
    return df.agg(
        F.count("*").alias("total_input_rows"), F.count_if(F.size("reasons") == 0).alias("included_rows"),
        F.count_if(F.size("reasons") > 0).alias("excluded_rows"),
        F.count_if("is_tnbc").alias("tnbc_count"), F.count_if(~F.col("is_tnbc")).alias("non_tnbc_count"),
        F.count_if(F.col("contract_id") == "tnbc_chemo").alias("v1a_in_scope_count"),
        have("baseline_volume_ml").alias("baseline_volume_available_count"),
        have("final_volume_ml").alias("final_volume_available_count"),
        have("early_volume_ml").alias("early_followup_available_count"),
        F.avg(F.col("biomarkers_known")).alias("biomarker_completeness"),
        F.avg(F.col("imaging_known")).alias("mri_feature_completeness"))


def reason_counts(df: DataFrame) -> DataFrame:
    """How often each reason applies, and how often it is the first."""
    return df.select("reason", F.explode("reasons").alias("any_reason")).groupBy("any_reason").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("reason") == F.col("any_reason")).alias("n_first"))


def small_cohort_warning(n_cases: Column, n_in_scope: Column, minimum: int = 20) -> Column:
    return F.when(n_in_scope == 0, "no_case_in_scope").when(n_cases < minimum, "small_cohort")


def split_of(case: Column, shares=(("train", 0.70), ("validation", 0.15), ("test", 0.15)), seed: int = 0) -> Column:
    """Split of a case from a hash of its key: all rows of a case fall together."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"split{seed}"), case.cast("string"))), 1, 8), 16, 10)
    u = word.cast("bigint") / F.lit(4294967296.0)
    edge, out = 1.0, F.lit(shares[-1][0])
    for name, share in reversed(shares[:-1]):
        edge = sum(s for n, s in shares[:[n for n, _ in shares].index(name) + 1])
        out = F.when(u < edge, name).otherwise(out)
    return out


def split_leaks(df: DataFrame, case: str, split: str) -> DataFrame:
    """Cases whose rows sit in more than one split."""
    return df.groupBy(case).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).filter(
        F.col("lo") != F.col("hi")).select(case)


def merge_features(cohort: DataFrame, features: DataFrame, case: str) -> DataFrame:
    """Left join that keeps every cohort row; ``has_features`` tells which met any."""
    return cohort.join(features.withColumn("has_features", F.lit(True)), case, "left").withColumn(
        "has_features", F.coalesce("has_features", F.lit(False)))


def qc_gate(df: DataFrame, level: Column, max_volume_ml: float = 1000.0) -> DataFrame:
    """Quality label and what layer 4 may do with the features.

    Needs ``mask_voxels, total_voxels, volume_ml, spacing_mm, max_intensity``.
    """
    df = with_reasons(df, [
        ("empty_mask", F.col("mask_voxels") > 0), ("full_mask", F.col("mask_voxels") < F.col("total_voxels")),
        ("implausible_volume", F.col("volume_ml").between(0.0, max_volume_ml)),
        ("invalid_spacing", F.col("spacing_mm") > 0), ("all_zero_image", F.col("max_intensity") > 0)], "gate_failures")
    df = df.withColumn("qc_label", F.when(F.size("gate_failures") > 0, "failed").otherwise(F.coalesce(level, F.lit("unknown"))))
    return df.withColumn("layer4_behavior", F.when(F.col("qc_label") == "high", "use")
                         .when(F.col("qc_label") == "medium", "use_mild_widening").when(F.col("qc_label") == "low", "widen_only")
                         .when(F.col("qc_label") == "failed", "ignore").otherwise("report_only"))


def mask_features(voxels: DataFrame, case: list[str], spacing_ml: float, enhancing: float, low: float) -> DataFrame:
    """Tumour features from voxel rows ``x, y, z, mask, intensity`` in one aggregate."""
    inside = F.col("mask")
    v = F.when(inside, F.col("intensity"))
    at = lambda c: F.when(inside, F.col(c))
    n = F.count(v)
    box = [f(at(c)).alias(f"{tag}_{c}") for c in "xyz" for tag, f in (("min", F.min), ("max", F.max))]
    return voxels.groupBy(*case).agg(
        n.alias("mask_voxels"), F.count("*").alias("total_voxels"), (n * F.lit(spacing_ml)).alias("volume_ml"),
        F.avg(v).alias("enhancement_mean"), F.stddev_pop(v).alias("enhancement_std"),
        F.avg((v < low).cast("double")).alias("low_enhancement_fraction"),
        F.avg((v >= enhancing).cast("double")).alias("enhancing_fraction"),
        (F.count_if(v >= enhancing) * F.lit(spacing_ml)).alias("functional_tumor_volume_ml"),
        *[F.avg(at(c).cast("double")).alias(f"centroid_{c}") for c in "xyz"], *box,
        F.max("intensity").alias("max_intensity"))


def stratum_curves(df: DataFrame, strata: list[str], day: str, bin_days: int, train: Column) -> DataFrame:
    """Mean response ratio per stratum and day bin over training rows.

    ``df`` holds ``volume_ml`` and its case's ``baseline_volume_ml``.
    """
    ratio = F.try_divide(F.col("volume_ml"), F.col("baseline_volume_ml"))
    return df.filter(train).groupBy(*strata, F.floor(F.col(day) / bin_days).alias("day_bin")).agg(
        F.avg(ratio).alias("mean_ratio"), F.count("*").alias("n_rows"))


def level_names(dims: list[str]) -> dict[int, str]:
    """Levels of the lattice over ``dims`` by the mask of dimensions left out, the most specific first; the last is the population."""
    n = len(dims)
    masks = sorted(range(1 << n), key=lambda m: (bin(m).count("1"), m))
    return {m: "+".join(d for i, d in enumerate(dims) if not m >> (n - 1 - i) & 1) or "population" for m in masks}


def curve_lattice(df: DataFrame, dims: list[str], day: str, bin_days: int, train: Column) -> DataFrame:
    """Mean response ratio per day bin for every subset of the dimensions, down to the population, in one pass over training rows.

    ``mask`` says which dimensions are left out (as in ``level_names``); they are null then, like a stratum whose value is null.
    """
    rows = df.select(*dims, F.floor(F.col(day) / bin_days).alias("day_bin"), F.try_divide(F.col("volume_ml"), F.col("baseline_volume_ml")).alias("ratio"),
                     train.alias("train")).filter(F.col("train") & F.col("ratio").isNotNull() & F.col("day_bin").isNotNull())
    kept = lambda m: [F.col(d) for i, d in enumerate(dims) if not m >> (len(dims) - 1 - i) & 1]
    sets = [[*kept(m), F.col("day_bin")] for m in level_names(dims)]
    return rows.groupingSets(sets, *[F.col(d) for d in dims], F.col("day_bin")).agg(
        F.shiftright(F.grouping_id(), 1).cast("int").alias("mask"), F.avg("ratio").alias("mean_ratio"), F.count("*").alias("n_rows"))


def stratum_forecast(targets: DataFrame, curves: DataFrame, dims: list[str], day: str, bin_days: int, min_rows: int, reach: int = 1) -> DataFrame:
    """``targets`` with the forecast ``point`` for ``day``, the ``level`` and the ``used_bin`` it comes from.

    Of the strata of a row, from the most specific to the population, the first decides that has a bin of at least ``min_rows`` training
    rows within ``reach`` bins of the day; of its bins the nearest, the earlier on ties. A row without any has a null forecast.
    A stratum's curve is one row: it has as many bins as the study is long.
    """
    at, picks = F.floor(F.col(day) / bin_days), []
    packed = F.array_sort(F.collect_list(F.struct("day_bin", "mean_ratio")))
    for i, (mask, name) in enumerate(level_names(dims).items()):
        held = curves.filter((F.col("mask") == mask) & (F.col("n_rows") >= min_rows))
        bins = f"c_bins{i}"
        if name == "population":
            targets = targets.withColumn(bins, held.agg(packed.alias(bins)).scalar())
        else:
            targets = attach(targets, held.groupBy(*name.split("+")).agg(packed.alias(bins)), name.split("+"))
        off = lambda x: F.abs(x["day_bin"] - at)
        none = F.lit(None).cast("struct<day_bin:bigint,mean_ratio:double>")
        near = F.aggregate(bins, none, lambda best, x: F.when((off(x) <= reach) & (best.isNull() | (off(x) < off(best))), x).otherwise(best))
        targets = targets.withColumn(f"c_near{i}", near).drop(bins)
        picks.append(F.when(F.col(f"c_near{i}").isNotNull(), F.struct(F.lit(name).alias("level"), F.col(f"c_near{i}").alias("bin"))))
    got = targets.withColumn("c_pick", F.coalesce(*picks)).drop(*[f"c_near{i}" for i in range(len(picks))])
    return got.withColumns({"level": F.col("c_pick.level"), "used_bin": F.col("c_pick.bin.day_bin"),
                            "point": F.col("baseline_volume_ml") * F.col("c_pick.bin.mean_ratio")}).drop("c_pick")


def manifest(sources: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """One table of several sources with missingness and label flags per row."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return union.withColumn("missing_fields", missing).withColumn("complete", F.size("missing_fields") == 0)


def days_ordered(df: DataFrame, case: list[str], position: str, day: str) -> DataFrame:
    """Rows per case, and how often a day is below that of the row before it by position (gaps do not matter).

    Neighbours are looked up inside stretches of positions; the ends of the stretches are compared
    after that, so no window holds a whole case.
    """
    rows = df.withColumn("d_part", F.floor(F.col(position) / STRETCH))
    inside = Window.partitionBy(*case, "d_part").orderBy(position)
    parts = rows.withColumn("d_before", F.lag(day).over(inside)).groupBy(*case, "d_part").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(day) < F.col("d_before")).alias("n_falls"),
        F.min_by(day, position).alias("d_first"), F.max_by(day, position).alias("d_last"))
    ends = Window.partitionBy(*case).orderBy("d_part")
    return parts.withColumn("d_before", F.lag("d_last").over(ends)).groupBy(*case).agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_falls") + F.coalesce((F.col("d_first") < F.col("d_before")).cast("int"), F.lit(0))).alias("n_falls"))
