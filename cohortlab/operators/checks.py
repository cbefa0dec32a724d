"""Row checks as data: named constraints, reasons, accepted rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.numeric import is_finite
from cohortlab.functions.text import contains_any, matched_tokens

# Tokens that mark data as not real.
DEMO_TOKENS = ("demo", "synthetic", "simulated", "toy", "fixture")
# Phrases that must not appear in any output.
UNSAFE_PHRASES = ("will cure", "guaranteed", "best treatment", "you should take",
                  "clinical pcr prediction", "cancer is gone", "this treatment will work",
                  "this treatment will cure", "you should choose this treatment",
                  "guaranteed response")
# Exclusion reasons in the order they are tested.
EXCLUSIONS = ("missing_case_id", "missing_baseline_volume", "missing_final_volume",
              "non_positive_baseline_volume", "non_positive_final_volume", "invalid_time_order",
              "unresolved_subtype", "out_of_v1a_scope", "synthetic_or_demo_data",
              "duplicate_case_id", "unsupported_treatment_context")
# Parameter bounds as (normal low, normal high, warning high, hard low, hard high).
BOUNDS = {"growth_rate_per_day": (0.0005, 0.020, 0.030, 0.0, 0.100),
          "active_treatment_sensitivity": (0.015, 0.200, 0.300, 0.0, 0.500),
          "resistant_fraction": (0.0, 0.65, 0.75, 0.0, 0.90)}


def with_reasons(df: DataFrame, constraints: list[tuple[str, Column]], name: str = "reasons") -> DataFrame:
    """Add the names of all broken constraints; a constraint that is NULL is broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in constraints]
    return df.withColumn(name, F.filter(F.array(*broken), lambda r: r.isNotNull()))


def split(df: DataFrame, op: str, case: str = "case_id", reasons: str = "reasons",
          on_error: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects). ``on_error='fail'`` raises on the first broken row instead."""
    ok = F.size(reasons) == 0
    if on_error == "fail":
        stop = F.raise_error(F.concat(F.lit(f"{op}: "), F.concat_ws(", ", reasons)))
        accepted = df.filter(F.when(ok, F.lit(True)).otherwise(stop.cast("boolean"))).drop(reasons)
    else:
        accepted = df.filter(ok).drop(reasons)
    rejects = df.filter(~ok).select(F.col(case).cast("string").alias("case_id"), F.lit(op).alias("op"),
                                    F.col(reasons)[0].alias("reason"), F.col(reasons).alias("reasons"))
    return accepted, rejects


def case_constraints() -> list[tuple[str, Column]]:
    """Volumes positive, time ordered, early day and volume together, two points or more."""
    return [("non_positive_baseline_volume", F.col("baseline_volume_ml") > 0),
            ("non_positive_final_volume", F.col("final_volume_ml") > 0),
            ("invalid_time_order", F.col("final_day") > F.col("baseline_day")),
            ("early_point_incomplete", F.col("early_day").isNull() == F.col("early_volume_ml").isNull()),
            ("fewer_than_two_points", F.coalesce(F.col("n_points"), F.lit(2)) >= 2)]


# Where a measurement may come from.
SOURCES = ("manual", "metadata", "mask_derived", "synthetic", "demo")


def measurement_constraints(sources=SOURCES) -> list[tuple[str, Column]]:
    """Of one measurement: a case, a day from 0, a known source, a confidence text, a volume or a diameter, none of them negative."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    from_zero = lambda c: F.col(c).isNull() | (is_finite(F.col(c)) & (F.col(c) >= 0))
    return [("case_id_missing", filled("case_id")), ("day_minimum", F.col("day").isNotNull() & from_zero("day")),
            ("source_enum", F.col("source").isin(*sources)), ("confidence_missing", F.col("confidence").isNotNull()),
            ("any_of_volume_diameter", F.col("tumor_volume_ml").isNotNull() | F.col("longest_diameter_cm").isNotNull()),
            *[(f"{c}_minimum", from_zero(c)) for c in ("tumor_volume_ml", "longest_diameter_cm", "true_tumor_volume_ml")]]


def event_constraints() -> list[tuple[str, Column]]:
    """Of one dose event: a drug, a day and a dose from 0."""
    return [("drug_missing", F.col("drug").isNotNull() & (F.col("drug") != "")), ("day_minimum", is_finite(F.col("day")) & (F.col("day") >= 0)),
            ("dose_minimum", is_finite(F.col("relative_dose")) & (F.col("relative_dose") >= 0))]


def demo_tokens(payload: Column, tokens=DEMO_TOKENS) -> Column:
    """Demo tokens found in the payload text."""
    return matched_tokens(F.lower(payload), tokens)


def demo_guard(df: DataFrame, payload: Column, mode: str = "refuse") -> DataFrame:
    """``refuse`` fails the run at the first row that holds a demo token; ``exclude`` drops such rows."""
    fake = F.coalesce(contains_any(F.lower(payload), DEMO_TOKENS), F.lit(False))
    if mode == "exclude":
        return df.filter(~fake)
    return df.filter(F.when(fake, F.raise_error(F.lit("cohort holds demo or synthetic rows")).cast("boolean")).otherwise(F.lit(True)))


def schedule_reasons(events: DataFrame, drug_params: DataFrame) -> DataFrame:
    """Row checks of dose events, with decay known for the drug.

    ``drug_params(drug, decay)`` is one row per drug: the join is left to the
    planner, which broadcasts it when it is small.
    """
    known = drug_params.select(F.col("drug").alias("known_drug"), F.col("decay").alias("known_decay"))
    joined = events.join(known, F.col("drug") == F.col("known_drug"), "left")
    return with_reasons(joined, [
        ("drug_missing", F.col("drug").isNotNull() & (F.col("drug") != "")),
        ("day_negative_or_missing", is_finite(F.col("day")) & (F.col("day") >= 0)),
        ("dose_negative_or_missing", is_finite(F.col("relative_dose")) & (F.col("relative_dose") >= 0)),
        ("decay_unknown", F.col("known_decay").isNotNull())]).drop("known_drug", "known_decay")


def header_reasons(headers: DataFrame) -> DataFrame:
    """Row checks of schedule headers: the keys that must be there, and the duration.

    ``headers`` holds ``schedule_id, regimen_name, total_duration_days`` and ``has_events`` (a list of events is there, an empty one too).
    """
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return with_reasons(headers, [
        ("schedule_id_missing", filled("schedule_id")), ("regimen_name_missing", filled("regimen_name")),
        ("duration_missing", is_finite(F.col("total_duration_days"))),
        ("duration_negative", F.col("total_duration_days").isNull() | (F.col("total_duration_days") >= 0)),
        ("events_missing", F.coalesce("has_events", F.lit(False)))])


# Fixed value: the only law of growth that particles may name.
GROWTH_LAW = "logistic"


def particle_reasons(df: DataFrame, scheduled: Column | None = None) -> DataFrame:
    """Errors and warnings of wide particles with per-drug maps.

    ``scheduled`` lists the drugs of the particle's schedule: each needs its sensitivity, half-effect and decay, like those that have a
    decay. A column ``growth_law`` is looked at if it is there; a null one stands for the default.
    """
    between = lambda c, lo, hi: is_finite(F.col(c)) & F.col(c).between(lo, hi)
    values = lambda m: F.map_values(m)
    drugs = F.map_keys("drug_decay")
    if scheduled is not None:
        drugs = F.array_union(drugs, F.coalesce(scheduled, F.array().cast("array<string>")))
    covered = lambda m: F.size(F.array_except(drugs, F.map_keys(m))) == 0
    law = [("growth_law_unknown", F.coalesce("growth_law", F.lit(GROWTH_LAW)) == GROWTH_LAW)] if "growth_law" in df.columns else []
    df = with_reasons(df, [
        *law, ("decay_missing", covered("drug_decay")),
        ("growth_rate_range", between("growth_rate", 0.0, 0.1)),
        ("carrying_capacity_not_positive", is_finite(F.col("carrying_capacity_ml")) & (F.col("carrying_capacity_ml") > 0)),
        ("sensitivity_missing", covered("drug_sensitivity")), ("ec50_missing", covered("drug_ec50")),
        ("sensitivity_range", F.forall(values("drug_sensitivity"), lambda v: is_finite(v) & v.between(0.0, 1.0))),
        ("ec50_not_positive", F.forall(values("drug_ec50"), lambda v: is_finite(v) & (v > 0))),
        ("decay_not_positive", F.forall(values("drug_decay"), lambda v: is_finite(v) & (v > 0))),
        ("resistant_fraction_range", between("resistant_fraction", 0.0, 1.0)),
        ("resistant_scale_range", between("resistant_sensitivity_scale", 0.0, 1.0)),
        ("noise_range", between("observation_noise_fraction", 0.0, 1.0))], "errors")
    return with_reasons(df, [
        ("high_growth_rate", F.col("growth_rate") <= 0.05),
        ("high_sensitivity", F.forall(values("drug_sensitivity"), lambda v: v <= 0.5)),
        ("high_resistant_fraction", F.col("resistant_fraction") <= 0.6)], "warnings")


def bound_level(name: Column, value: Column) -> Column:
    """normal, outside_normal, high or hard for a bounded parameter; NULL when unbounded.

    ``outside_normal`` leaves the usual range, ``high`` passes the warning limit and
    ``hard`` is not allowed at all.
    """
    out = F.lit(None).cast("string")
    for key, (low, high, warn, hard_low, hard_high) in BOUNDS.items():
        level = (F.when(~is_finite(value) | (value < hard_low) | (value > hard_high), "hard")
                 .when(value.between(low, high), "normal").when(value > warn, "high")
                 .otherwise("outside_normal"))
        out = F.when(name == key, level).otherwise(out)
    return out


def name_contract(actual: Column, expected: Column, fixed: Column | None = None) -> dict[str, Column]:
    """Missing, unexpected and (against ``fixed``) conflicting names, sorted."""
    out = {"missing": F.array_sort(F.array_except(expected, actual)),
           "unexpected": F.array_sort(F.array_except(actual, expected))}
    if fixed is not None:
        out["conflicts"] = F.array_sort(F.array_intersect(actual, fixed))
    return out


def kinetics_gaps(sensitivities: DataFrame, kinetics: DataFrame, keys: list[str]) -> DataFrame:
    """Drugs with a sensitivity but without kinetics."""
    return sensitivities.join(kinetics.select(*keys).distinct(), keys, "left_anti")


def grid_consistency(df: DataFrame, case: list[str], particle: list[str], day: str) -> DataFrame:
    """Whether all particles of a case share one set of days.

    A particle's days are a subset of its case's days, so the grids agree exactly
    when the distinct counts do; no list of days is ever gathered.
    """
    pairs = df.select(*case, *particle, day).distinct()
    per_particle = pairs.groupBy(*case, *particle).agg(F.count("*").alias("n_days"))
    spread = per_particle.groupBy(*case).agg(F.count("*").alias("n_particles"),
                                             F.min("n_days").alias("min_days"), F.max("n_days").alias("max_days"))
    days = pairs.select(*case, day).distinct().groupBy(*case).agg(F.count("*").alias("grid_days"))
    return spread.join(days, case).withColumn("same_grid", F.col("min_days") == F.col("grid_days"))


def phrase_scan(df: DataFrame, text: str, phrases=UNSAFE_PHRASES) -> DataFrame:
    """Add the phrases found anywhere in the whole text."""
    lowered = df.withColumn("lowered_text", F.lower(F.col(text)))
    return lowered.withColumn("phrases", matched_tokens(F.col("lowered_text"), phrases)).drop("lowered_text")
