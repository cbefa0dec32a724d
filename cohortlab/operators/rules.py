"""Prior rules as data, evaluated in one projection per case.

A rule is a row: layer, id, the fact it reads, its effects. All rules of a layer are
compiled into one array expression, so applying them needs no join and no shuffle
however many cases there are; adding a rule is adding a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions import markers
from cohortlab.functions.context import Context, Value, fence, fold, stage
from cohortlab.functions.gauss import COVS, MEANS
from cohortlab.functions.text import contains_any, joined_text, normalize_text

# Fields and tokens of the scope contract.
SUBTYPE_FIELDS = ("subtype", "disease_context", "cancer_subtype")
TREATMENT_FIELDS = ("treatment_context", "treatment_regimen", "regimen_name", "schedule_type")
TNBC_TOKENS = ("tnbc", "triple negative", "triple-negative")
CHEMO_TOKENS = ("a/c-t", "ac-t", "ac t", "adriamycin", "cyclophosphamide", "anthracycline",
                "taxane", "taxol", "paclitaxel", "chemo", "chemotherapy")
UNKNOWN_TREATMENT = ("", "unknown", "unspecified", "not specified", "n/a", "na", "none")
LEARNABLE = ("growth_rate_per_day", "active_treatment_sensitivity", "resistant_fraction")
FIXED = ("carrying_capacity_ml", "drug_decay", "drug_ec50", "resistant_sensitivity_scale",
         "observation_noise_fraction", "inactive_drug_sensitivities")
ACTIVE_DRUGS = ("anthracycline", "taxane")
# Fields and tokens of the observation-noise policy.
SOURCE_FIELDS = ("source", "measurement_source", "source_type", "measurement_type", "modality")
QC_FIELDS = ("confidence", "qc", "qc_quality", "quality", "segmentation_confidence")
DIAMETER_TOKENS = ("diameter", "longest diameter", "ellipsoid")
MANUAL_TOKENS = ("manual", "entered", "user entered", "clinician", "caliper")
MRI_TOKENS = ("mri", "dce", "imaging", "segmentation", "mask", "ftv")
NOISE_HIGH = ("high", "good", "excellent")
NOISE_LOW = ("low", "poor", "uncertain", "motion", "artifact", "manual review")
NOISE_SCALE = {"diameter_derived_volume": 0.35, "manual_volume": 0.25, "high_qc_mri_volume": 0.08,
               "medium_qc_mri_volume": 0.12, "low_qc_mri_volume": 0.20}
# Marker and imaging fields in look-up order.
KI67 = ("ki67_percent", "ki67", "ki_67", "ki67_index", "proliferation_index")
GRADE = ("grade", "tumor_grade", "nottingham_grade", "histologic_grade")
RECEPTORS = {"er": ("er_status", "estrogen_receptor_status", "er"),
             "pr": ("pr_status", "progesterone_receptor_status", "pr"),
             "her2": ("her2_status", "her2", "erbb2_status")}
REPAIR = ("brca_status", "brca1_status", "brca2_status", "hrd_status",
          "homologous_recombination_deficiency", "hrd_positive")
VOLUME = ("volume_ml", "tumor_volume_ml")
FUNCTIONAL = ("functional_tumor_volume_ml", "ftv_ml", "ftv")
DIAMETER = ("longest_diameter_cm", "diameter_cm")
SEGMENTATION = ("segmentation_qc", "segmentation_confidence", "segmentation_quality")
REGISTRATION = ("registration_qc", "registration_confidence")


@dataclass(frozen=True)
class Rule:
    """One rule: when ``fact op threshold`` holds, the effects apply."""

    layer: int
    rule_id: str
    family: str
    fact: str
    op: str
    threshold: float | None
    effects: tuple[tuple[str, float], ...]
    evidence: str
    driver: bool

    @property
    def condition(self) -> str:
        """The condition as a reader sees it."""
        return self.fact if self.op == "is" else f"{self.fact} {self.op} {self.threshold:g}"

    @property
    def holds(self) -> str:
        """The condition as SQL text; a NULL fact does not hold."""
        return f"coalesce({self.fact}, false)" if self.op == "is" else f"coalesce({self.fact} {self.op} {self.threshold}, false)"

    def effect(self, name: str) -> float:
        return dict(self.effects).get(name, 1.0)


# The rules of layers 3 (pathology) and 4 (imaging quality).
RULES = (
    Rule(3, "ki67_missing_v1", "ki67", "ki67_missing", "is", None,
         (("growth_variance_multiplier", 1.25),), "missingness_policy", True),
    Rule(3, "ki67_low_v1", "ki67", "ki67", "<=", 5.0,
         (("growth_multiplier", 0.70), ("growth_variance_multiplier", 1.05)), "B", False),
    Rule(3, "ki67_high_v1", "ki67", "ki67", ">=", 30.0,
         (("growth_multiplier", 1.50), ("chemo_sensitivity_multiplier", 1.10),
          ("resistant_odds_multiplier", 0.90), ("growth_variance_multiplier", 1.10)), "A/B", False),
    Rule(3, "grade3_high_growth_v1", "grade", "grade", ">=", 3,
         (("growth_multiplier", 1.15), ("growth_variance_multiplier", 1.05)), "B", False),
    Rule(3, "grade1_lower_growth_v1", "grade", "grade", "<=", 1,
         (("growth_multiplier", 0.90),), "C", False),
    Rule(3, "tnbc_receptor_inconsistency_v1", "receptor_consistency", "receptor_positive", "is", None,
         (("growth_variance_multiplier", 1.10), ("sensitivity_variance_multiplier", 1.15),
          ("resistant_variance_multiplier", 1.15)), "data_quality_policy", True),
    Rule(3, "brca_hrd_positive_v1", "brca_hrd", "repair_positive", "is", None,
         (("chemo_sensitivity_multiplier", 1.15), ("resistant_odds_multiplier", 0.85),
          ("sensitivity_variance_multiplier", 1.05)), "B", False),
    Rule(3, "brca_hrd_missing_v1", "brca_hrd", "repair_missing", "is", None,
         (("sensitivity_variance_multiplier", 1.10), ("resistant_variance_multiplier", 1.15)),
         "missingness_policy", True),
    Rule(4, "diameter_only_report_only_v1", "measurement_mode", "report_only", "is", None,
         (), "data_quality_policy", True),
    Rule(4, "low_segmentation_qc_v1", "segmentation_qc", "segmentation_low", "is", None,
         (("growth_variance_multiplier", 1.05), ("sensitivity_variance_multiplier", 1.10),
          ("resistant_variance_multiplier", 1.10)), "data_quality_policy", True),
    Rule(4, "low_registration_qc_v1", "registration_qc", "registration_low", "is", None,
         (("growth_variance_multiplier", 1.10), ("resistant_variance_multiplier", 1.10)),
         "data_quality_policy", True),
    Rule(4, "high_enhancement_heterogeneity_v1", "enhancement_heterogeneity", "enhancement_std", ">=", 0.30,
         (("resistant_variance_multiplier", 1.25),), "data_quality_policy", True),
    Rule(4, "low_enhancement_fraction_v1", "enhancement_delivery", "low_enhancement", ">=", 0.35,
         (("sensitivity_variance_multiplier", 1.15), ("resistant_variance_multiplier", 1.20)),
         "data_quality_policy", True),
    Rule(4, "ftv_anatomic_volume_inconsistency_v1", "mri_qc_consistency", "ftv_mismatch", "is", None,
         (("sensitivity_variance_multiplier", 1.10), ("resistant_variance_multiplier", 1.10)),
         "data_quality_policy", True),
)
# What a rule says, for traces; and the noise kind that a rule names.
EXPLANATIONS = {
    "ki67_missing_v1": "Ki-67 is not known, so growth is less certain.",
    "ki67_low_v1": "A low Ki-67 speaks for slower growth.",
    "ki67_high_v1": "A high Ki-67 speaks for faster growth and a better response to chemotherapy.",
    "grade3_high_growth_v1": "Grade 3 goes with somewhat faster growth.",
    "grade1_lower_growth_v1": "Grade 1 goes with somewhat slower growth.",
    "tnbc_receptor_inconsistency_v1": "A positive receptor does not fit a triple-negative case; all parameters are less certain.",
    "brca_hrd_positive_v1": "A repair defect speaks for a better response and fewer resistant cells.",
    "brca_hrd_missing_v1": "Repair status is not known, so response and resistance are less certain.",
    "diameter_only_report_only_v1": "Only a diameter is known; it is reported but does not update the volume.",
    "low_segmentation_qc_v1": "A poor segmentation makes the volume noisier and all parameters a little less certain.",
    "low_registration_qc_v1": "A poor registration blurs change over time; growth and resistance are less certain.",
    "high_enhancement_heterogeneity_v1": "Uneven enhancement leaves more room for resistant parts.",
    "low_enhancement_fraction_v1": "Much of the tumour takes up little contrast; how well drugs reach it is less certain.",
    "ftv_anatomic_volume_inconsistency_v1": "Functional and anatomic volume do not fit together; the images need a review."}
RULE_NOISE = {"low_segmentation_qc_v1": "low_qc_mri_volume"}
SHIFTS = ("growth_multiplier", "chemo_sensitivity_multiplier", "resistant_odds_multiplier")
SPREADS = ("growth_variance_multiplier", "sensitivity_variance_multiplier", "resistant_variance_multiplier")


def scope(df: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Add ``contract_id``, ``learnable`` names and a ``scope_warning``."""
    ctx = ctx or Context()
    df, x, helpers = stage(df, {f: ctx.get(f) for f in SUBTYPE_FIELDS + TREATMENT_FIELDS})
    joined = lambda fields: joined_text([x[f].text for f in fields])
    df = df.withColumns({"subtype_text": joined(SUBTYPE_FIELDS), "treatment_text": joined(TREATMENT_FIELDS)}).drop(*helpers)
    df = df.withColumns({"is_tnbc": contains_any(F.col("subtype_text"), TNBC_TOKENS),
                         "is_chemo": contains_any(F.col("treatment_text"), CHEMO_TOKENS)})
    inside = F.col("is_tnbc") & F.col("is_chemo")
    return df.withColumns({
        "contract_id": F.when(inside, "tnbc_chemo").otherwise("conservative_generic"),
        "learnable": F.when(inside, F.array(*[F.lit(x) for x in LEARNABLE])).otherwise(
            F.array().cast("array<string>")),
        "scope_warning": F.when(~inside, F.when(
            F.col("is_tnbc") & F.col("treatment_text").isin(*UNKNOWN_TREATMENT), "treatment_unknown")
            .otherwise("outside_scope"))})


NOISE_KEYS = SOURCE_FIELDS + QC_FIELDS + ("qc_flags", "derived_from_diameter", "longest_diameter_cm", "tumor_volume_ml")


def noise_kind(df: DataFrame, ctx: Context | None = None, imaging: bool = False) -> DataFrame:
    """Add ``noise_kind``, ``log_scale_noise`` and ``noise_warning`` of a measurement context.

    With ``imaging`` the imaging defaults are filled in first, for absent keys only.
    """
    ctx = ctx or Context(nested=())
    wanted = {k: ctx.get(k) for k in NOISE_KEYS}
    if imaging:
        wanted["quality_any"] = ctx.first(SEGMENTATION)
        wanted.update({f"size_{f}": ctx.get(f) for f in VOLUME + FUNCTIONAL + DIAMETER})
    df, x, helpers = stage(df, wanted)
    df = df.withColumn("n_flags", x["qc_flags"].listed)
    texts = {k: x[k].listed for k in SOURCE_FIELDS + QC_FIELDS}
    number, derived = markers.unit_number(x["segmentation_confidence"]), x["derived_from_diameter"].text
    if imaging:
        only = diameter_only(x)
        texts["source"] = F.when(x["source"].kind.isNotNull(), texts["source"]).when(
            only, "diameter-derived volume").when(has_any(x, VOLUME + FUNCTIONAL), "DCE-MRI segmentation volume")
        derived = F.when(x["derived_from_diameter"].kind.isNotNull(), derived).when(only, "true")
        absent = x["segmentation_confidence"].kind.isNull()
        quality = markers.unit_number(x["quality_any"])
        number = F.when(absent, quality).otherwise(number)
        texts["segmentation_confidence"] = F.when(absent, quality.cast("string")).otherwise(texts["segmentation_confidence"])
        texts["qc"] = F.when(x["qc"].kind.isNotNull(), texts["qc"]).when(absent & quality.isNull(), x["quality_any"].listed)
    df = df.withColumns({
        "n_source": joined_text([texts[f] for f in SOURCE_FIELDS], hyphens=True),
        "n_qc": joined_text([texts[f] for f in QC_FIELDS] + [F.col("n_flags")], hyphens=True), "n_number": number,
        "n_diameter": F.coalesce(normalize_text(derived, hyphens=True).isin("1", "true", "yes", "y"), F.lit(False))
        | (x["longest_diameter_cm"].kind.isNotNull() & x["tumor_volume_ml"].kind.isNull())})
    source, qc, confidence = F.col("n_source"), F.col("n_qc"), F.col("n_number")
    image = (F.when(confidence >= 0.80, "high_qc_mri_volume").when(confidence < 0.50, "low_qc_mri_volume")
             .when(contains_any(qc, NOISE_LOW), "low_qc_mri_volume")
             .when(contains_any(qc, NOISE_HIGH), "high_qc_mri_volume").otherwise("medium_qc_mri_volume"))
    df = df.withColumns({"by_diameter": F.col("n_diameter") | contains_any(source, DIAMETER_TOKENS),
                         "by_hand": contains_any(source, MANUAL_TOKENS), "by_image": contains_any(source, MRI_TOKENS)})
    df = df.withColumn("noise_kind", F.when(F.col("by_diameter"), "diameter_derived_volume")
                       .when(F.col("by_hand"), "manual_volume").when(F.col("by_image"), image).otherwise("manual_volume"))
    scale = reduce(lambda e, kv: F.when(F.col("noise_kind") == kv[0], kv[1]).otherwise(e),
                   NOISE_SCALE.items(), F.lit(None).cast("double"))
    known = F.col("by_diameter") | F.col("by_hand") | F.col("by_image")
    return df.withColumns({"log_scale_noise": scale, "noise_warning": F.when(~known, "source_unknown")}).drop(
        *helpers, "n_flags", "n_source", "n_qc", "n_number", "n_diameter", "by_diameter", "by_hand", "by_image")


def has_any(x: dict[str, Value], names) -> Column:
    """Any of the staged ``size_`` keys present with a value other than null."""
    return reduce(lambda a, b: a | b, [~x[f"size_{n}"].missing for n in names])


def diameter_only(x: dict[str, Value]) -> Column:
    return has_any(x, DIAMETER) & ~has_any(x, VOLUME + FUNCTIONAL)


def with_facts(df: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Add the facts the rules read and ``fact_errors`` for values that cannot be used."""
    ctx = ctx or Context()
    wanted = {"ki67": ctx.first(KI67), "grade": ctx.first(GRADE), "std": ctx.get("enhancement_std"),
              "low": ctx.get("low_enhancement_fraction"), "volume": ctx.first(VOLUME), "ftv": ctx.first(FUNCTIONAL),
              "seg": ctx.first(SEGMENTATION), "reg": ctx.first(REGISTRATION)}
    wanted.update({m: ctx.first(fields) for m, fields in RECEPTORS.items()})
    wanted.update({f"repair_{i}": ctx.get(f) for i, f in enumerate(REPAIR)})
    wanted.update({f"size_{f}": ctx.get(f) for f in VOLUME + FUNCTIONAL + DIAMETER})
    df, x, helpers = stage(df, wanted)
    repairs = [f"repair_{i}" for i in range(len(REPAIR))]
    df, x, folds = fold(df, x, plain=["grade", *RECEPTORS, *repairs], spaced=["seg", "reg"])
    df = df.withColumn("ki67_parsed", markers.percent_number(x["ki67"]))
    ki67, ki67_bad = markers.percent(x["ki67"], F.col("ki67_parsed"))
    grade, grade_bad = markers.grade(x["grade"])
    std, std_bad = markers.optional_number(x["std"])
    low, low_bad = markers.optional_number(x["low"], 0.0, 1.0)
    volume, volume_bad = markers.optional_number(x["volume"])
    ftv, ftv_bad = markers.optional_number(x["ftv"])
    df = df.withColumns({
        "ki67": ki67, "ki67_bad": ki67_bad, "grade": grade, "grade_bad": grade_bad,
        **{m: markers.status(x[m]) for m in RECEPTORS}, "repair": F.array_compact(F.array(*[markers.status(x[r]) for r in repairs])),
        "segmentation_level": markers.qc_level(x["seg"]), "registration_level": markers.qc_level(x["reg"]),
        "std_any": std, "std_bad": std_bad, "low_any": low, "low_bad": low_bad,
        "anatomic_ml": volume, "volume_bad": volume_bad, "functional_ml": ftv, "ftv_bad": ftv_bad,
        "report_only": diameter_only(x)})
    positive = lambda c: F.coalesce(F.col(c) == "positive", F.lit(False))
    both = F.col("anatomic_ml").isNotNull() & F.col("functional_ml").isNotNull()
    ratio = F.try_divide("functional_ml", "anatomic_ml")
    imaging = ~F.col("report_only")
    gate = lambda c: F.when(imaging, c)
    repair_positive = F.array_contains("repair", "positive")
    df = df.withColumns({
        "ki67_missing": F.col("ki67").isNull() & ~F.col("ki67_bad"),
        "receptor_positive": positive("er") | positive("pr") | positive("her2"),
        "repair_positive": repair_positive,
        "repair_missing": ~repair_positive & ((F.size("repair") == 0) | F.array_contains("repair", "unknown")),
        "segmentation_low": gate(F.col("segmentation_level") == "low"),
        "registration_low": gate(F.col("registration_level") == "low"),
        "enhancement_std": gate(F.col("std_any")), "low_enhancement": gate(F.col("low_any")),
        "ftv_mismatch": gate(both & ~ratio.between(0.05, 1.10)),
        "fact_errors": F.array_compact(F.array(
            F.when(F.col("ki67_bad"), "ki67_invalid"), F.when(F.col("grade_bad"), "grade_invalid"),
            F.when(imaging & F.col("std_bad"), "enhancement_std_invalid"),
            F.when(imaging & F.col("low_bad"), "low_enhancement_invalid"),
            F.when(imaging & (F.col("volume_bad") | F.col("ftv_bad")), "volume_invalid"),
            F.when(imaging & both & ((F.col("anatomic_ml") <= 0) | (F.col("functional_ml") < 0)), "volume_range")))})
    return fence(df.drop(*helpers, *folds, "ki67_parsed", "ki67_bad", "grade_bad", "std_bad", "low_bad", "volume_bad", "ftv_bad", "std_any", "low_any"))


def layer_rules(layer: int, rules=RULES) -> list[Rule]:
    return [r for r in rules if r.layer == layer]


def hits(layer: int, rules=RULES) -> Column:
    """The rules of a layer that hold, in order, as ``array<struct>``."""
    entries = []
    for order, r in enumerate(layer_rules(layer, rules), 1):
        effects = ", ".join(f"named_struct('effect', '{k}', 'multiplier', {v}D)" for k, v in r.effects)
        array = f"array({effects})" if effects else "cast(array() as array<struct<effect:string,multiplier:double>>)"
        noise = f"'{RULE_NOISE[r.rule_id]}'" if r.rule_id in RULE_NOISE else "cast(null AS string)"
        entries.append(f"CASE WHEN {r.holds} THEN named_struct('layer', {layer}, 'ord', {order}, 'rule_id', '{r.rule_id}', "
                       f"'rule_family', '{r.family}', 'condition', '{r.condition}', 'evidence_level', '{r.evidence}', 'uncertainty_driver', {str(r.driver).lower()}, "
                       f"'effects', {array}, 'observation_noise', {noise}, 'explanation', '{EXPLANATIONS.get(r.rule_id, '')}') END")
    return F.expr(f"array_compact(array({', '.join(entries)}))")


def apply_layer(df: DataFrame, layer: int, rules=RULES) -> DataFrame:
    """Fold a layer's rules into ``m*`` and ``c*`` (shift of means, product of variances)."""
    chosen = layer_rules(layer, rules)

    def fold(name: str, start: str, sign: str, value) -> str:
        used = [r for r in chosen if name in dict(r.effects)]
        return f" {sign} ".join([start] + [f"CASE WHEN {r.holds} THEN {value(r.effect(name))!r}D ELSE {start} END" for r in used])

    shifts = {m: F.expr(f"{m} + {fold(s, '0.0D', '+', math.log)}") for m, s in zip(MEANS, SHIFTS)}
    spreads = {f"v{i}": F.expr(fold(s, "1.0D", "*", float)) for i, s in enumerate(SPREADS)}
    df = df.withColumns({**shifts, **spreads})
    return df.withColumns({c: F.expr(f"{c} * sqrt(v{c[1]}) * sqrt(v{c[2]})") for c in COVS}).drop("v0", "v1", "v2")


def with_trace(df: DataFrame, layers: list[int], rules=RULES) -> DataFrame:
    """Add the per-case ``trace``, rule ids in order, distinct uncertainty drivers, the update mode and warnings.

    A case with only a diameter is in ``report_only`` mode. Warnings of the noise policy (``noise_warning``, where the frame has it) come first.
    """
    df = df.withColumn("trace", F.concat(*[hits(n, rules) for n in layers]))
    ids = F.transform("trace", lambda h: h["rule_id"])
    drivers = F.transform(F.filter("trace", lambda h: h["uncertainty_driver"]), lambda h: h["rule_id"])
    noise = [F.col("noise_warning")] if "noise_warning" in df.columns else []
    df = df.withColumns({"rule_ids": ids, "uncertainty_drivers": F.array_distinct(drivers),
                         "update_mode": F.when(F.coalesce("report_only", F.lit(False)), "report_only").otherwise("volume_update")})
    return df.withColumn("warnings", F.array_compact(F.array(
        *noise, F.when(F.array_contains("rule_ids", "tnbc_receptor_inconsistency_v1"), "receptors_conflict"),
        F.when(F.array_contains("rule_ids", "ftv_anatomic_volume_inconsistency_v1"), "ftv_conflict"),
        F.when(F.array_contains("rule_ids", "diameter_only_report_only_v1"), "report_only"))))
