"""The engine's tables taken from the given ones, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.plans.registry import table
from cohortlab.session import spread

# ---- measurements: orders of a customer, days in 16-day steps ------------------------
MEASUREMENTS = """SELECT o_custkey AS case_id,
  date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 16.0::DOUBLE AS day,
  o_totalprice / 8192.0::DOUBLE AS volume_ml, o_orderkey AS obs_id FROM orders"""


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"),
        (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 16.0).alias("day"),
        (F.col("o_totalprice") / 8192.0).alias("volume_ml"), F.col("o_orderkey").alias("obs_id"))


# ---- case context: customers as free-key JSON rows ------------------------------------
def customer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``case_id`` and the free-key row as JSON text; null fields are absent keys."""
    return spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")).selectExpr("c_custkey AS case_id", """to_json(named_struct(
      'case_id', cast(c_custkey AS string), 'data_origin', c_name,
      'subtype', CASE c_mktsegment WHEN 'BUILDING' THEN 'Triple_Negative  breast' WHEN 'MACHINERY' THEN 'TNBC'
                 WHEN 'FURNITURE' THEN 'HR positive' END,
      'treatment_regimen', CASE c_nationkey % 4 WHEN 0 THEN 'AC-T Chemotherapy' WHEN 1 THEN 'weekly_paclitaxel'
                 WHEN 2 THEN 'endocrine only' ELSE 'unknown' END,
      'er_status', CASE WHEN c_nationkey % 3 = 0 THEN 'negative' END,
      'estrogen_receptor_status', CASE WHEN c_nationkey % 3 = 1 THEN c_custkey % 7 = 0 END,
      'her2_status', CASE c_custkey % 11 WHEN 0 THEN 'HER2 +' WHEN 1 THEN 'not tested' END,
      'pathology', named_struct(
        'ki67_percent', CASE c_custkey % 6 WHEN 1 THEN c_acctbal / 100.0D WHEN 4 THEN 3.0D END,
        'ki67', CASE c_custkey % 6 WHEN 2 THEN '35%' WHEN 3 THEN 'unknown' WHEN 5 THEN '80' END,
        'grade', CASE c_custkey % 5 WHEN 2 THEN 2 END,
        'tumor_grade', CASE c_custkey % 5 WHEN 0 THEN 'III' WHEN 1 THEN 'Grade 3' WHEN 4 THEN 'i' END),
      'biomarkers', named_struct(
        'brca_status', CASE c_custkey % 4 WHEN 0 THEN 'BRCA1-positive' WHEN 1 THEN 'Pathogenic' WHEN 2 THEN 'pending' END),
      'mri_features', named_struct(
        'segmentation_qc', CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 10) / 10.0D END,
        'segmentation_quality', CASE WHEN c_custkey % 4 = 1 THEN 'Motion artifact' END,
        'registration_qc', CASE WHEN c_custkey % 9 = 0 THEN 'poor' ELSE 'good' END,
        'enhancement_std', (c_custkey % 50) / 100.0D,
        'low_enhancement_fraction', (c_custkey % 97) / 96.0D,
        'volume_ml', CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 THEN 10.0D END,
        'functional_tumor_volume_ml', CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 THEN cast(c_custkey % 13 AS double) END,
        'longest_diameter_cm', CASE WHEN c_custkey % 17 = 0 THEN 2.5D END))) AS json""")


def customer_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = customer_rows(spark, sf)
    return rows.select("case_id", F.parse_json("json").alias("context"))


# customers of whom only a diameter is known (imaging rules do not hold for them), and some without any size
FACTS = """SELECT *, raw_segmentation_low AND NOT report_only AS segmentation_low, raw_registration_low AND NOT report_only AS registration_low,
  raw_enhancement_high AND NOT report_only AS enhancement_high, raw_low_enhancement AND NOT report_only AS low_enhancement_high, raw_mismatch AND NOT report_only AS ftv_mismatch,
  CASE WHEN report_only THEN 'diameter_derived_volume' WHEN c_custkey % 19 = 0 THEN 'manual_volume' WHEN raw_segmentation_low THEN 'low_qc_mri_volume'
    WHEN c_custkey % 10 = 8 THEN 'high_qc_mri_volume' ELSE 'medium_qc_mri_volume' END AS noise_kind FROM (
  SELECT c_custkey, c_custkey AS case_id, c_custkey AS k, c_custkey % 17 = 0 AS report_only,
  c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_tnbc, c_nationkey % 4 IN (0, 1) AS is_chemo,
  c_mktsegment, c_nationkey,
  (c_custkey % 6 = 1 AND NOT (c_acctbal / 100.0::DOUBLE BETWEEN 0 AND 100)) AS ki67_bad,
  CASE c_custkey % 6 WHEN 1 THEN CASE WHEN c_acctbal / 100.0::DOUBLE BETWEEN 0 AND 100 THEN c_acctbal / 100.0::DOUBLE END
    WHEN 4 THEN 3.0 WHEN 2 THEN 35.0 WHEN 5 THEN 80.0 END::DOUBLE AS ki67,
  c_custkey % 6 IN (0, 3) AS ki67_missing,
  CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 4 THEN 1 END AS grade,
  (c_nationkey % 3 = 1 AND c_custkey % 7 = 0) OR c_custkey % 11 = 0 AS receptor_positive,
  c_custkey % 4 = 1 AS repair_positive, c_custkey % 4 IN (2, 3) AS repair_missing,
  c_custkey % 10 IN (0, 2, 4) OR c_custkey % 4 = 1 AS raw_segmentation_low, c_custkey % 9 = 0 AS raw_registration_low,
  c_custkey % 50 >= 30 AS raw_enhancement_high, c_custkey % 97 >= 34 AS raw_low_enhancement,
  c_custkey % 13 IN (0, 12) AND c_custkey % 19 <> 0 AS raw_mismatch FROM customer)"""

# ---- dose events: one schedule per user, one drug per event type -----------------------
DOSES = """SELECT user_id AS schedule_id, event_type AS drug,
  date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 86400000000.0::DOUBLE AS day,
  value / 512.0::DOUBLE AS relative_dose FROM events"""


def doses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("schedule_id"), F.col("event_type").alias("drug"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(86400000000.0)).alias("day"),
        (F.col("value") / 512.0).alias("relative_dose"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


# ---- forecasts with intervals: one per line item ---------------------------------------
FORECASTS = """SELECT l_orderkey AS case_id, l_returnflag AS method, l_linestatus AS cohort, l_linenumber AS horizon,
  l_extendedprice / 1024.0::DOUBLE AS observed, l_quantity * 1.5::DOUBLE AS point,
  CASE WHEN l_returnflag <> 'N' THEN l_quantity * 1.5::DOUBLE * (1 - 4 * l_discount) END AS lo80,
  CASE WHEN l_returnflag <> 'N' THEN l_quantity * 1.5::DOUBLE * (1 + 4 * l_discount) END AS hi80,
  CASE WHEN l_returnflag <> 'N' THEN l_quantity * 1.5::DOUBLE * (1 - 8 * l_discount) END AS lo95,
  CASE WHEN l_returnflag <> 'N' THEN l_quantity * 1.5::DOUBLE * (1 + 8 * l_discount) END AS hi95
  FROM lineitem"""


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    has = F.col("l_returnflag") != "N"
    point = F.col("l_quantity") * 1.5
    band = lambda k: F.when(has, point * (1 + k * F.col("l_discount")))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("cohort"), F.col("l_linenumber").alias("horizon"),
        (F.col("l_extendedprice") / 1024.0).alias("observed"), point.alias("point"),
        band(-4).alias("lo80"), band(4).alias("hi80"), band(-8).alias("lo95"), band(8).alias("hi95"))
