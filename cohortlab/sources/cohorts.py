"""Cohort files of free-key rows, and the case table built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlab.functions.context import Context, Value, fence, stage
from cohortlab.operators.checks import with_reasons

# Aliases of the cohort fields, first usable one wins.
BASELINE = ("baseline_volume_ml", "baseline_tumor_volume_ml", "initial_volume_ml")
FINAL_DAY = ("final_day", "heldout_day", "outcome_day")
FINAL = ("final_volume_ml", "heldout_volume_ml", "outcome_volume_ml")
EARLY_DAY = ("early_day", "followup_day")
EARLY = ("early_volume_ml", "followup_volume_ml")
POINT = ("tumor_volume_ml", "volume_ml")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """``row VARIANT, source_file`` from .json, .jsonl or .csv.

    A .json document is one task's work by nature; large cohorts belong in JSON
    Lines or Parquet, which split.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "json":
        raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
        return rows_from_documents(raw, "value")
    if suffix == "jsonl":
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
        return rows_from_lines(raw, "value")
    if suffix == "csv":
        raw = spark.read.option("header", True).csv(path)
        names = raw.columns
        kept = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names]
        return raw.select(F.parse_json(F.to_json(F.struct(*kept))).alias("row"),
                          F.col("_metadata.file_path").alias("source_file"))
    raise ValueError("cohort must be .json, .jsonl or .csv")


def rows_from_documents(df: DataFrame, column: str) -> DataFrame:
    """Rows of JSON documents: a list, an object with a list ``cases``, or one object."""
    doc = F.parse_json(F.col(column))
    others = [c for c in df.columns if c != column]
    df = df.select(*others, doc.alias("doc"))
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    cases = F.try_variant_get("doc", "$.cases", "array<variant>")
    rows = F.coalesce(as_list(F.col("doc")), cases, F.array("doc"))
    return df.select(F.explode(rows).alias("row"), *others)


def rows_from_lines(df: DataFrame, column: str) -> DataFrame:
    """One row per non-blank line of JSON."""
    others = [c for c in df.columns if c != column]
    return df.filter(F.trim(column) != "").select(F.parse_json(F.col(column)).alias("row"), *others)


def _usable(values: list[Value]) -> tuple[Column, Column]:
    """(given, number) of the first alias that is neither absent, null nor empty text."""
    given = [~v.missing & ~F.coalesce(v.text == "", F.lit(False)) for v in values]
    value = F.lit(None).cast("double")
    for ok, v in reversed(list(zip(given, values))):
        value = F.when(ok, v.number).otherwise(value)
    return reduce(lambda a, b: a | b, given), value


def cases(rows: DataFrame) -> DataFrame:
    """Case table with ``context``, ``n_points`` and ``reasons`` for unusable rows.

    A ``measurements`` list gives the points where there is one; it belongs to one
    record, so it is sorted in place.
    """
    plain = Context("row", nested=())
    names = ("case_id", "patient_id", "baseline_day", *BASELINE, *FINAL_DAY, *FINAL, *EARLY_DAY, *EARLY)
    df, x, helpers = stage(rows, {n: plain.get(n) for n in names})
    number = lambda m, n: F.try_variant_get(m, f"$.{n}", "double")
    point = lambda m: F.struct(number(m, "day").alias("day"), F.coalesce(*[number(m, n) for n in POINT]).alias("volume"))
    listed = F.filter(F.try_variant_get("row", "$.measurements", "array<variant>"),
                      lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    df = df.withColumn("series", F.array_sort(F.transform(listed, point)))
    df = df.withColumns({
        "listed": F.col("series").isNotNull(), "n_points": F.when(F.col("series").isNotNull(), F.size("series")),
        "p_first": F.try_element_at("series", F.lit(1)), "p_second": F.try_element_at("series", F.lit(2)),
        "p_last": F.try_element_at("series", F.lit(-1))})
    fields = {"b_day": ("baseline_day",), "b_vol": BASELINE, "f_day": FINAL_DAY, "f_vol": FINAL, "e_day": EARLY_DAY, "e_vol": EARLY}
    for tag, aliases in fields.items():
        given, value = _usable([x[n] for n in aliases])
        df = df.withColumns({f"{tag}_given": given, f"{tag}_value": value})
    pick = lambda of_list, tag: F.when(F.col("listed"), of_list).otherwise(F.col(f"{tag}_value"))
    second = F.when(F.col("n_points") > 2, F.col("p_second"))
    ident = lambda n: F.nullif(x[n].text, F.lit(""))
    df = df.withColumns({
        "out_id": F.coalesce(ident("case_id"), ident("patient_id"), F.lit("case")),
        "baseline_day": F.when(~F.col("listed") & ~F.col("b_day_given"), 0.0).otherwise(pick(F.col("p_first.day"), "b_day")),
        "baseline_volume_ml": pick(F.col("p_first.volume"), "b_vol"),
        "early_day": pick(second["day"], "e_day"), "early_volume_ml": pick(second["volume"], "e_vol"),
        "final_day": pick(F.col("p_last.day"), "f_day"), "final_volume_ml": pick(F.col("p_last.volume"), "f_vol")})
    bad = lambda tag: ~F.col("listed") & F.col(f"{tag}_given") & F.col(f"{tag}_value").isNull()
    df = with_reasons(df, [
        ("baseline_unusable", F.col("baseline_volume_ml").isNotNull() & F.col("baseline_day").isNotNull()),
        ("final_unusable", F.col("final_volume_ml").isNotNull() & F.col("final_day").isNotNull()),
        ("early_unusable", ~bad("e_day") & ~bad("e_vol")),
        ("fewer_than_two_points", ~F.col("listed") | (F.col("n_points") >= 2)),
        ("non_positive_volume", (F.col("baseline_volume_ml") > 0) & (F.col("final_volume_ml") > 0)),
        ("invalid_time_order", F.col("final_day") > F.col("baseline_day")),
        ("early_point_incomplete", F.col("early_day").isNull() == F.col("early_volume_ml").isNull())])
    keep = [c for c in rows.columns if c != "row" and c not in helpers]
    return fence(df.select(F.col("out_id").alias("case_id"), "baseline_day", "baseline_volume_ml", "early_day", "early_volume_ml",
                           "final_day", "final_volume_ml", "n_points", "reasons", F.col("row").alias("context"), *keep))


def case_context() -> Context:
    """The context of a case: nested maps win, the baseline is the default volume."""
    return Context(defaults={"volume_ml": F.col("baseline_volume_ml")})


def measurements(rows: DataFrame) -> DataFrame:
    """Long ``(case_id, day, volume_ml, source)`` of the rows' measurement lists."""
    get = lambda n, t: F.try_variant_get("m", f"$.{n}", t)
    ident = [F.try_variant_get("row", f"$.{n}", "string") for n in ("case_id", "patient_id")]
    long = rows.select(F.coalesce(*ident).alias("case_id"),
                       F.explode(F.try_variant_get("row", "$.measurements", "array<variant>")).alias("m"))
    return long.select("case_id", get("day", "double").alias("day"),
                       F.coalesce(*[get(n, "double") for n in POINT]).alias("volume_ml"), get("source", "string").alias("source"))


def schedules(docs: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(headers, dose events) of schedule documents held as JSON text."""
    shape = ("struct<schedule_id:string,regimen_name:string,schedule_type:string,total_duration_days:double,"
             "events:array<struct<drug:string,day:double,relative_dose:double,label:string>>>")
    parsed = docs.select(F.from_json(column, shape).alias("s")).select("s.*")
    return (parsed.drop("events"),
            parsed.select("schedule_id", F.explode("events").alias("e")).select("schedule_id", "e.*"))


def headers(docs: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Headers of schedule documents for ``checks.header_reasons``, with the columns ``keep``: what is of another type than it should be is null."""
    v = docs.select(*keep, F.try_parse_json(F.col(column)).alias("v"))
    get = lambda n, t: F.try_variant_get("v", f"$.{n}", t).alias(n)
    return v.select(*keep, get("schedule_id", "string"), get("regimen_name", "string"), get("total_duration_days", "double"),
                    F.try_variant_get("v", "$.events", "array<variant>").isNotNull().alias("has_events"))


def with_schedule(cases_: DataFrame, headers: DataFrame) -> DataFrame:
    """Cases with the header of the schedule they refer to."""
    return cases_.join(headers, "schedule_id", "left")


def lookup(docs: DataFrame, column: str, id_field: str, map_field: str) -> DataFrame:
    """Long ``(id, name, value)`` of a numeric map in JSON documents."""
    v = docs.select(F.parse_json(F.col(column)).alias("v"))
    got = v.select(F.try_variant_get("v", f"$.{id_field}", "string").alias("id"),
                   F.explode(F.try_variant_get("v", f"$.{map_field}", "map<string,double>")).alias("name", "value"))
    return got
