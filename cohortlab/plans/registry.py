"""Queries on the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions.numeric import significant

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already there")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 8, only: list[str] | None = None) -> DataFrame:
    """Round DOUBLE columns, so that the order of additions does not show."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name)
        if f.dataType.simpleString() == "double" and (only is None or f.name in only) else F.col(f.name)
        for f in df.schema.fields])


def R(expr: str, digits: int = 8) -> str:
    """SQL twin of ``rounded`` (adding zero removes the sign of a zero)."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def nine(expr: str) -> str:
    """SQL twin of ``significant``."""
    return f"(printf('%.8e', ({expr})::DOUBLE)::DOUBLE)"


def in_nine(df: DataFrame) -> DataFrame:
    """Round DOUBLE columns to nine digits, for sums over values of many magnitudes."""
    return df.select(*[significant(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])
