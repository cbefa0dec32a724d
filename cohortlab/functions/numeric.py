"""Guarded numeric expressions that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Two-sided normal quantiles by central interval mass.
CENTRAL_Z = {0.5: 0.6744897501960817, 0.8: 1.2815515655446004, 0.9: 1.6448536269514722,
             0.95: 1.959963984540054, 0.99: 2.5758293035489004}
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def finite_or_null(col: Column) -> Column:
    return F.when(is_finite(col), col)


def text_number(col: Column) -> Column:
    """A plain decimal text as DOUBLE, NULL for anything else."""
    return F.when(F.rlike(col, F.lit(NUMBER)), F.trim(col).try_cast("double"))


def first_number(cols: list[Column], default: float | None = None) -> Column:
    """First alias that is neither null nor empty text, as DOUBLE."""
    texts = [F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols]
    value = text_number(F.coalesce(*texts))
    return value if default is None else F.when(F.coalesce(*texts).isNull(), F.lit(default)).otherwise(value)


def safe_log(col: Column) -> Column:
    return F.ln(F.greatest(col, F.lit(1e-12)))


def safe_logit(col: Column) -> Column:
    p = F.least(F.greatest(col, F.lit(1e-9)), F.lit(1.0 - 1e-9))
    return F.ln(p / (1.0 - p))


def safe_sigmoid(col: Column) -> Column:
    """Logistic function that never exponentiates a large positive number."""
    e = F.exp(-F.abs(col))
    return F.when(col >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def interval_to_normal(median: Column, low: Column, high: Column, space: str, mass: float = 0.8):
    """(mean, sd) of the transformed normal that has this median and central interval."""
    move = {"log": safe_log, "logit": safe_logit}[space]
    return move(median), (move(high) - move(low)) / F.lit(2.0 * CENTRAL_Z[mass])


def sphere_diameter_cm(volume: Column) -> Column:
    """Diameter of the sphere of the given volume in mL."""
    return F.cbrt(F.greatest(volume, F.lit(0.0)) * 6.0 / math.pi)


def ratio_or(numerator: Column, denominator: Column, default: float | None) -> Column:
    """Quotient, or ``default`` when the denominator is zero or null."""
    value = F.try_divide(numerator, denominator)
    return value if default is None else F.coalesce(value, F.lit(default))


def significant(col: Column, digits: int = 9) -> Column:
    """Round to significant digits (for values that span many magnitudes)."""
    return F.when(col.isNotNull(), F.format_string(f"%.{digits - 1}e", col).cast("double"))
