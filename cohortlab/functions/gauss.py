"""Three-parameter Gaussian algebra on unrolled DOUBLE columns.

Order of the parameters: log growth, log sensitivity, logit resistant fraction.
Means are ``m0..m2``; the covariance is its upper triangle ``c00 c01 c02 c11 c12 c22``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.numeric import is_finite, safe_log, safe_logit, safe_sigmoid

MEANS = ["m0", "m1", "m2"]
COVS = ["c00", "c01", "c02", "c11", "c12", "c22"]


def to_transformed(growth: Column, sensitivity: Column, resistant: Column) -> list[Column]:
    return [safe_log(growth), safe_log(sensitivity), safe_logit(resistant)]


def from_transformed(z0: Column, z1: Column, z2: Column) -> list[Column]:
    return [F.exp(z0), F.exp(z1), safe_sigmoid(z2)]


def with_cholesky(df: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Add the lower factor ``l00 l10 l11 l20 l21 l22`` and ``psd``.

    A pivot below ``-tolerance`` makes the matrix indefinite. Where a root is within
    the tolerance of zero, the rest of its column must be too.
    """
    c = {k: F.col(k) for k in COVS}
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    over = lambda a, b: F.when(b > tolerance, a / b).otherwise(F.lit(0.0))
    # one projection per step, so that no factor is computed twice
    df = df.withColumns({"p0": c["c00"], "l00": root(c["c00"])})
    df = df.withColumns({"l10": over(c["c01"], F.col("l00")), "l20": over(c["c02"], F.col("l00"))})
    df = df.withColumns({"p1": c["c11"] - F.col("l10") * F.col("l10"),
                         "r1": c["c12"] - F.col("l10") * F.col("l20")})
    df = df.withColumns({"l11": root(F.col("p1"))})
    df = df.withColumns({"l21": over(F.col("r1"), F.col("l11"))})
    df = df.withColumns({"p2": c["c22"] - F.col("l20") * F.col("l20") - F.col("l21") * F.col("l21")})
    df = df.withColumns({"l22": root(F.col("p2"))})
    psd = F.lit(True)
    for col in c.values():
        psd = psd & is_finite(col)
    for pivot in ("p0", "p1", "p2"):
        psd = psd & (F.col(pivot) >= -tolerance)
    for lead, rest in (("l00", (c["c01"], c["c02"])), ("l11", (F.col("r1"),))):
        for cell in rest:
            psd = psd & ((F.col(lead) > tolerance) | (F.abs(cell) <= tolerance))
    return df.withColumn("psd", F.coalesce(psd, F.lit(False))).drop("p0", "p1", "p2", "r1")


def covariance_errors(matrix: list[list[Column]], tolerance: float = 1e-10) -> Column:
    """Reasons why a full 3x3 matrix is not a finite symmetric one."""
    finite = F.lit(True)
    for row in matrix:
        for cell in row:
            finite = finite & is_finite(cell)
    skew = F.lit(False)
    for i in range(3):
        for j in range(i):
            skew = skew | (F.abs(matrix[i][j] - matrix[j][i]) > tolerance)
    return F.filter(F.array(F.when(~finite, F.lit("not_finite")),
                            F.when(finite & skew, F.lit("not_symmetric"))), lambda x: x.isNotNull())
