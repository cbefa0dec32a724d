"""How surprising a statistic is: permutation nulls and the chi-square tail."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators.scale import attach, few, tasks_for
from cohortlab.operators.scan import PART, earlier
from cohortlab.session import materialize

#: Terms of the series and of the continued fraction.
TERMS = 200
#: Labels of a row that one whole number holds.
WORD = 60


def chi_square_tail(x: Column, dof: int) -> Column:
    """Chance that a chi-square of ``dof`` degrees exceeds ``x``: the upper incomplete gamma function.

    The series of the lower function below dof / 2 + 1, the continued fraction of the upper one beyond, where it is tiny.
    """
    a, z = dof / 2.0, F.greatest(x, F.lit(0.0)) / 2.0
    scale = F.exp(F.lit(a) * F.ln(z) - z)
    terms = F.sequence(F.lit(1), F.lit(TERMS))
    series = F.aggregate(terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda s, n: F.struct(
        (s["term"] * z / (n + a)).alias("term"), (s["sum"] + s["term"] * z / (n + a)).alias("sum")))["sum"]
    low = 1.0 - scale / math.gamma(a + 1) * series
    tail = F.aggregate(F.reverse(terms), z + (2 * TERMS + 1) - a, lambda below, n: z + (2 * n - 1) - a - n * (n - a) / below)
    high = scale / math.gamma(a) / tail
    return F.when(z <= 0, F.lit(1.0)).when(z < a + 1, low).otherwise(high)


def rank_histogram_test(ranks: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per group: cases, chi-square of the relative ranks against uniform over all bins, empty ones too, and its p-value."""
    at = F.least(F.floor(F.col("rank") * bins / (F.col("n_particles") + 1)), F.lit(bins - 1))
    held = ranks.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("c"))
    got = held.groupBy(*keys).agg(F.sum("c").alias("n_cases"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    chi = F.col("squares") * F.lit(float(bins)) / F.col("n_cases") - F.col("n_cases")
    return got.select(*keys, "n_cases", chi.alias("chi_square"), chi_square_tail(chi, bins - 1).alias("p_value"))


def relabelled(row_id: Column, b: int) -> Column:
    """A number in [0, 1) for a row under relabelling ``b``: eight hexadecimal digits of an md5; four relabellings share one."""
    part = F.substring(F.md5(F.concat(row_id.cast("string"), F.lit(f":{b // 4}"))), 1 + 8 * (b % 4), 8)
    return F.conv(part, 16, 10).cast("bigint") / F.lit(4294967296.0)


def ks_permutation(df: DataFrame, keys: list[str], value: str, first: Column, row_id: Column, n: int = 20) -> DataFrame:
    """Per group: the two sample sizes, the KS gap, and its p-value among ``n`` relabellings of the same rows.

    Relabelling ``b`` puts a row into the first sample where its hash is below that sample's share of the group. p is (1 + gaps at least as
    large) / (n + 1). Rows without a value are left out; a group with one sample only has no row. ``row_id`` tells rows apart,
    whatever the partitioning.

    A row carries its labels as bits. Rows are dealt to ranges of (group, value), equal values to one range; each range counts
    on its own and starts from the totals of the ranges before it, so one scan serves all relabellings and no task's
    memory grows with the table, unless a single value does.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + 0.0).alias("p_value_of"), F.coalesce(first, F.lit(False)).alias("p_first"), row_id.alias("p_id"))
    share = materialize(rows.groupBy(*keys).agg(F.avg(F.col("p_first").cast("double")).alias("p_share"), F.count("*").alias("n")))
    tasks = tasks_for(df, share.agg(F.sum("n")).first()[0] or 0)
    labels = [F.col("p_first"), *[relabelled(F.col("p_id"), b) < F.col("p_share") for b in range(n)]]
    bits = [F.when(label, F.lit(1 << k % WORD).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, label in enumerate(labels)]
    words = {f"p_word{w}": reduce(Column.bitwiseOR, bits[w * WORD:(w + 1) * WORD]) for w in range(-(-len(bits) // WORD))}
    placed = rows.repartitionByRange(tasks, *keys, "p_value_of").withColumn(PART, F.spark_partition_id())
    held = materialize(attach(placed, few(share), keys).select(*keys, PART, "p_value_of", *[e.alias(w) for w, e in words.items()]))
    bit = lambda k: F.shiftright(F.col(f"p_word{k // WORD}"), k % WORD).bitwiseAND(F.lit(1).cast("bigint"))
    ones = {"n": F.lit(1).cast("bigint"), "a": bit(0), **{f"a{b}": bit(b + 1) for b in range(n)}}
    totals = held.groupBy(*keys, PART).agg(*[F.sum(e).alias(s) for s, e in ones.items()])
    ends = materialize(totals.select(*keys, PART, *[F.coalesce(F.sum(s).over(earlier(keys)), F.lit(0)).alias(f"off_{s}") for s in ones],
                                     *[F.sum(s).over(Window.partitionBy(*keys)).alias(f"all_{s}") for s in ones]))
    upto = Window.partitionBy(*keys, PART).orderBy("p_value_of").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = held.repartitionByRange(tasks, PART).select(*keys, PART, *[F.sum(e).over(upto).alias(f"run_{s}") for s, e in ones.items()])
    runs = attach(runs, few(ends), [*keys, PART])
    cum = lambda s: F.col(f"off_{s}") + F.col(f"run_{s}")

    def gap(s: str) -> Column:
        rest, all_rest = cum("n") - cum(s), F.col("all_n") - F.col(f"all_{s}")
        return F.max(F.when((F.col(f"all_{s}") > 0) & (all_rest > 0), F.abs(cum(s) / F.col(f"all_{s}") - rest / all_rest)))

    got = runs.groupBy(*keys).agg(F.max("all_a").alias("n_a"), F.max(F.col("all_n") - F.col("all_a")).alias("n_b"), gap("a").alias("ks"), F.array(*[gap(f"a{b}") for b in range(n)]).alias("null"))
    at_least = F.size(F.filter("null", lambda x: x >= F.col("ks")))
    return got.filter("n_a > 0 AND n_b > 0").select(*keys, "n_a", "n_b", "ks", ((at_least + 1) / F.lit(n + 1.0)).alias("p_value"))
