"""Exact rank selection by refinement: count slices of the value range, then look only into those that hold a wanted rank.

No group is sorted. The first pass counts slices of 1 / ``OCTAVE`` of an octave per group, whatever the size of the values, with the least and the
largest value of each. Many wanted ranks are the first or the last of their slice, or lie in a slice of one value; the others name the
slices that the next pass reads. It ranks their values, or, where a slice holds over ``WINDOW_ROWS`` rows, cuts them again by the leading bits
of the doubles; when all bits are used, a slice is one value. A pass moves one row for each slice and map task, and its windows run
over slices or over at most ``WINDOW_ROWS`` values. Any number of value columns and probabilities share the passes.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from cohortlab.session import materialize

OCTAVE, NEXT_BITS, MANTISSA = 32, 14, 52
#: Slices with at most so many rows are ranked value by value instead of refined once more.
WINDOW_ROWS = 1 << 20


def with_code(df: DataFrame, value: str, name: str, bits: int = MANTISSA) -> DataFrame:
    """Add a whole number for each double, in the same order; equal doubles (both zeros, all NaNs) have equal ones.

    Exponent and mantissa as the format has them, found by exact scaling; the logarithm only guesses the exponent. ``bits``
    says how much of the mantissa counts.
    """
    v, two, tiny = F.col(value), F.lit(2.0), 2.0 ** -1022
    guess = F.least(F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-1022)), F.lit(1023)).cast("int")
    df = df.withColumns({"r_x": F.abs(v), "r_e": guess}).withColumn("r_h", F.shiftright(-F.col("r_e"), 1))
    x, e, m = F.col("r_x"), F.col("r_e"), F.col("r_m")
    df = df.withColumn("r_m", x * F.pow(two, F.col("r_h")) * F.pow(two, -e - F.col("r_h")))  # in [0.5, 4), whatever the rounding of the logarithm
    below, above = m < 1.0, m >= 2.0
    exponent = F.when(below, e - 1).when(above, e + 1).otherwise(e) + 1023
    scaled = F.when(below, m * 2).when(above, m / 2).otherwise(m)
    normal = F.shiftleft(exponent.cast("bigint"), MANTISSA) + ((scaled - 1.0) * F.lit(float(1 << MANTISSA))).cast("bigint")
    small = (x * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")
    infinite = F.lit(2047 << MANTISSA)
    size = F.when(F.isnan(v), infinite + 1).when(x == 0, F.lit(0).cast("bigint")).when(x == float("inf"), infinite).when(x < tiny, small).otherwise(normal)
    df = df.withColumn("r_size", size).withColumn(name, F.shiftright(F.when(v < 0, -F.col("r_size") - 1).otherwise(F.col("r_size")), MANTISSA - bits))
    return df.drop("r_x", "r_e", "r_h", "r_m", "r_size")


def _slice(value: Column) -> Column:
    """A whole number that never falls as the value rises: ``OCTAVE`` for each factor of two, down to the least double."""
    most = 1100 * OCTAVE
    octave = F.least(F.floor(F.log2(F.abs(value)) * OCTAVE), F.lit(most)) + most
    size = F.when(F.isnan(value), F.lit(2 * most + 1)).when(value == 0, F.lit(0)).otherwise(octave)
    return F.when(value < 0, -size).otherwise(size)


def _same(left: DataFrame, right: DataFrame, columns: Iterable[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in columns])


def _hits(slices: DataFrame, wanted: list[Column], keep: list[str]) -> tuple[DataFrame, int | None]:
    """One row for each wanted place with its slice, written down; ``r_x`` is its value where the slice tells it.

    ``wanted`` is one array of (idx, at, m) for each measure: the first value counts up to which measure ``m`` of the rows adds up to ``at``. Also the rows of the
    largest slice that does not tell, None if there is no such.
    """
    def inside(m: int, places: Column) -> Column:
        first, ends = F.col(f"r_first{m}"), F.col(f"r_first{m}") + F.col(f"r_w{m}")
        return F.filter(places, lambda t: ((t["at"] > first) | (F.col("r_begins") & (t["at"] <= first))) & (t["at"] <= ends))

    measures = range(len(wanted))
    found = F.concat(*[inside(m, w) for m, w in enumerate(wanted)])
    firsts = [f"r_first{m}" for m in measures]
    rows = slices.select(*keep, "r_b", "r_w0", *firsts, "r_lo", "r_hi", "r_all", F.explode(found).alias("t"))
    at, count = F.col("t.at"), F.col("t.m") == 0
    known = F.when((F.col("r_lo") == F.col("r_hi")) | (count & (at <= F.col("r_first0") + 1)), F.col("r_lo")).when(count & (at == F.col("r_first0") + F.col("r_w0")), F.col("r_hi"))
    rows = rows.select(*keep, "r_b", "r_w0", *firsts, "r_all", F.col("t.idx").alias("idx"), at.alias("at"), F.col("t.m").alias("m"), known.alias("r_x"))
    seen = Observation()
    hits = materialize(rows.observe(seen, F.max(F.when(F.col("r_x").isNull(), F.col("r_w0"))).alias("most")))
    return hits, seen.get["most"]


LIMB = 1 << 30


def _limbs(weight: Column) -> list[Column]:
    """A weight as two whole numbers, units of 2^-30 and of 2^-60, so that sums do not depend on the order of the rows."""
    units = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)) * float(LIMB)
    high = F.floor(units)
    return [high.alias("r_wh"), F.floor((units - high) * float(LIMB)).alias("r_wl")]


def _counted(rows: DataFrame, by: list[str], weighted: bool) -> DataFrame:
    """Measures of each slice, ``r_w0`` (rows) and ``r_w1`` (weight), with its least and largest value."""
    n, ends = F.count(F.lit(1)).alias("r_w0"), [F.min("r_v").alias("r_lo"), F.max("r_v").alias("r_hi")]
    if not weighted:
        return rows.groupBy(*by).agg(n, *ends)
    got = rows.groupBy(*by).agg(n, F.sum("r_wh").alias("r_wh"), F.sum("r_wl").alias("r_wl"), *ends)
    return got.withColumn("r_w1", F.col("r_wh").cast("decimal(28,0)") * LIMB + F.col("r_wl")).drop("r_wh", "r_wl")


def _select(df: DataFrame, keys: list[str], series: dict[str, Column], ranks, groups: Column | None = None, base: list[str] | None = None,
            weight: Column | None = None, thresholds=None) -> tuple[DataFrame, list[str]]:
    """Rows (work keys, r_s, m, idx, r_all, r_x): the value at each wanted place.

    ``ranks(all)`` lists 0-based ranks for a count (m = 0). With a ``weight``, ``thresholds(all)`` lists thresholds for a total weight (m = 1): the first value counts
    up to which the weights add up to the threshold.

    ``groups`` is an array of structs with the fields ``keys``, made of the columns ``base``: a row counts in each of them. Slices are then
    counted by ``base`` first, and only these counts are dealt to the groups.
    """
    work, weighted = [f"r_k{i}" for i in range(len(keys))], weight is not None
    own = [F.col(k).alias(w) for k, w in zip(keys, work, strict=True)] if groups is None else [F.col(c) for c in base]
    held = work if groups is None else list(base)
    dealt = (lambda d, more: d) if groups is None else (
        lambda d, more: d.select(F.explode(groups).alias("r_g"), *more).select(*[F.col(f"r_g.{k}").alias(w) for k, w in zip(keys, work, strict=True)], *more))
    cells = [F.struct(F.lit(i).alias("r_s"), e.cast("double").alias("r_v")) for i, e in enumerate(series.values())]
    limbs = _limbs(weight) if weighted else []
    extra, measures = (["r_wh", "r_wl"], range(2)) if weighted else ([], range(1))
    rows = df.select(*own, *limbs, (F.explode(F.array(*cells)) if len(cells) > 1 else cells[0]).alias("r_c")).select(*held, *extra, "r_c.*").filter("r_v is not null")
    group, bits, slice_ = [*work, "r_s"], 0, lambda d: d.withColumn("r_b", _slice(F.col("r_v")))
    slices = _counted(slice_(rows), [*held, "r_s", "r_b"], weighted)
    if groups is not None:
        slices = dealt(slices, ["r_s", "r_b", *[f"r_w{m}" for m in measures], "r_lo", "r_hi"]).groupBy(*group, "r_b").agg(
            *[F.sum(f"r_w{m}").alias(f"r_w{m}") for m in measures], F.min("r_lo").alias("r_lo"), F.max("r_hi").alias("r_hi"))

    def summed(d: DataFrame, part: list[str], on_bases: bool) -> DataFrame:
        line = Window.partitionBy(*part).orderBy("r_b")
        upto = line.rowsBetween(Window.unboundedPreceding, 0)
        first = {f"r_first{m}": F.sum(f"r_w{m}").over(upto) - F.col(f"r_w{m}") + (F.col(f"r_base{m}") if on_bases else F.lit(0)) for m in measures}
        return d.withColumns({**first, "r_begins": F.row_number().over(line) == 1})

    whole = Window.partitionBy(*group)
    slices = summed(slices, group, False).withColumns({f"r_all{m}": F.sum(f"r_w{m}").over(whole).cast("double") for m in measures})
    place = lambda m, list_: F.array(*[F.struct(F.lit(i).alias("idx"), at.cast("double").alias("at"), F.lit(m).alias("m")) for i, at in enumerate(list_)]).cast("array<struct<idx:int,at:double,m:int>>")
    wanted = [place(0, [r + 1 for r in ranks(F.col("r_all0"))])] + ([place(1, thresholds(F.col("r_all1")))] if weighted else [])
    hits, most = _hits(slices.withColumn("r_all", F.col("r_all0").cast("bigint")), wanted, group)
    parts = []
    while True:
        parts.append(hits.filter("r_x is not null").select(*group, "m", "idx", "r_all", "r_x"))
        if most is None:
            return reduce(DataFrame.unionByName, parts), work
        open_ = hits.filter("r_x is null").groupBy(*group, "r_b").agg(
            *[F.max(f"r_first{m}").alias(f"r_base{m}") for m in measures], F.max("r_all").alias("r_all"), F.sort_array(F.collect_set(F.struct("idx", "at", "m"))).alias("wanted"))
        bases = [f"r_base{m}" for m in measures]
        open_ = open_.select(*[F.col(c).alias(f"o_{c}") for c in (*group, "r_b")], *bases, "r_all", "wanted")
        found = slice_(rows)
        if groups is not None:
            some = open_.select(F.col("o_r_s").alias("s_r_s"), F.col("o_r_b").alias("s_r_b")).distinct()
            found = dealt(found.join(some, _same(found, some, ["r_s", "r_b"], "s_"), "left_semi"), ["r_s", "r_v", "r_b", *extra])
        found = found.join(open_, _same(found, open_, [*group, "r_b"], "o_")).select(*group, F.col("r_b").alias("r_of"), "r_v", *extra, *bases, "r_all", "wanted")
        last = most <= WINDOW_ROWS
        bits = min(MANTISSA, bits + NEXT_BITS)
        if not last:
            slice_ = lambda d, bits=bits: with_code(d, "r_v", "r_b", bits).withColumn("r_b", F.struct(_slice(F.col("r_v")).alias("octave"), F.col("r_b").alias("code")))
        inner = _counted(found.withColumn("r_b", F.col("r_v")) if last else slice_(found), [*group, "r_of", *bases, "r_all", "wanted", "r_b"], weighted)
        of = lambda m: F.filter("wanted", lambda t: t["m"] == m)
        hits, most = _hits(summed(inner, [*group, "r_of"], True), [of(m) for m in measures], group)


def quantiles(df: DataFrame, keys: list[str], series: dict[str, Column], probs: dict[str, float], groups: Column | None = None, base: list[str] | None = None,
              weight: Column | None = None, weighted: dict[str, float] | None = None) -> DataFrame:
    """Interpolated quantiles at position (n - 1) p of every series per group: keys, ``n_<series>``, ``<series>_<prob>``.

    Nulls do not count; a group in which all series are null has no row, and a series that is null in all rows of a group
    has count 0 and null quantiles there. Rows of ``df`` are read once, and once more for each refinement.
    ``groups`` (an array of structs with the fields ``keys``, made of the columns ``base``) puts a row into several groups.

    With a ``weight``, the same passes give the ``weighted`` quantiles, ``<series>_<name>``: the first value up to which the weights add up to p of their
    total. Weights count from 2^-60 to 2^33, negative and null ones as nothing; sums are of whole numbers, so a value on the threshold is the same
    in every run. Where all weights are nothing it is the first value.
    """
    spots = lambda n: [r for p in probs.values() for r in (F.floor(F.lit(p) * (n - 1)), F.ceil(F.lit(p) * (n - 1)))]
    weighted = weighted or {}
    picked, work = _select(df, keys, series, spots, groups, base, weight, lambda total: [F.lit(p) * total for p in weighted.values()])
    at = lambda s, m, i: F.max(F.when((F.col("r_s") == s) & (F.col("m") == m) & (F.col("idx") == i), F.col("r_x")))
    got = picked.groupBy(*work).agg(
        *[F.coalesce(F.max(F.when(F.col("r_s") == s, F.col("r_all"))), F.lit(0)).alias(f"q_n{s}") for s in range(len(series))],
        *[at(s, 0, i).alias(f"q_{s}_{i}") for s in range(len(series)) for i in range(2 * len(probs))],
        *[at(s, 1, i).alias(f"{name}_{w}") for s, name in enumerate(series) for i, w in enumerate(weighted)])
    out = [F.col(w).alias(k) for k, w in zip(keys, work, strict=True)]
    for s, name in enumerate(series):
        out.append(F.col(f"q_n{s}").alias(f"n_{name}"))
        for i, (prob, p) in enumerate(probs.items()):
            lo, hi, pos = F.col(f"q_{s}_{2 * i}"), F.col(f"q_{s}_{2 * i + 1}"), F.lit(p) * (F.col(f"q_n{s}") - 1)
            out.append((lo + F.when(lo == hi, 0.0).otherwise(hi - lo) * (pos - F.floor(pos))).alias(f"{name}_{prob}"))
        out += [F.col(f"{name}_{w}") for w in weighted]
    return got.select(*out)


def quantiles_of(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles`` of one column: keys, n and a column for each probability."""
    got = quantiles(df, keys, {"v": F.col(value)}, probs)
    return got.select(*keys, F.col("n_v").alias("n"), *[F.col(f"v_{p}").alias(p) for p in probs])


def order_statistic(df: DataFrame, keys: list[str], value: str, rank) -> DataFrame:
    """Keys, n and the value of the 1-based rank ``rank(n)``; null where that is beyond the count."""
    picked, work = _select(df, keys, {"v": F.col(value)}, lambda n: [F.greatest(F.least(rank(n), n), F.lit(1)) - 1])
    n = F.max("r_all")
    return picked.groupBy(*work).agg(n.alias("r_n"), F.max("r_x").alias("r_v")).select(
        *[F.col(w).alias(k) for k, w in zip(keys, work, strict=True)], F.col("r_n").alias("n"),
        F.when(rank(F.col("r_n")).between(1, F.col("r_n")), F.col("r_v")).alias(value))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """The weighted quantiles of ``quantiles`` alone: keys and a column for each probability."""
    got = quantiles(df, keys, {"v": F.col(value)}, {}, weight=F.col(weight), weighted=probs)
    return got.select(*keys, *[F.col(f"v_{p}").alias(p) for p in probs])
