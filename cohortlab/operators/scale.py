"""Operations on groups of any size: one key may hold a third of all rows.

Nothing but ``few`` looks at row counts: one path serves every size, and no other job runs while a
query is built.

``attach``          join per-group values back to the rows
``prefix_totals``   running totals by value, every group cut into slices of the value range
``exact_quantiles`` interpolated quantiles from the running totals
``weighted_quantiles``, ``order_statistic`` likewise
``first_rows``      first k rows per group
``tasks_for``       how many tasks rows are dealt to
``few``             a small table as one to broadcast
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fine slices of a coarse one, as a power of two.
FINE_BITS = 20
#: Rows a task holds at once where their number counts, not their bytes.
TASK_ROWS = 250_000
#: Rows of a table that goes to every task.
FEW = 100_000


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of per-group ``stats`` onto the rows of ``df``; its count ``n`` is not kept.

    A hot group is split at run time: the session turns on skew joins.
    """
    values = [c for c in stats.columns if c not in keys and c != "n"]
    one = stats.select(*[F.col(k).alias(f"ck_{k}") for k in keys], F.struct(*values).alias("c_vals"))
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(one[f"ck_{k}"]) for k in keys])
    return df.join(one, on, "left").select(*df.columns, "c_vals.*")


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for ``rows`` rows of which a task holds about ``TASK_ROWS``; never fewer than a shuffle has.

    Adaptive execution counts compressed bytes, and small numbers take many times these in memory.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def few(stats: DataFrame) -> DataFrame:
    """``stats``, written once before, to be broadcast unless it has too many rows.

    Left alone, a table of a few groups leaves most partitions of a shuffle empty, and adaptive execution then sorts
    all rows of a group in one task.
    """
    return F.broadcast(stats) if stats.count() <= FEW else stats


def _slice(value: Column) -> Column:
    """A whole number that never falls as the value rises: about a million slices for each thousandth of its logarithm."""
    x = value.cast("double")
    code = F.signum(x) * F.log1p(F.abs(x) * 1e6) * float(1024 << FINE_BITS)
    most = float(1 << 50)
    return F.when(F.isnan(x), F.lit(most)).otherwise(F.least(F.greatest(F.floor(F.when(F.abs(x) < 1e300, code).otherwise(F.signum(x) * most)), F.lit(-most)), F.lit(most))).cast("bigint")


def prefix_totals(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (keys, value) with totals, running totals and group totals.

    For each measure ``s``: ``s`` (at this value), ``cum_s`` (values up to and including it) and
    ``all_s`` (whole group). Rows are first added up per distinct value. The values of a group
    are cut twice by their size, into coarse and fine slices; each window runs inside a
    fine slice, over the fine slices of a coarse one, or over coarse slices, so none of them
    grows with the group beyond the number of doubles of nearly one size.
    """
    work = [f"w_key{i}" for i in range(len(keys))] or ["w_key0"]
    keyed = [F.col(k).alias(w) for k, w in zip(keys, work)] or [F.lit(0).alias("w_key0")]
    names = list(sums)
    added = lambda cols: [F.sum(f"w_{s}").alias(f"w_{s}") for s in cols]
    per_value = df.filter(F.col(value).isNotNull()).groupBy(*keyed, F.col(value).alias("w_value")).agg(*[e.alias(f"w_{s}") for s, e in sums.items()])
    sliced = per_value.withColumn("w_fine", _slice(F.col("w_value"))).withColumn("w_coarse", F.shiftright("w_fine", FINE_BITS))
    fine = sliced.groupBy(*work, "w_coarse", "w_fine").agg(*added(names))
    coarse = fine.groupBy(*work, "w_coarse").agg(*added(names))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    coarse = coarse.select(*[F.col(w).alias(f"c_{w}") for w in (*work, "w_coarse")],
                           *[F.coalesce(F.sum(f"w_{s}").over(before(*work, "w_coarse")), none).alias(f"off_{s}") for s in names],
                           *[F.sum(f"w_{s}").over(Window.partitionBy(*work)).alias(f"tot_{s}") for s in names])
    fine = fine.select(*work, "w_coarse", "w_fine", *[F.coalesce(F.sum(f"w_{s}").over(before(*work, "w_coarse", "w_fine")), none).alias(f"in_{s}") for s in names])
    ends = fine.join(coarse, _match(fine, coarse, [*work, "w_coarse"], "c_")).select(
        *[F.col(w).alias(f"t_{w}") for w in (*work, "w_fine")], *[(F.col(f"off_{s}") + F.col(f"in_{s}")).alias(f"off_{s}") for s in names], *[f"tot_{s}" for s in names])
    upto = Window.partitionBy(*work, "w_fine").orderBy("w_value").rowsBetween(Window.unboundedPreceding, 0)
    run = sliced.withColumns({f"run_{s}": F.sum(f"w_{s}").over(upto) for s in names})
    run = run.join(ends, _match(run, ends, [*work, "w_fine"], "t_"))
    cols = [F.col(w).alias(k) for k, w in zip(keys, work)] + [F.col("w_value").alias(value)]
    for s in names:
        cols += [F.col(f"w_{s}").alias(s), (F.col(f"run_{s}") + F.col(f"off_{s}")).alias(f"cum_{s}"), F.col(f"tot_{s}").alias(f"all_{s}")]
    return run.select(*cols)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles at position (n - 1) p per group, plus the count ``n`` of values."""
    runs = prefix_totals(df, keys, value, {"n": F.count("*")})
    v, n, cum, first = F.col(value).cast("double"), F.col("all_n"), F.col("cum_n"), F.col("cum_n") - F.col("n")
    picks = [F.max("all_n").alias("n")]
    for name, p in probs.items():
        pos = F.lit(p) * (n - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((first <= at) & (at < cum), v)).alias(f"{tag}_{name}"))
    got = runs.groupBy(*keys).agg(*picks)
    out = {}
    for name, p in probs.items():
        w = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        out[name] = F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * w
    return got.select(*keys, "n", *[e.alias(k) for k, e in out.items()])


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """First value whose cumulative weight reaches p of the total, else the last value."""
    runs = prefix_totals(df, keys, value, {"w": F.sum(weight)})
    picks = [F.coalesce(F.min(F.when(F.col("cum_w") >= F.lit(p) * F.col("all_w"), F.col(value))),
                        F.max(value)).alias(name) for name, p in probs.items()]
    return runs.groupBy(*keys).agg(*picks)


def order_statistic(df: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """The value of the given 1-based rank (an expression of ``all_n``), with ``n``."""
    runs = prefix_totals(df, keys, value, {"n": F.count("*")})
    hit = (F.col("cum_n") - F.col("n") < rank) & (rank <= F.col("cum_n"))
    return runs.groupBy(*keys).agg(F.max("all_n").alias("n"), F.max(F.when(hit, F.col(value))).alias(value))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group in the given order.

    Spark limits each group before the shuffle, so a hot group sends at most ``k``
    rows per map task.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(rank) <= k)


def _match(left: DataFrame, right: DataFrame, columns: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in columns])
