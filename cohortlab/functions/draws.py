"""Reproducible random numbers keyed by data, not by partition or row order.

``with_stream`` hashes the key once per row. ``with_uniforms`` then mixes a counter
with integer arithmetic only, so drawing many numbers per key stays in generated
code. The same key and counter give the same number under any partitioning, and
again when a lost task is run a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MASK = 4294967295
MULTIPLIER = 73244475
LANES = 8
#: Counters of one row that are drawn in one place.
BLOCK = 10_000


def with_stream(df: DataFrame, parts: list[str], seed: int) -> DataFrame:
    """Add the two 32-bit words ``s_a`` and ``s_b`` of the key ``seed:parts``."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
    df = df.withColumn("s_key", key)
    return df.withColumns({
        "s_a": F.conv(F.substring("s_key", 1, 8), 16, 10).cast("bigint"),
        "s_b": F.conv(F.substring("s_key", 9, 8), 16, 10).cast("bigint"),
    }).drop("s_key")


def with_uniforms(df: DataFrame, index: str, count: int) -> DataFrame:
    """Add ``u0..`` in (0, 1) for counter ``index``; needs ``s_a`` and ``s_b``.

    Each step is its own projection so that no expression is duplicated.
    """
    if count > LANES:
        raise ValueError(f"at most {LANES} uniforms per counter")
    lanes = [f"u{d}" for d in range(count)]
    df = df.withColumns({u: F.expr(f"(s_a + {index} * {LANES}L + {d}L) & {MASK}L")
                         for d, u in enumerate(lanes)})
    df = _scramble(_scramble(df, lanes), lanes)
    df = df.withColumns({u: F.expr(f"({u} ^ shiftright({u}, 16)) ^ s_b") for u in lanes})
    df = _scramble(_scramble(df, lanes), lanes)
    return df.withColumns({u: F.expr(f"(({u} ^ shiftright({u}, 16)) + 0.5D) / 4294967296.0D")
                           for u in lanes})


def with_normals(df: DataFrame, index: str, count: int) -> DataFrame:
    """Add independent standard normals ``z0..`` (Box-Muller) for counter ``index``."""
    pairs = (count + 1) // 2
    df = with_uniforms(df, index, 2 * pairs)
    for k in range(pairs):
        df = df.withColumns({f"u{2 * k}": F.expr(f"sqrt(-2.0D * ln(u{2 * k}))"),
                             f"u{2 * k + 1}": F.expr(f"2.0D * pi() * u{2 * k + 1}")})
    out = {}
    for d in range(count):
        wave = "cos" if d % 2 == 0 else "sin"
        out[f"z{d}"] = F.expr(f"u{2 * (d // 2)} * {wave}(u{2 * (d // 2) + 1})")
    return df.withColumns(out).drop(*[f"u{d}" for d in range(2 * pairs)])


def fan_out(df: DataFrame, n: int, index: str = "particle") -> DataFrame:
    """One row per counter 0..n-1, for rows that have a stream.

    Up to ``BLOCK`` counters stay where their row is. More are dealt out in blocks, so that one row with very many
    counters is drawn by many tasks and no array grows with ``n``.
    """
    if n <= BLOCK:
        return df.withColumn(index, F.expr(f"explode(sequence(0L, {n - 1}L))"))
    blocks = df.withColumn("f_block", F.expr(f"explode(sequence(0L, {(n - 1) // BLOCK}L))")).repartition("s_a", "f_block")
    return blocks.withColumn(index, F.expr(f"explode(sequence(f_block * {BLOCK}L, least((f_block + 1) * {BLOCK}L, {n}L) - 1))")).drop("f_block")


def _scramble(df: DataFrame, lanes: list[str]) -> DataFrame:
    return df.withColumns({u: F.expr(f"(({u} ^ shiftright({u}, 16)) * {MULTIPLIER}L) & {MASK}L")
                           for u in lanes})
