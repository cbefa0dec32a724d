"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm import arrow
from cohortlab.session import materialize


def hypergeometric(draw: np.random.Generator, good: int, total: int, taken: int) -> int:
    """How many of ``taken`` drawn without replacement from ``total`` are among the ``good``.

    Inversion around the mode with probabilities from exact ratios, so it holds for any size;
    what lies beyond 40 standard deviations (below the smallest double) is left out.
    """
    low, high = max(0, taken - (total - good)), min(good, taken)
    if low == high:
        return low
    mode = min(high, max(low, (taken + 1) * (good + 1) // (total + 2)))
    spread = int(40 * (taken * (good / total) * (1 - good / total) * ((total - taken) / max(1, total - 1))) ** 0.5) + 40
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (taken - k)) - np.log((k + 1) * (total - good - taken + k + 1))
    logs = np.r_[0.0, np.cumsum(steps)]
    weight = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weight, draw.random() * weight[-1], "right"))


def split(draw: np.random.Generator, columns: list[int], rows: int) -> list[int]:
    """How many of ``rows`` fall to each column when all places of the columns are dealt at random."""
    left, total, out = rows, sum(columns), []
    for c in columns:
        out.append(hypergeometric(draw, c, total, left) if total else 0)
        left, total = left - out[-1], total - c
    return out


def matrix_row(counts: np.ndarray, part: int, sizes: list[int], seed: int) -> tuple[list[int], list[int]]:
    """Row ``part`` of the matrix, and the sums of the rows before it, for each shard.

    ``counts`` holds the running row counts of the partitions. Halves of the partitions share the
    shards' places by one draw each, keyed by the halving, so any task finds its own row in
    as many draws as the tree is deep, and all tasks agree on the whole matrix.
    """
    low, high, columns, before = 0, len(counts) - 1, list(sizes), [0] * len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = split(draw, columns, int(counts[middle] - counts[low]))
        if part < middle:
            columns, high = left, middle
        else:
            before = [b + x for b, x in zip(before, left, strict=True)]
            columns, low = [c - x for c, x in zip(columns, left, strict=True)], middle
    return columns, before


def permute(place: np.ndarray, size: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """A keyed permutation of 0..size-1, place by place: Feistel rounds, walked until inside."""
    place, size = place.astype(np.uint64), np.broadcast_to(np.asarray(size, np.uint64), place.shape)
    key = arrow.mix(np.broadcast_to(np.asarray(key, np.uint64), place.shape) + np.uint64(0x9E3779B97F4A7C15))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, np.uint64(2)).astype(np.float64))).astype(np.int64) + 2) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = place.copy(), np.arange(len(place))
    while len(todo):
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(6):
            left, right = right, left ^ (arrow.mix(right + k + np.uint64(turn * 0x51ED27)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _placed(df: DataFrame, shards: int, seed: int) -> tuple[DataFrame, list[int]]:
    """``df`` with ``shard`` and ``slot``, and the sizes of the shards."""
    spark = df.sparkSession
    arrow.prepare(spark)
    drop = [c for c in ("shard", "slot") if c in df.columns]
    at = F.monotonically_increasing_id()
    rows = materialize(df.drop(*drop).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    held = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(held)
    counts = np.cumsum([0, *(held[p] for p in parts)])
    total = int(counts[-1])
    extra = np.random.Generator(np.random.PCG64([seed, shards])).permutation(shards)
    sizes = [total // shards + int(x < total % shards) for x in extra]
    known = spark.sparkContext.broadcast((np.array(parts), counts))

    def place(column: pa.Array) -> pa.Array:
        parts, counts = known.value
        at = column.to_numpy()
        of, position = np.searchsorted(parts, at >> 33), at & ((1 << 33) - 1)
        shard, slot = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
        for p in np.unique(of).tolist():
            if p not in memo:
                memo.clear()
                own, before = matrix_row(counts, p, sizes, seed)
                memo[p] = np.cumsum([0, *own]), np.array(before)
            cuts, before = memo[p]
            mine = np.flatnonzero(of == p)
            local = permute(position[mine], int(counts[p + 1] - counts[p]), seed * 1_000_003 + p)
            to = np.searchsorted(cuts, local, "right") - 1
            shard[mine] = to
            slot[mine] = permute(before[to] + local - cuts[to], np.array(sizes)[to], seed * 7_000_003 + 1 + to)
        return pa.StructArray.from_arrays([pa.array(shard), pa.array(slot)], names=["shard", "slot"])

    memo: dict[int, tuple] = {}
    placed = F.arrow_udf(place, "shard int, slot long")("_at")  # only the row's number goes to Python
    return rows.withColumn("_place", placed).select(*[F.col(c) for c in rows.columns if c != "_at"], "_place.shard", "_place.slot"), sizes


def shuffle(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1, counts at most one apart) and ``slot`` (its place there, gapless).

    Works on rows of any columns (shard and slot are replaced), null, equal or empty ones alike; no rows
    give no rows. The rows are first written down with their partition and place, so that
    a lost executor repeats the same choice. The driver sees one count per partition (8 bytes each).
    """
    return _placed(df, shards, seed)[0]


def exchange(df: DataFrame, shards: int, seed: int = 7, rows_per_task: int = 100_000) -> DataFrame:
    """The rows of ``shuffle`` in their shards: moved there, and in the order of their slots.

    A shard lies in as many tasks as it has ranges of ``rows_per_task`` slots, one after the other; a task holds
    one range of one shard, ready to be written.
    """
    placed, sizes = _placed(df, shards, seed)
    cuts = max(1, -(-max(sizes) // rows_per_task))
    to = F.col("shard") * cuts + F.floor(F.col("slot") / rows_per_task).cast("int")
    return placed.repartitionById(shards * cuts, to).sortWithinPartitions("shard", "slot")
