"""Trajectories that look alike although their parameters differ."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators import scan
from cohortlab.session import materialize

#: Particles of a tile; a task compares two tiles at a time, as matrices, so that each is sent to few others.
TILE = 2048
#: Particles of a tile that meet the other tile at once.
STRIP = 256
#: Stretches of a path whose means are compared before the path itself.
SEGMENTS = 8


def segment_means(path: Column, segments: int = SEGMENTS) -> Column:
    """Weighted means of ``segments`` stretches of a path: the distance of two such arrays is never above the RMSE of the paths."""
    n = F.size(path)
    start = lambda i: F.floor(n * i / segments).cast("int")
    size = lambda i: start(i + 1) - start(i)
    total = lambda i: F.aggregate(F.slice(path, start(i) + 1, size(i)), F.lit(0.0), _add)
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.when(size(i) > 0, total(i) / F.sqrt(size(i) * n)).otherwise(0.0))


def tiles(df: DataFrame, case: str, particle: str, path: str, params: str) -> DataFrame:
    """Rows with their path's ``mean``, ``segments`` and ``tile``: about ``TILE`` particles of a case with neighbouring means."""
    mean = F.aggregate(path, F.lit(0.0), _add) / F.size(path)
    head = df.select(case, particle, path, params, mean.alias("mean"), segment_means(F.col(path)).alias("segments"))
    rows = scan.ranged(head, [case], ["mean", particle])
    place = F.row_number().over(Window.partitionBy(case, scan.PART).orderBy("mean", particle)) - 1
    return materialize(rows.withColumn("tile", (F.col(scan.PART).cast("bigint") * (1 << 32) + F.floor(place / TILE)).cast("bigint")).drop(scan.PART))


def tile_pairs(rows: DataFrame, case: str, tolerance: float) -> DataFrame:
    """(case, i, j): tiles, i <= j, that may hold near-equal particles.

    On a logarithmic scale of the mean, partners are at most one band apart, so only tiles with neighbouring bands meet; of these, those
    whose boxes of segment means are further apart than the tolerance allows are left out.
    """
    width = math.log((1 + tolerance / 2) / (1 - tolerance / 2))
    band = F.floor(F.when(F.col("mean") > 1, 1 + F.ln("mean")).otherwise(F.col("mean")) / width)
    ends = lambda f, tag: [f(F.get("segments", F.lit(s))).alias(f"{tag}{s}") for s in range(SEGMENTS)]
    boxes = rows.groupBy(case, "tile").agg(F.min(band).alias("low"), F.max(band).alias("high"), F.max("mean").alias("top"), *ends(F.min, "lo"), *ends(F.max, "hi"))
    boxes = boxes.select(case, "tile", "low", "high", "top", *[F.array(*[f"{tag}{s}" for s in range(SEGMENTS)]).alias(tag) for tag in ("lo", "hi")])
    side = lambda t, wide: boxes.select(case, F.explode(F.sequence(F.col("low") - wide, F.col("high") + wide)).alias("band"), *[F.col(c).alias(f"{t}_{c}") for c in ("tile", "top", "lo", "hi")])
    met = side("a", 1).join(side("b", 0), [case, "band"]).filter("a_tile <= b_tile")
    gap = lambda s: F.greatest(F.lit(0.0), F.get("b_lo", F.lit(s)) - F.get("a_hi", F.lit(s)), F.get("a_lo", F.lit(s)) - F.get("b_hi", F.lit(s)))
    apart = F.sqrt(sum((gap(s) * gap(s) for s in range(SEGMENTS)), F.lit(0.0)))
    scale = F.greatest((F.col("a_top") + F.col("b_top")) / 2.0, F.lit(1.0))
    return met.filter(apart <= tolerance * scale * (1 + 1e-9)).select(case, F.col("a_tile").alias("i"), F.col("b_tile").alias("j")).distinct()


def near_equal(df: DataFrame, case: str, particle: str, path: str, params: str,
               tolerance: float = 0.08, gap: float = 0.25) -> DataFrame:
    """Per particle that has any: how many near-equal partners it has, and the closest one (ties: the smaller id).

    All particles of a case are compared; one row per particle is returned, not one per pair.

    ``path`` and ``params`` are DOUBLE arrays of equal length within a case. A pair
    counts when the normalised RMSE of the paths is at most ``tolerance`` and the mean
    range-scaled parameter difference is at least ``gap``.

    Particles lie in tiles by their mean, and tiles meet tiles (``tile_pairs``): no pair that qualifies is lost, and no task
    holds more than two tiles at a time, however many particles a band of means has. Two tiles meet as matrices (``_meet``), and what
    leaves their task is one row per particle with a partner there, not one per pair.
    """
    size = df.select(case, F.posexplode(params)).groupBy(case, "pos").agg((F.max("col") - F.min("col")).alias("r"))
    ranges = size.groupBy(case).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda e: F.greatest(e["r"], F.lit(1e-9))).alias("ranges"))
    # a path with a null or an endless value is near nothing, nor are parameters that miss one
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    rows = tiles(df.filter(F.forall(path, finite)), case, particle, path, params)
    cells = materialize(tile_pairs(rows, case, tolerance))
    sound = rows.join(ranges, case).filter(F.forall(params, lambda x: x.isNotNull()) & (F.size(params) == F.size("ranges")))
    held = sound.select(case, "tile", F.col(particle).alias("id"), F.col("mean").alias("m"), F.col(path).alias("x"), F.col(params).alias("p"), "ranges")
    side = lambda own: cells.join(held.withColumnRenamed("tile", own), [case, own]).select(
        F.col(case).alias("c"), *[F.col(c).alias(c) for c in ("i", "j", "id", "m", "x", "p", "ranges")]).groupBy("c", "i", "j")
    id_type = df.schema[particle].dataType.simpleString()
    met = side("i").cogroup(side("j")).applyInArrow(partial(_meet, tolerance=tolerance, gap=gap),
                                                    f"c {df.schema[case].dataType.simpleString()}, id {id_type}, n bigint, rmse double, partner {id_type}")
    return met.groupBy(F.col("c").alias(case), F.col("id").alias(particle)).agg(F.sum("n").alias("n_partners"), F.min(F.struct("rmse", "partner")).alias("best")).select(
        case, particle, "n_partners", F.col("best.partner").alias("closest"), F.col("best.rmse").alias("trajectory_normalized_rmse"))


def _meet(left: pa.Table, right: pa.Table, tolerance: float, gap: float) -> pa.Table:
    """Near-equal pairs of two tiles (or of one with itself), added up per particle.

    A product of matrices tells, with room for its rounding, which pairs of paths may be near; these are compared point by point.
    """
    columns = ("c", "id", "n", "rmse", "partner")
    out = pa.schema([left.schema.field("c"), left.schema.field("id"), pa.field("n", pa.int64()), pa.field("rmse", pa.float64()),
                     left.schema.field("id").with_name("partner")])
    if not left.num_rows or not right.num_rows:
        return out.empty_table()
    alone = left["i"][0].as_py() == left["j"][0].as_py()
    ids = pa.chunked_array([*left["id"].chunks, *right["id"].chunks])
    # equal ids share a number, and a null comes first, as in the order of the rows
    order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    a_id, b_id, split = order[:left.num_rows], order[left.num_rows:], left.num_rows
    of = {int(k): at for at, k in reversed(list(enumerate(order)))}  # a row that holds the id
    ranges = np.asarray(left["ranges"][0].as_py(), dtype=float)
    a_len, b_len = pc.list_value_length(left["x"]).to_numpy(), pc.list_value_length(right["x"]).to_numpy()
    found = []
    for width in np.intersect1d(a_len, b_len):
        a_at, b_at = np.flatnonzero(a_len == width), np.flatnonzero(b_len == width)
        block = lambda column, at, w: pc.list_flatten(column.take(pa.array(at))).to_numpy().reshape(len(at), w)
        a, b = block(left["x"], a_at, width), block(right["x"], b_at, width)
        a_p, b_p = block(left["p"], a_at, len(ranges)), block(right["p"], b_at, len(ranges))
        a_m, b_m = left["m"].to_numpy()[a_at], right["m"].to_numpy()[b_at]
        with np.errstate(all="ignore"):
            a_sq, b_sq = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
            room = 8 * (width + 8) * np.finfo(float).eps
            for low in range(0, len(a), STRIP):
                strip = slice(low, low + STRIP)
                far = a_sq[strip, None] + b_sq
                scale = np.maximum((a_m[strip, None] + b_m) / 2.0, 1.0)
                most = np.square(tolerance * scale) * (width * (1 + 1e-9)) + room * far
                far -= 2.0 * (a[strip] @ b.T)
                i, j = np.nonzero(~(far > most))  # what overflows is compared too
                i += low
                if alone:
                    first = (a_id[a_at[i]] < b_id[b_at[j]]) & known[a_at[i]] & known[split + b_at[j]]
                    i, j = i[first], j[first]
                total = np.zeros(len(i))
                for k in range(width):
                    d = a[i, k] - b[j, k]
                    total += d * d
                rmse = np.sqrt(total / width) / np.maximum((a_m[i] + b_m[j]) / 2.0, 1.0)
                near = rmse <= tolerance
                i, j, rmse = i[near], j[near], rmse[near]
                apart = np.zeros(len(i))
                for k, r in enumerate(ranges):
                    apart += np.abs(a_p[i, k] - b_p[j, k]) / r
                apart /= len(ranges)
                wide = ~(apart < gap)
                own, other = a_id[a_at[i[wide]]], b_id[b_at[j[wide]]]
                found.append(_per_particle(np.concatenate([own, other]), np.concatenate([other, own]), np.tile(rmse[wide], 2), np.ones(2 * wide.sum(), dtype=np.int64)))
    if not found:
        return out.empty_table()
    own, other, rmse, n = _per_particle(*map(np.concatenate, zip(*found)))
    taken = lambda x: ids.take(pa.array([of[int(k)] for k in x], type=pa.int64()))
    case = left["c"].take(pa.array(np.zeros(len(own), dtype=np.int64)))
    return pa.table(dict(zip(columns, (case, taken(own), pa.array(n), pa.array(rmse), taken(other)))), schema=out)


def _per_particle(own: np.ndarray, other: np.ndarray, rmse: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per particle: the closest partner (ties: the smaller), its distance, and the sum of ``n``."""
    by = np.lexsort((other, rmse, own))
    own, other, rmse, n = own[by], other[by], rmse[by], n[by]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, dtype=np.int64)
    return own[first], other[first], rmse[first], np.add.reduceat(n, first) if len(first) else n


def _add(acc: Column, x: Column) -> Column:
    return acc + x
