"""Exact top-k inner products by a score-at-a-time index with quantised impacts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.llm import arrow

#: Vectors of an index block, and queries that meet a block in one task.
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
#: Impact levels of a dimension.
LEVELS = 256
#: Rounds of falling impact after which a query asks whether it may stop.
ROUNDS = (0.5, 0.3, 0.2, 0.12, 0.07, 0.04, 0.02, 0.0)


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and ``v``: floor(scale * x) of every component, without vectors that are or hold null or non-finite ones."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.filter(sound).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


class ImpactIndex:
    """Postings of a block of vectors, by dimension and sign in falling order of impact.

    A query's weight w in a dimension gives a vector with component c the contribution
    |w| * impact, where the impact is c above the block's lowest component (w > 0) or below its
    highest (w < 0), plus a constant of the query. Impacts are cut into levels; a posting's level
    bounds its contribution from below and, with one level more, from above.
    """

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        low, high = matrix.min(0), matrix.max(0)
        self.step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.low, self.high = low, high
        self.ids, self.levels = {}, {}
        for sign in (1, -1):
            impact = matrix - low if sign > 0 else high - matrix
            level = impact // self.step
            order = np.argsort(-level, axis=0, kind="stable")
            self.ids[sign] = np.ascontiguousarray(order.T)
            self.levels[sign] = np.ascontiguousarray(np.take_along_axis(level, order, 0).T)

    def search(self, query: np.ndarray, k: int, own: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of the k best scores (all, if fewer), ties to smaller names, their scores, and postings read.

        ``own`` marks rows that are no candidates. Segments come in falling order of impact; the query
        stops when no row outside the possible members can reach the k-th lower bound, and
        the possible members are scored exactly.
        """
        n = len(self.matrix)
        weight = np.abs(query)
        dims = np.flatnonzero(weight)
        signs = np.where(query > 0, 1, -1)
        constant = int((query * np.where(query > 0, self.low, self.high)).sum())
        unit = weight * self.step
        most = unit * np.array([self.levels[signs[d]][d][0] + 1 for d in range(len(query))]) if len(query) else weight
        top, at = int(most.max(initial=0)), np.zeros(len(query), np.int64)
        floor, slack = np.zeros(n, np.int64), int(unit[dims].sum())  # exact score - constant is in [floor, floor + slack + rest)
        floor[own] = np.iinfo(np.int64).min // 2
        k, read = min(k, int((~own).sum())), 0
        if not k:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        possible = np.flatnonzero(~own)
        for share in ROUNDS:
            least = int(top * share)
            rest = 0
            for d in dims:
                levels = self.levels[signs[d]][d]
                # Postings whose upper bound is above the round's floor.
                end = np.searchsorted(-levels, -(least // unit[d] - 1), "left") if least else n
                end = max(int(end), int(at[d]))
                if end > at[d]:
                    floor[self.ids[signs[d]][d][at[d] : end]] += unit[d] * levels[at[d] : end]
                    read += end - int(at[d])
                    at[d] = end
                if end < n:
                    rest += int(unit[d] * levels[end])
            bar = np.partition(floor, n - k)[n - k]
            possible = np.flatnonzero(floor + (slack + rest) >= bar)
            if len(possible) <= max(4 * k, n // 50) or share == 0:
                break
        possible = possible[~own[possible]]
        exact = self.matrix[possible] @ query
        order = np.lexsort((names[possible], -exact))[:k]
        return possible[order], exact[order], read


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all ``vectors`` but the query's own, for every row of ``queries``.

    Both have vec_id and ``v`` (integers; shorter vectors end in zeros, sums stay within 64 bits). Rows of one
    vec_id are the same vector's own; repeated queries with equal vectors are asked once, repeated vectors
    are candidates each. A null vec_id is never a query, and as a candidate it comes last in a tie.
    Vectors are dealt to blocks and queries to groups; each pair of block and group is one
    bounded task, and only its k best per query go on.
    """
    arrow.prepare(vectors.sparkSession)
    queries = queries.filter(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "v"])
    blocks, groups = (int(df.count() // rows + 1) for df, rows in ((vectors, BLOCK_ROWS), (queries, QUERY_ROWS)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select("vec_id", "v", deal(blocks).alias("block")).withColumn("group", every(groups))
    asked = queries.select("vec_id", "v", deal(groups).alias("group")).withColumn("block", every(blocks))

    def run(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):
            width = max(max(map(len, ask["v"])), max(map(len, have["v"])))
            index, names = ImpactIndex(_matrix(have["v"], width)), have["vec_id"].astype("Int64")
            last = names.isna().to_numpy()
            names = names.fillna(0).to_numpy(np.int64)
            place = np.empty(len(names), np.int64)  # ties: smaller vec_id first, nulls at the end
            place[np.lexsort((names, last))] = np.arange(len(names))
            for q, vector in zip(ask["vec_id"].astype("int64"), _matrix(ask["v"], width), strict=True):
                rows, scores, _ = index.search(vector, k, (names == q) & ~last, place)
                out.append(pd.DataFrame({"query_id": q, "vec_id": pd.array(names[rows], "Int64"), "score": scores}).assign(
                    vec_id=lambda x, r=rows: x["vec_id"].mask(last[r])))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    best = asked.groupBy("block", "group").cogroup(held.groupBy("block", "group")).applyInPandas(lambda a, b: run(a, b), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
