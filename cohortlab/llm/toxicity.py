"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm import arrow

#: Hash space of the features; the weights that are not zero are a small part of it.
BITS = 24
#: Labelled rows of each class that are learned from at most (those of smallest hashed id).
CLASS_ROWS = 6000
#: Bytes of a word's beginning that count as features beside the word, so that inflected forms meet.
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 6.0, 0.1, 4

WORD, STEM, PAIR, SKIP = (np.uint64(s) for s in (0x51, 0x7A3, 0x1F29, 0x2C8D))
ODD = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed index of every feature: words, beginnings of words, pairs, and pairs with one word between.

    Words are runs of letters and digits with A-Z as a-z; pairs stay inside their row.
    """
    start, end, rows = arrow.words(data, starts, arrow.NOT_ALNUM)
    sums = arrow.FIRST.sums(data)
    word = arrow.FIRST.slices(sums, start, end)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(rows))
    parts = [(of, word * ODD + WORD)]
    for n in STEMS:
        long = np.flatnonzero(end - start >= n)
        parts.append((of[long], arrow.FIRST.slices(sums, start[long], start[long] + n) * ODD + STEM))
    for gap, kind in ((1, PAIR), (2, SKIP)):
        same = np.flatnonzero(of[gap:] == of[:-gap])
        parts.append((of[same], (word[same] ^ arrow.mix(word[same + gap] + kind)) * ODD))
    return np.concatenate([p[0] for p in parts]), (arrow.mix(np.concatenate([p[1] for p in parts])) >> np.uint64(64 - BITS)).astype(np.int64)


def rows_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct features of each text, in order."""
    for _, _, data, starts in arrow.chunks(texts):
        row, index = features(data, starts)
        both = np.unique(row << BITS | index)
        cuts = np.searchsorted(both, np.arange(len(starts)) << BITS)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield both[a:b] & ((1 << BITS) - 1)


def train(rows: list[tuple[np.ndarray, int]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights that are not zero; the last index, ``1 << BITS``, is the bias.

    Each coordinate has its own rate from the squares of its gradients; the L1 term keeps a weight at
    zero until enough gradient speaks against it.
    """
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    draw = np.random.Generator(np.random.PCG64(seed))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            index, label = rows[i]
            at = np.append(index.astype(np.int64), 1 << BITS)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weights(at)


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS) -> list[tuple[int, float]]:
    """Weights from labelled documents that are not held out.

    At most ``class_rows`` documents of each class are learned from, so one task holds them; their
    features are drawn where the texts are. Both classes are counted over all these documents, and the bias takes
    back what the sample changed in their odds. The driver sees only the weights that are not zero.
    Labels that are null, or whose document is missing, teach nothing; without any, nothing is known to be toxic and all scores are 0.
    """
    arrow.prepare(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct().filter(~held_out())
    some = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(class_rows).unionByName(
        known.filter("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(class_rows))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rates = known.groupBy("toxic").agg(F.least(F.count(F.lit(1)), F.lit(class_rows)).alias("used"), F.count(F.lit(1)).alias("all"))
    lost = {r["toxic"]: math.log(r["all"] / r["used"]) for r in rates.collect()}

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "features": pa.array([x.astype("<u4").tobytes() for x in rows_of(batch.column("text"))], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = arrow.map_batches(found.select("doc_id", "toxic", "text"), draw, f"doc_id {kind}, toxic int, features binary")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("features").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        at, w = train([(np.frombuffer(f, "<u4"), y) for _, f, y in rows])  # no copies: the features stay as they came
        yield pa.record_batch({"at": pa.array(at, pa.int64()), "w": pa.array(w, pa.float64())})

    weights = {r["at"]: r["w"] for r in drawn.repartition(1).mapInArrow(fit, "at long, w double").collect()}
    shift = lost.get(1, 0.0) - lost.get(0, 0.0)
    if shift and weights:
        weights[1 << BITS] = weights.get(1 << BITS, 0.0) + shift
    return list(weights.items())


def score(docs: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """``docs`` with ``score``, the chance that a text is toxic; null and empty texts score by the bias alone.

    A text's features count once each. Needs a column text; a column score is replaced. Without weights scores are 0.
    """
    if not weights:
        return docs.withColumn("score", F.lit(0.0))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((np.array([a for a, _ in weights], np.int64), np.array([w for _, w in weights], np.float32)))
    table: dict[str, np.ndarray] = {}
    arrow.prepare(spark)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if not table:
            dense = np.zeros((1 << BITS) + 1, np.float32)
            dense[held.value[0]] = held.value[1]
            table["w"] = dense
        w, out = table["w"], np.empty(len(texts))
        for row, stop, data, starts in arrow.chunks(texts):
            of, index = features(data, starts)
            hit = np.flatnonzero(w[index])
            both = np.unique(of[hit] << BITS | index[hit])
            total = np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], stop - row) + w[1 << BITS]
            out[row:stop] = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
        return pa.array(out)

    return docs.withColumn("score", scored("text"))
