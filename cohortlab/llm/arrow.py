"""Bytes, lines and words of Arrow text columns, in numpy, and how such code is run on partitions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
#: Rows of an Arrow batch, so that a batch of long texts fits beside the others.
BATCH_ROWS = 1000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Python workers find this package, and their batches hold at most ``BATCH_ROWS`` rows."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    if int(spark.conf.get(_RECORDS)) > BATCH_ROWS:
        spark.conf.set(_RECORDS, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, row after the last, their bytes, where each row starts in them.

    A null is an empty text.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = min(len(column), max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1))
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of all parts as one batch."""
    if len(parts) == 1:
        return parts[0]
    return (pa.Table.from_batches(parts).combine_chunks().to_batches() or parts)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (an invertible finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: The bytes that part words: [\x20\x09-\x0D].
SPACE = _flags(b" \t\n\x0b\x0c\r")
#: All ASCII bytes but letters and digits.
NOT_ALNUM = _flags(bytes(b for b in range(128) if not chr(b).isalnum()))


class Hasher:
    """Hashes of slices of a byte string in constant time each, from one running sum; A-Z count as a-z."""

    def __init__(self, seed: int) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self.values = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.values[65:91] = self.values[97:123]
        self.base = int(draw.integers(1, 2**63, dtype=np.uint64)) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=total[1:])
        return total

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


FIRST, SECOND = Hasher(11), Hasher(23)


def words(data: np.ndarray, starts: np.ndarray, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and the number of words before each row (and in all)."""
    inside = ~parting[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = starts[:-1], starts[1:]
    heads, tails = heads[heads < len(data)], tails[tails > 0] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, starts)
