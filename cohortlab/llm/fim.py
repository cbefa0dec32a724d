"""Fill-in-the-middle by displacement scatter: every byte of a batch moves to its place at once, and back by an inverse gather."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm import arrow

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
#: Shares, in hundredths, of documents that are cut at all, and of those with the suffix first.
CUT_SHARE, SPM_SHARE = 90, 20


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four whole numbers below 2^32 from the sha256 of ``seed:doc_id``; a null doc_id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of all marks in the bytes of a chunk; a mark does not reach over the end of a row."""
    if len(data) < MARK:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    name = data[1:-1]
    at = np.flatnonzero((data[:-2] == ord("<")) & ((name == ord("P")) | (name == ord("S")) | (name == ord("M"))) & (data[2:] == ord(">")))
    row = np.searchsorted(starts, at, "right") - 1
    inside = at + MARK <= starts[row + 1]
    return row[inside], at[inside]


def displaced(size: int, begins: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The shift of every byte: segments ``begins`` (ascending, empty ones allowed) carry ``shifts``, summed up from their differences."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, begins, np.diff(shifts, prepend=0))
    return np.cumsum(change[:-1])


def rearrange(data: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Output bytes of a chunk, where its rows start in them, and per row: n, plain, spm, and the cuts in code points.

    ``h`` has four draws per row. A row is plain if it is empty, holds a mark, or by its third draw.
    """
    begin, end = starts[:-1], starts[1:]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    before = np.searchsorted(lead, starts)
    n = np.diff(before)
    cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | (h[:, 2] % 100 >= CUT_SHARE)
    plain[marks(data, starts)[0]] = True
    spm = ~plain & (h[:, 3] % 100 < SPM_SHARE)
    where = np.append(lead, len(data))
    a, b = (np.where(plain | (c == n), end, where[before[:-1] + np.where(plain, 0, c)]) for c in cut.T)  # bytes at which middle and suffix begin
    front, tail = a - begin, end - b
    sizes = np.where(plain, end - begin, end - begin + 3 * MARK)
    out_starts = np.concatenate([[0], np.cumsum(sizes)])
    place = out_starts[:-1]
    # where each part, and the mark before it, goes
    to_prefix = np.where(spm, place + MARK + tail + MARK, place + MARK)
    to_suffix = np.where(spm, place + MARK, place + MARK + front + MARK)
    to_middle = place + 3 * MARK + front + tail
    to_prefix = np.where(plain, place, to_prefix)
    begins = np.stack([begin, a, b], 1).ravel()
    shifts = np.stack([to_prefix - begin, np.where(plain, to_prefix - begin, to_middle - a), np.where(plain, to_prefix - begin, to_suffix - b)], 1).ravel()
    out = np.empty(out_starts[-1], np.uint8)
    out[np.arange(len(data)) + displaced(len(data), begins, shifts)] = data
    for mark, to in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        at = to[~plain] - MARK
        for i, byte in enumerate(mark):
            out[at + i] = byte
    return out, out_starts, {"n": n, "plain": plain, "spm": spm, "prefix": cut[:, 0], "middle": cut[:, 1] - cut[:, 0]}


def put_back(data: np.ndarray, starts: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a chunk of outputs, and where they start, by one gather.

    A text of a row that is not plain holds no mark, so its output holds exactly the three set by ``rearrange``.
    """
    begin, end = starts[:-1], starts[1:]
    row, at = marks(data, starts)
    row, at = row[~plain[row]], at[~plain[row]]
    if not np.array_equal(row, np.repeat(np.flatnonzero(~plain), 3)):
        raise ValueError("an output that is not plain needs exactly three marks")
    if not len(data):
        return data, starts
    first, second, third = (np.zeros(len(plain), np.int64) for _ in range(3))
    first[~plain], second[~plain], third[~plain] = at.reshape(-1, 3).T
    lead = np.where(spm, np.frombuffer(SUFFIX, np.uint8)[1], np.frombuffer(PREFIX, np.uint8)[1])
    other = np.where(spm, np.frombuffer(PREFIX, np.uint8)[1], np.frombuffer(SUFFIX, np.uint8)[1])
    if not (plain | ((first == begin) & (data[np.minimum(first + 1, len(data) - 1)] == lead) & (data[np.minimum(second + 1, len(data) - 1)] == other)
                     & (data[np.minimum(third + 1, len(data) - 1)] == MIDDLE[1]))).all():
        raise ValueError("marks are not in the order of the form")
    one, two = (first + MARK, second), (second + MARK, third)  # the parts before the middle, in the order of the output
    prefix, suffix = (tuple(np.where(spm, y, x) for x, y in zip(*p, strict=True)) for p in ((one, two), (two, one)))
    prefix, middle, suffix = ([np.where(plain, p, x) for p, x in zip(edge, part, strict=True)] for edge, part in
                              (((begin, end), prefix), ((end, end), (third + MARK, end)), ((end, end), suffix)))
    lengths = np.stack([hi - lo for lo, hi in (prefix, middle, suffix)], 1).ravel()
    begins = np.concatenate([[0], np.cumsum(lengths)])
    sources = np.stack([prefix[0], middle[0], suffix[0]], 1).ravel()
    text = data[np.arange(begins[-1]) + displaced(begins[-1], begins[:-1], sources - begins[:-1])]
    return text, begins[::3]


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """An Arrow column over the given bytes, without a copy."""
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def transform(docs: DataFrame, seed: str = "1") -> DataFrame:
    """Documents cut into prefix, middle and suffix, in one of three forms.

    Needs doc_id and text; other columns are left out. Returns doc_id, n (code points), form, prefix_chars and middle_chars
    (null where the form is plain) and output. Cuts follow from doc_id alone, so rows with equal or null doc_id are cut
    by equal draws, each over its own length. A null or empty text is plain and empty. Each text is worked on whole; a
    batch is cut into chunks of about a megabyte, and a longer text is a chunk of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(f"h{i}").to_numpy() for i in range(4)], 1)
            for row, stop, data, starts in arrow.chunks(batch.column("text")):
                out, at, got = rearrange(data, starts, h[row:stop])
                form = np.where(got["plain"], "plain", np.where(got["spm"], "spm", "psm"))
                chars = [pa.array(got[c].astype(np.int64), pa.int64(), mask=got["plain"]) for c in ("prefix", "middle")]
                yield pa.record_batch([batch.column("doc_id").slice(row, stop - row), pa.array(got["n"].astype(np.int64)), pa.array(form.tolist(), pa.string()), *chars, _strings(out, at)],
                                      names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    arrow.prepare(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``, the exact texts, rebuilt from the columns output and form alone.

    A null output is empty; a column restored is replaced. An output that lacks the marks of its form is an error.
    """
    rows = rows.drop("restored")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.array(batch.column("form").to_pylist(), object)
            for row, stop, data, starts in arrow.chunks(batch.column("output")):
                text, at = put_back(data, starts, form[row:stop] == "plain", form[row:stop] == "spm")
                yield pa.record_batch([*(batch.column(c).slice(row, stop - row) for c in names), _strings(text, at)], names=[*names, "restored"])

    arrow.prepare(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", restored string")
