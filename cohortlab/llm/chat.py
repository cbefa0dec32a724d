"""Chat formatting: conversations assembled column-wise into one buffer, with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm import arrow

# Fixed values of the template: "### role\ntext</turn>\n", a backslash before any control string inside.
HEAD, MIDDLE, TAIL = b"### ", b"\n", b"</turn>\n"
ESCAPE = ord("\\")
TURN = re.compile(rb"### ((?:[^\\\n]+|\\.)*)\n((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)
ESCAPED = re.compile(rb"\\(.)", re.S)

PARTS = "conv_id long, part int, n_turns int, formatted binary, turn_ends array<long>, loss_starts array<long>, loss_ends array<long>"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _is(data: np.ndarray, starts: np.ndarray, what: bytes) -> np.ndarray:
    """Where ``what`` begins and ends inside one row."""
    n = len(data) - len(what) + 1
    out = np.zeros(len(data), bool)
    if n > 0:
        left = np.repeat(starts[1:], np.diff(starts))[:n] - np.arange(n)
        out[:n] = np.logical_and.reduce([left >= len(what), *(data[k : k + n] == b for k, b in enumerate(what))])
    return out


def _scatter(out: np.ndarray, data: np.ndarray, starts: np.ndarray, risky: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Copy each row's bytes to ``at``, a backslash before the risky ones; the rows' ends in ``out``."""
    more = np.r_[0, np.cumsum(risky)]
    length = np.diff(starts)
    place = np.arange(len(data)) + np.repeat(at - starts[:-1] - more[starts[:-1]], length) + more[1:]
    out[place] = data
    out[place[risky] - 1] = ESCAPE
    return at + length + np.diff(more[starts])


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer for all turns; where each turn begins (and the end), and where its text begins and ends."""
    role, role_at = _bytes(roles)
    text, text_at = _bytes(texts)
    text_risk = (text == ESCAPE) | _is(text, text_at, b"###") | _is(text, text_at, b"</turn>")
    role_risk = (role == ESCAPE) | (role == 10) | (role == ord("#")) | (role == ord("<"))
    grown = lambda at, risk: np.diff(at) + np.diff(np.r_[0, np.cumsum(risk)][at])
    role_len, text_len = grown(role_at, role_risk), grown(text_at, text_risk)
    begin = np.r_[0, np.cumsum(len(HEAD) + role_len + len(MIDDLE) + text_len + len(TAIL))]
    out = np.empty(begin[-1], np.uint8)
    for k, b in enumerate(HEAD):
        out[begin[:-1] + k] = b
    role_end = _scatter(out, role, role_at, role_risk, begin[:-1] + len(HEAD))
    out[role_end] = MIDDLE[0]
    text_end = _scatter(out, text, text_at, text_risk, role_end + 1)
    for k, b in enumerate(TAIL):
        out[text_end + k] = b
    return out, begin, role_end + 1, text_end


def turns_of(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts read back from formatted bytes."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at byte {at}")
        out.append((ESCAPED.sub(rb"\1", m[1]), ESCAPED.sub(rb"\1", m[2])))
        at = m.end()
    return out


def format_turns(rows: DataFrame) -> DataFrame:
    """Formatted conversations in parts: at most one part per conversation and Arrow batch, in order.

    ``rows`` needs conv_id, turn, role and text. Turns are ordered by turn, then role, then text (nulls
    first), so repeated rows are repeated turns. A null role or text is empty; rows with a null
    conv_id are one conversation. Text under the loss mask is what assistants say. A task holds
    one batch at a time: a conversation of any length streams through in several parts.
    """
    arrow.prepare(rows.sparkSession)
    keyed = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    keyed = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = (), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out, begin, start, end = assemble(batch.column("role"), batch.column("text"))
            ids = batch.column("conv_id").to_pylist()
            cuts = np.array([0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)])
            parts = np.zeros(len(cuts) - 1, np.int32)
            part = parts[0] = part + 1 if last == (ids[0],) else 0
            part, last = int(parts[-1]), (ids[-1],)
            base = np.repeat(begin[cuts[:-1]], np.diff(cuts))
            spoken = np.flatnonzero(pc.fill_null(pc.equal(batch.column("role"), "assistant"), False).to_numpy(zero_copy_only=False))
            of = pa.array(np.searchsorted(spoken, cuts).astype(np.int32))
            yield pa.record_batch([
                batch.column("conv_id").take(pa.array(cuts[:-1])), pa.array(parts), pa.array(np.diff(cuts).astype(np.int32)),
                columns_over(out, begin[cuts]), runs(begin[1:] - base, cuts), *(pa.ListArray.from_arrays(of, pa.array((x - base)[spoken])) for x in (start, end))],
                names=[x.split()[0] for x in PARTS.split(", ")])

    return keyed.mapInArrow(run, PARTS)


def columns_over(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are stretches of one buffer; nothing is copied."""
    if offsets[-1] >= 1 << 31:
        raise ValueError("an Arrow batch of formatted text reaches 2 GB; lower the rows of a batch")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def runs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int64)))


def _points(data: bytes) -> int:
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, what is read back from its formatted parts (which come in order, as ``format_turns`` gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["part"] == 0:
                    if now:
                        done.append(now)
                    now = {"conv_id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, text in turns_of(row["formatted"]):
                    now["n"] += 1
                    now["turns"].update(role + b"\n" + text + b"\n")
                for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    said = ESCAPED.sub(rb"\1", row["formatted"][a:b])
                    now["loss"].update(said)
                    now["loss_chars"] += _points(said)
                now["chars"] += _points(row["formatted"])
            if done:
                yield rows_of(done)
        if now:
            yield rows_of([now])

    def rows_of(done: list[dict]) -> pa.RecordBatch:
        return pa.record_batch({
            "conv_id": pa.array([x["conv_id"] for x in done], pa.int64()), "n_turns": pa.array([x["n"] for x in done], pa.int64()),
            "turns_sha256": [x["turns"].hexdigest() for x in done], "loss_chars": pa.array([x["loss_chars"] for x in done], pa.int64()),
            "loss_sha256": [x["loss"].hexdigest() for x in done], "formatted_chars": pa.array([x["chars"] for x in done], pa.int64())})

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
