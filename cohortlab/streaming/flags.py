"""Symptom trend flags kept up to date on a stream, equal to the batch flags of the same log.

Entries wait in state until the watermark has passed them and are then taken in time order, so the order of arrival does not show. An entry that
arrives after the watermark is dropped by Spark and counted by the query's progress (``late_rows``). State per person and symptom is the waiting
entries and one row of facts; both go when the person has logged nothing for ``forget_days``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FACTS = ("first_seen long, last_seen long, n_entries long, baseline double, peak double, run long, longest_run long, "
         "longest_gap long, worsened boolean, stayed_high boolean, log_gap boolean")
OUTPUT = ("first_seen timestamp, last_seen timestamp, n_entries long, baseline_severity double, peak_severity double, longest_run long, "
          "longest_gap double, worsened boolean, stayed_high boolean, log_gap boolean, changed boolean, closed boolean")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1)


class TrendFlags(StatefulProcessor):
    """One row per person and symptom whenever entries were taken in: the facts, the flags, and whether a flag changed."""

    def __init__(self, key: list[str], tie: str, rise: float, high: float, n_high: int, gap_seconds: float, forget_days: int | None) -> None:
        self.names = [*key, *[c.split()[0] for c in OUTPUT.split(", ")]]
        self.entry = f"at long, tie {tie}, severity double"
        self.rise, self.high, self.n_high = rise, high, n_high
        self.gap = int(gap_seconds * 1_000_000)
        self.forget = None if forget_days is None else forget_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.entry)
        self.facts = handle.getValueState("facts", FACTS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["at"], r["tie"], r["severity"]) for r in rows]
        self.waiting.appendList(new)
        self._wake_at(min(new)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        entries = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in entries if e[0] <= now * 1000]
        facts = list(self.facts.get()) if self.facts.exists() else None
        if due:
            self.waiting.clear()
            if after := entries[len(due):]:
                self.waiting.put(after)
                self._wake_at(after[0][0] // 1000 + 1)
        flags = tuple(facts[-3:]) if facts else (False,) * 3
        for i, entry in enumerate(due):
            if facts and self._silent(facts, entry[0] // 1000):
                yield self._row(key, facts, False, True)
                facts, flags = None, (False,) * 3
            facts = self._taken(facts, entry)
            if i + 1 == len(due) or self._silent(facts, due[i + 1][0] // 1000):
                yield self._row(key, facts, tuple(facts[-3:]) != flags, False)
        if facts and self._silent(facts, now):
            self.facts.clear()
            yield self._row(key, facts, False, True)
        elif due:
            self.facts.update(tuple(facts))
            if self.forget is not None:
                self._wake_at(facts[1] // 1000 + self.forget + 2)

    def _silent(self, facts: list, ms: int) -> bool:
        """At this time the log counts as ended; every entry still to come is later."""
        return self.forget is not None and facts[1] // 1000 + self.forget < ms

    def close(self) -> None:
        pass

    def _wake_at(self, ms: int) -> None:
        self.handle.registerTimer(ms)

    def _taken(self, facts: list | None, entry: tuple[int, str, float]) -> list:
        """Facts after one more entry; entries come in time order. An empty severity counts as an entry that is not high."""
        at, _, severity = entry
        is_high = severity is not None and severity >= self.high
        if facts is None:
            first, last, n, baseline, peak, run, longest, gap = at, at, 0, severity, None, 0, 0, None
        else:
            first, last, n, baseline, peak, run, longest, gap = facts[:8]
            gap = max(gap or 0, at - last)
        run = run + 1 if is_high else 0
        peak = severity if peak is None else peak if severity is None else max(peak, severity)
        worsened = peak is not None and baseline is not None and peak - baseline >= self.rise
        return [first, at, n + 1, baseline, peak, run, max(longest, run), gap, worsened, max(longest, run) >= self.n_high, gap is not None and gap > self.gap]

    def _row(self, key, facts: list, changed: bool, closed: bool) -> Row:
        first, last, n, baseline, peak, _, longest, gap, *flags = facts
        time = lambda us: EPOCH + timedelta(microseconds=us)
        values = (*key, time(first), time(last), n, baseline, peak, longest, None if gap is None else gap / 1e6, *flags, changed, closed)
        return Row(**dict(zip(self.names, values, strict=True)))


@contextmanager
def rocksdb(spark: SparkSession):
    """State with timers needs this store; other queries of the session keep theirs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def trend_flags(entries: DataFrame, person: str, symptom: str, ts: str, tie: str, severity: str, rise: float, high: float, n_high: int,
                gap_seconds: float, delay: str = "1 hour", forget_days: int | None = None) -> DataFrame:
    """A stream of ``OUTPUT`` rows with person and symptom; ``flags_now`` keeps the newest of each.

    Entries later than ``delay`` behind the newest one are dropped. With ``forget_days`` the state of a silent person goes (a last row is
    ``closed``), and a later entry starts anew. Rows without a time are left out.
    """
    key = [person, symptom]
    rows = entries.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        *key, F.col(ts), F.unix_micros(F.col(ts)).alias("at"), F.col(tie).alias("tie"), F.col(severity).cast("double").alias("severity"))
    kinds = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in key)
    return rows.groupBy(*key).transformWithState(
        statefulProcessor=TrendFlags(key, entries.schema[tie].dataType.simpleString(), rise, high, n_high, gap_seconds, forget_days), outputStructType=f"{kinds}, {OUTPUT}", outputMode="Append", timeMode="EventTime")


def run(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Process everything available now, append it to a Parquet folder, and return how many entries came too late."""
    with rocksdb(stream.sparkSession):
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def flags_now(updates: DataFrame, person: str, symptom: str) -> DataFrame:
    """The newest row of each person and symptom."""
    values = F.struct("n_entries", *[c for c in updates.columns if c not in (person, symptom, "n_entries")])
    return updates.groupBy(person, symptom).agg(F.max_by(values, F.struct("last_seen", "n_entries", "closed")).alias("now")).select(person, symptom, "now.*")
