"""Line dedup that can be taken back: sharded cuckoo filters in front of exact reference counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm import arrow
from cohortlab.session import materialize

#: Line postings of a shard, and of a salted part of a shard, that one task holds.
SHARD_ROWS = 100_000
#: Shards at most, so that the table of shard sizes stays below 16 MB; beyond it a shard gets more keys.
MAX_SHARDS = 1 << 20
SLOTS, KICKS = 4, 200

POSTING = "k1 long, k2 long, doc_id long, mark long, line int, first boolean"


class CuckooFilter:
    """Set of 64-bit keys as 16-bit fingerprints in two possible buckets of four, with deletion.

    Bulk operations work on arrays. ``contains`` is never False for a key that was put in
    and not taken out; equal keys are counted by the table behind, not here.
    """

    def __init__(self, capacity: int) -> None:
        size = 1
        while size * SLOTS * 0.85 < capacity:
            size *= 2
        self.table = np.zeros((size, SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = arrow.mix(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (arrow.mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Put in distinct keys that are not yet there.

        All keys try the free places of their first bucket at once, then those of their second; the few
        that find none push others on, one by one.
        """
        mark, one, two = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (one, two):
            order = left[np.argsort(bucket[left], kind="stable")]
            b = bucket[order]
            turn = np.arange(len(b)) - np.searchsorted(b, b)  # which of the keys of its bucket it is
            free = np.cumsum(self.table[b] == 0, axis=1)
            fits = turn < free[:, -1]
            slot = np.argmax(free == (turn + 1)[:, None], axis=1)
            self.table[b[fits], slot[fits]] = mark[order[fits]]
            left = np.sort(order[~fits])
        for m, b in zip(mark[left].tolist(), one[left].tolist(), strict=True):
            if not self._put(m, b):
                raise OverflowError("the filter is full; build it with a larger capacity")

    def _put(self, mark: int, bucket: int) -> bool:
        for kick in range(KICKS):
            other = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
            for b in (bucket, other):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = mark
                    return True
            slot = kick % SLOTS
            mark, self.table[other, slot] = int(self.table[other, slot]), mark
            bucket = other
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were put in."""
        mark, one, two = self._places(keys)
        for m, *buckets in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            for b in buckets:
                held = np.flatnonzero(self.table[b] == m)
                if len(held):
                    self.table[b, held[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(len(keys), 1)
        while True:
            made = cls(capacity)
            try:
                made.insert(keys)
                return made
            except OverflowError:
                capacity *= 2


def _postings(batch: pa.RecordBatch, min_chars: int) -> pa.RecordBatch:
    doc, mark = batch.column("doc_id"), batch.column("mark")
    out = []
    for row, _, data, starts in arrow.chunks(batch.column("text")):
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(starts, breaks, "right") - 1
        begin = np.sort(np.r_[starts[:-1], breaks + 1], kind="stable")
        end = np.sort(np.r_[starts[1:], breaks], kind="stable")
        of = np.sort(np.r_[np.arange(len(starts) - 1), owner], kind="stable")
        line = np.arange(len(begin)) - np.searchsorted(of, of)
        word, word_end, _ = arrow.words(data, starts)
        head, past = np.searchsorted(word, begin), np.searchsorted(word, end)
        some = past > head
        begin, end, of, line = word[head[some]], word_end[past[some] - 1], of[some], line[some]
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        long = points[end] - points[begin] >= min_chars
        begin, end, of, line = begin[long], end[long], of[long], line[long]
        k1, k2 = (h.slices(h.sums(data), begin, end).view(np.int64) for h in (arrow.FIRST, arrow.SECOND))
        order = np.lexsort((k2, k1, of))
        same = (of[order][1:] == of[order][:-1]) & (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
        first = np.ones(len(of), bool)
        first[order[1:][same]] = False
        out.append(pa.record_batch([pa.array(k1), pa.array(k2), doc.take(pa.array(of + row)), mark.take(pa.array(of + row)), pa.array(line.astype(np.int32)), pa.array(first)],
                                   names=["k1", "k2", "doc_id", "mark", "line", "first"]))
    return arrow.joined(out)


def text_mark() -> Column:
    return F.xxhash64("text")


def postings(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: its key, document and place.

    Keys are 128-bit hashes of the line without white space at its ends and with A-Z as a-z.
    ``first`` marks a key's first line in its document. A document is a row, named by its
    ``doc_id`` and the hash of its text; equal rows count as documents of their own.
    """
    rows = docs.select("doc_id", text_mark().alias("mark"), "text")
    return arrow.map_batches(rows, lambda batch: _postings(batch, min_chars), POSTING)


@dataclass(frozen=True)
class State:
    """Lines of the documents that are in, and one row per shard: its exact table of all keys and a filter of those that repeat.

    ``postings`` and ``shards`` are written down. A shard's ``version`` says how often it has changed.
    """

    postings: DataFrame
    shards: DataFrame
    n_shards: int
    min_docs: int


KEYS = np.dtype([("k1", np.int64), ("k2", np.int64)])
SHARD = "shard long, version long, n long, filter binary, k1 binary, k2 binary, n_docs binary, keeper binary, unkept binary"


class Shard:
    """Sorted keys with the number of documents that hold them and the largest doc_id of these, and the filter in front."""

    def __init__(self, row: dict | None) -> None:
        self.version = row["version"] if row else 0
        take = lambda c, t: np.frombuffer(row[c], t).copy() if row else np.empty(0, t)
        self.k1, self.k2, self.n_docs, self.keeper, self.unkept = take("k1", np.int64), take("k2", np.int64), take("n_docs", np.int64), take("keeper", np.int64), take("unkept", bool)
        self.filter = CuckooFilter(1)
        if row:
            self.filter.table = np.frombuffer(row["filter"], np.uint16).reshape(-1, SLOTS).copy()

    def place(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there at all."""
        if not len(self.k1):
            return np.zeros(len(k1), np.int64), np.zeros(len(k1), bool)
        # Keys are sorted by (k1, k2); k1 alone nearly always decides, equal ones are walked.
        at = np.minimum(np.searchsorted(self.k1, k1), len(self.k1) - 1)
        while (behind := (self.k1[at] == k1) & (self.k2[at] < k2) & (at < len(self.k1) - 1)).any():
            at = at + behind
        return at, (self.k1[at] == k1) & (self.k2[at] == k2)

    def change(self, k1, k2, delta, keeper, unkept, sets_keeper, min_docs: int) -> None:
        """Add ``delta`` documents to each (distinct) key. A key enters the filter when its count reaches ``min_docs`` and leaves it below.

        ``sets_keeper``: the given keeper stands, whatever was there; else the larger one does.
        """
        at, known = self.place(k1, k2)
        new = np.flatnonzero(~known & (delta > 0))
        if len(new):
            put = lambda old, more: np.concatenate([old, more])
            self.k1, self.k2 = put(self.k1, k1[new]), put(self.k2, k2[new])
            self.n_docs, self.keeper, self.unkept = put(self.n_docs, np.zeros(len(new), np.int64)), put(self.keeper, np.zeros(len(new), np.int64)), put(self.unkept, np.ones(len(new), bool))
            order = np.lexsort((self.k2, self.k1))
            self.k1, self.k2, self.n_docs, self.keeper, self.unkept = (x[order] for x in (self.k1, self.k2, self.n_docs, self.keeper, self.unkept))
            at, known = self.place(k1, k2)
        at, delta, keeper, unkept, sets_keeper = at[known], delta[known], keeper[known], unkept[known], sets_keeper[known]
        before = self.n_docs[at]
        self.n_docs[at] = after = np.maximum(0, before + delta)
        larger = sets_keeper | (~unkept & (self.unkept[at] | (keeper > self.keeper[at])))
        self.keeper[at[larger]], self.unkept[at[larger]] = keeper[larger], unkept[larger]
        marks = self.k1 ^ self.k2
        enters, leaves = at[(before < min_docs) & (after >= min_docs)], at[(before >= min_docs) & (after < min_docs)]
        self.filter.delete(marks[leaves])
        try:
            if len(self.filter.table) * SLOTS * 0.85 < np.count_nonzero(self.filter.table) + len(enters):
                raise OverflowError
            self.filter.insert(marks[enters])
        except OverflowError:  # a filter that is full is laid out anew, larger
            self.filter = CuckooFilter.of(marks[self.n_docs >= min_docs])
        held = self.n_docs > 0
        if not held.all():
            self.k1, self.k2, self.n_docs, self.keeper, self.unkept = (x[held] for x in (self.k1, self.k2, self.n_docs, self.keeper, self.unkept))
        self.version += 1

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "version": [self.version], "n": [len(self.k1)], "filter": [self.filter.table.tobytes()], "k1": [self.k1.tobytes()], "k2": [self.k2.tobytes()],
                             "n_docs": [self.n_docs.tobytes()], "keeper": [self.keeper.tobytes()], "unkept": [self.unkept.tobytes()]})


def _changed(shards: DataFrame | None, deltas: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """The shards that ``deltas`` (k1, k2, delta, keeper, sets_keeper; one row a key) touch, changed."""
    spark = deltas.sparkSession
    arrow.prepare(spark)
    keyed = deltas.select(_shard(n_shards).alias("shard"), "*")
    old = spark.createDataFrame([], SHARD) if shards is None else shards

    def apply(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        now = Shard(old.iloc[0].to_dict() if len(old) else None)
        unkept = new["keeper"].isna().to_numpy()
        now.change(new["k1"].to_numpy(np.int64), new["k2"].to_numpy(np.int64), new["delta"].to_numpy(np.int64), new["keeper"].fillna(0).to_numpy(np.int64), unkept,
                   new["sets_keeper"].to_numpy(bool), min_docs)
        return now.row(key[0])

    return old.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(apply, SHARD)


def _moved(state: State, deltas: DataFrame, postings: DataFrame) -> State:
    """The state with some shards changed; the others are carried over as they are and not looked into."""
    deltas = materialize(deltas)
    touched = deltas.select(_shard(state.n_shards).alias("shard")).distinct()
    changed = _changed(state.shards.join(touched, "shard", "left_semi"), deltas, state.n_shards, state.min_docs)
    rest = state.shards.join(touched, "shard", "left_anti")
    return State(postings, materialize(rest.select(*changed.columns).unionByName(changed)), state.n_shards, state.min_docs)


def references(postings: DataFrame) -> DataFrame:
    """Documents that hold each key, and the largest doc_id of them."""
    return postings.filter("first").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("delta"), F.max("doc_id").alias("keeper"))


def insert(state: State | None, docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> State:
    """The state with new documents: only the shards of their lines change. The first call makes it, with shards for about ``SHARD_ROWS`` lines each."""
    new = materialize(postings(docs, min_chars))
    counts = references(new).withColumn("sets_keeper", F.lit(False))
    if state is None:
        n_shards = min(MAX_SHARDS, new.count() // SHARD_ROWS + 8)
        return State(new, materialize(_changed(None, counts, n_shards, min_docs)), n_shards, min_docs)
    return _moved(state, counts, materialize(state.postings.unionByName(new)))


def delete(state: State, gone: DataFrame) -> State:
    """The state without the documents in ``gone`` (doc_id; a null one takes back those without a doc_id): counts fall in the shards of their lines only.

    Where the largest doc_id of a key goes, the largest of what is left takes its place.
    """
    ids = gone.select(F.col("doc_id").alias("_gone")).distinct()
    lost = materialize(state.postings.join(ids, state.postings["doc_id"].eqNullSafe(ids["_gone"]), "left_semi"))
    left = materialize(state.postings.join(ids, state.postings["doc_id"].eqNullSafe(ids["_gone"]), "left_anti"))
    fallen = references(lost).select("k1", "k2", (-F.col("delta")).alias("delta"))
    keepers = references(left.join(fallen.select("k1", "k2"), ["k1", "k2"], "left_semi")).select("k1", "k2", "keeper")
    return _moved(state, fallen.join(keepers, ["k1", "k2"], "left").withColumn("sets_keeper", F.lit(True)), left)


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards))


def _probe(lines: pd.DataFrame, state: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    if not len(state) or not len(lines):
        return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "mark": pd.Series(dtype="int64"), "line": pd.Series(dtype="int32")})
    held = Shard(state.iloc[0].to_dict())
    lines = lines[held.filter.contains(lines["k1"].to_numpy(np.int64) ^ lines["k2"].to_numpy(np.int64))]
    at, found = held.place(lines["k1"].to_numpy(np.int64), lines["k2"].to_numpy(np.int64))
    if not len(held.k1):
        return lines.loc[found, ["doc_id", "mark", "line"]].astype({"doc_id": "Int64"})
    doc = lines["doc_id"]
    keeps = np.where(held.unkept[at], doc.isna(), ~doc.isna() & (doc.fillna(0).to_numpy(np.int64) == held.keeper[at]))
    return lines.loc[found & (held.n_docs[at] >= min_docs) & ~keeps, ["doc_id", "mark", "line"]].astype({"doc_id": "Int64"})


def dropped(state: State) -> DataFrame:
    """doc_id, mark and line of every line that goes.

    Lines meet their shard's filter first and the exact table only behind it. A shard is cut
    into salted parts of about ``SHARD_ROWS`` lines, each with a copy of the shard's state, so a
    line that a third of all documents hold is spread over many tasks.
    """
    n, min_docs = state.n_shards, state.min_docs
    sizes = state.postings.groupBy(_shard(n).alias("shard")).agg((F.count(F.lit(1)) / SHARD_ROWS).cast("long").alias("more"))
    parts = state.shards.join(sizes, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "more")))
    salted = (state.postings.withColumn("shard", _shard(n)).join(F.broadcast(sizes), "shard")
              .withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "line"), F.col("more") + 1)).drop("more", "first"))
    return salted.groupBy("shard", "salt").cogroup(parts.groupBy("shard", "salt")).applyInPandas(
        lambda lines, held: _probe(lines, held, min_docs), "doc_id long, mark long, line int")


def rebuild(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents with ``n_lines``, ``n_dropped`` and the ``kept`` text; a null text is one empty line."""
    lists = gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line")).alias("_gone"))
    lists = lists.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "_gone")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    docs = docs.drop("n_lines", "n_dropped", "kept", "_doc", "_mark", "_gone")
    return (docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_mark() == F.col("_mark")), "left")
            .withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
            .withColumn("kept", F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
            .drop("_doc", "_mark", "_gone"))


def dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Lines found in ``min_docs`` documents stay only in the largest doc_id that holds them.

    ``docs`` needs doc_id and text; other columns pass (those called n_lines, n_dropped or kept are
    replaced). Null and empty texts are one empty line. A null doc_id is smaller than any other.
    Equal rows count as documents of their own and share their fate. No rows give no rows.
    """
    return rebuild(docs, dropped(insert(None, docs, min_chars, min_docs)))
