"""Near-duplicate documents: fast similarity sketches, banding, exact verification on full shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm import arrow
from cohortlab.llm.components import components
from cohortlab.session import materialize

#: Bands, and sketch coordinates in each: a pair of similarity 0.8 meets in some band but for 3 in a million.
BANDS, ROWS = 42, 6
#: Documents of a block, and shingles of all of them; a task compares two blocks at most.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
CHUNK = 1 << 21
#: Parts of a class of equal sets when its rows are told their component.
SALTS = 1024

STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every distinct shingle, sorted by row and hash.

    Words are runs of bytes other than white space, A-Z as a-z. A row of fewer words has the whole
    sequence as its one shingle, a row without words none.
    """
    start, end, rows = arrow.words(data, starts)
    word = arrow.FIRST.slices(arrow.FIRST.sums(data), start, end)
    counts = np.diff(rows)
    of = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(rows[1:], counts) - np.arange(len(of))  # words from here to the row's end
    heads = np.flatnonzero((left >= size) | (np.arange(len(of)) == np.repeat(rows[:-1], counts)) & (np.repeat(counts, counts) < size))
    out = np.zeros(len(heads), np.uint64)
    for k in range(size):
        more = left[heads] > k
        nxt = np.where(more, word[np.minimum(heads + k, max(len(word) - 1, 0))], np.uint64(k + 1)) if len(word) else out
        out = arrow.mix(out * STEP + nxt)
    of = of[heads]
    order = np.lexsort((out, of))
    of, out = of[order], out[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (out[1:] != out[:-1])
    return of[keep], out[keep]


def sketches(of: np.ndarray, hashes: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """Fast similarity sketches: one row of ``size`` coordinates for each document; all ones where it has no shingle.

    Round i < size throws every shingle into a random bin with a value that only the round and the shingle
    determine; the next ``size`` rounds throw all of them into one bin each, so every bin fills. A bin
    keeps the least value of the first round that reached it, and full documents leave.
    """
    out = np.full((n_rows, size), np.uint64(2**64 - 1))
    empty = np.ones((n_rows, size), bool)
    wanting = np.bincount(of, minlength=n_rows) > 0
    flat, free = out.reshape(-1), empty.reshape(-1)
    for turn in range(2 * size):
        live = wanting[of]
        if not live.all():
            of, hashes = of[live], hashes[live]
        if not len(of):
            break
        value = arrow.mix(hashes + np.uint64((turn + 1) * int(STEP) % 2**64))
        bins = (value % np.uint64(size)).astype(np.int64) if turn < size else turn - size
        at = of * size + bins
        new = free[at]
        at, value = at[new], value[new]
        np.minimum.at(flat, at, value)
        free[at] = False
        wanting = empty.any(1) & wanting
    return out


def _sketched(batch: pa.RecordBatch, size: int, bands: int, rows: int) -> pa.RecordBatch:
    counts, marks, keys = [], [], []
    for row, stop, data, starts in arrow.chunks(batch.column("text"), CHUNK):
        n = stop - row
        of, hashes = shingles(data, starts, size)
        counts.append(np.bincount(of, minlength=n))
        cuts = np.searchsorted(of, np.arange(n + 1))
        sums = [np.r_[np.uint64(0), np.cumsum(arrow.mix(hashes + np.uint64(seed)))] for seed in (0x1234567, 0x89ABCDE)]
        marks.append(np.stack([t[cuts[1:]] - t[cuts[:-1]] for t in sums]))
        sketch = sketches(of, hashes, n, bands * rows).reshape(n, bands, rows)
        key = np.broadcast_to(arrow.mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)), (n, bands)).copy()
        for r in range(rows):
            key = arrow.mix(key * STEP + sketch[:, :, r])
        keys.append(key)
    mark = np.concatenate(marks, axis=1).view(np.int64)
    key = np.concatenate(keys).view(np.int64)
    return pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(np.concatenate(counts), pa.int64()), "m1": pa.array(mark[0]), "m2": pa.array(mark[1]),
                            "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1)))})


def _sets(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    out = []
    for row, stop, data, starts in arrow.chunks(batch.column("text"), CHUNK):
        of, hashes = shingles(data, starts, size)
        cuts = np.searchsorted(of, np.arange(stop - row + 1))
        out += [hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.record_batch({"id": batch.column("id"), "pivots": batch.column("pivots"), "shingles": pa.array(out, pa.binary())})


def similar(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (larger id, smaller id) that join all documents which pairs of ``percent`` similarity join.

    All documents meet the first one. Each that it does not link meets all others by an inverted
    list of shingles; between documents already joined no further link is given.
    """
    n = len(ids)
    lengths = np.array([len(s) for s in sets])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.r_[0, np.cumsum(lengths)]
    posting = np.repeat(np.arange(n), lengths)[np.argsort(place, kind="stable")]
    at = np.r_[0, np.cumsum(np.bincount(place, minlength=len(values)))]
    out = []
    for i in range(n):
        if i and root(i) == root(0):
            continue
        mine = place[cuts[i] : cuts[i + 1]]
        begin, size = at[mine], at[mine + 1] - at[mine]
        met = posting[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        common = np.bincount(met, minlength=n)
        for j in np.flatnonzero(100 * common >= percent * (lengths[i] + lengths - common)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    return out


def _cell(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    rows = rows.sort_values(["role", "id"])
    links = similar(rows["id"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in rows["shingles"]], percent)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit mark and its band keys for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(arrow.map_batches(rows, lambda b: _sketched(b, size, BANDS, ROWS), "doc_id long, n_shingles long, m1 long, m2 long, bands array<long>"))


def candidates(classes: DataFrame) -> DataFrame:
    """id, n_shingles and ``pivot`` for documents (doc_id, n_shingles, bands) that share a band: each meets the pivot of each of its bands.

    A band's pivot is its member that meets most documents over all its bands (ties: the smallest id),
    so documents of one group mostly share one pivot, and a document has few. Two documents that
    share a band have its pivot in common.
    """
    keyed = classes.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(keyed.join(shared, "band").groupBy("doc_id").agg(F.sum("n").alias("met"), F.max("n_shingles").alias("n_shingles"), F.collect_list("band").alias("bands")))
    rows = met.select("doc_id", "met", "n_shingles", F.explode("bands").alias("band"))
    best = rows.groupBy("band").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("i"))).alias("p")).select("band", (-F.col("p.i")).alias("pivot"))
    return rows.join(best, "band").select(F.col("doc_id").alias("id"), "n_shingles", "pivot").distinct()


def _star(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Which documents of a block the pivot (role 0) links at once."""
    rows = rows.sort_values(["role", "id"])
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    lengths = np.array([len(s) for s in sets])
    common = np.bincount(np.repeat(np.arange(len(sets)), lengths), np.isin(np.concatenate(sets), sets[0]), len(sets)).astype(np.int64)
    linked = 100 * common >= percent * (lengths[0] + lengths - common)
    return pd.DataFrame({"id": rows["id"], "pivot": rows["pivot"], "linked": linked})[1:]


def _meet(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between documents that their pivot did not link (``asks``) and the documents of a block."""
    asks, block = rows[rows["asks"]], rows[~rows["asks"]]
    if not len(asks) or not len(block):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    ids, lengths = block["id"].to_numpy(np.int64), np.array([len(s) // 8 for s in block["shingles"]])
    values, place = np.unique(np.frombuffer(b"".join(block["shingles"]), np.uint64), return_inverse=True)
    posting = np.repeat(np.arange(len(ids)), lengths)[np.argsort(place, kind="stable")]
    at = np.r_[0, np.cumsum(np.bincount(place, minlength=len(values)))]
    out = []
    for i, s in zip(asks["id"].tolist(), asks["shingles"], strict=True):
        mine = np.frombuffer(s, np.uint64)
        where = np.minimum(np.searchsorted(values, mine), len(values) - 1)
        where = where[values[where] == mine]
        begin, size = at[where], at[where + 1] - at[where]
        met = posting[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        common = np.bincount(met, minlength=len(ids))
        hit = (100 * common >= percent * (len(mine) + lengths - common)) & (ids != i)
        out += [(max(i, j), min(i, j)) for j in ids[hit].tolist()]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _drawn(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """id, pivot, blocks and shingles for (id, pivot, blocks), written down: full sets are drawn once a document, from its whole text."""
    pivots = pairs.groupBy("id").agg(F.collect_list(F.struct("pivot", "blocks")).alias("pivots"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(pivots.hint("merge"), "id")  # one plan at every size
    held = arrow.map_batches(texts.select("id", "pivots", "text"), lambda b: _sets(b, size), "id long, pivots array<struct<pivot: long, blocks: int>>, shingles binary")
    return materialize(held).select("id", "shingles", F.explode("pivots").alias("p")).select("id", "shingles", "p.*")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) that join what pairs of ``percent`` similarity within a pivot's neighbourhood join.

    A neighbourhood of up to ``BLOCK_ROWS`` documents and ``BLOCK_SHINGLES`` shingles meets in one task. A larger one is cut into blocks of
    that size. First each block meets the pivot alone, which links nearly all near copies; then the documents that it did not
    link, in blocks of their own, meet every block. No pair is left out, no task grows with a neighbourhood, and a document that the pivot
    links is sent on only to the blocks of those that it does not.
    """
    pairs = materialize(candidates(classes))
    blocks_of = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sized = materialize(pairs.join(pairs.groupBy("pivot").agg(blocks_of().alias("blocks")), "pivot"))
    drawn = _drawn(docs, sized, size)
    small = drawn.filter("blocks = 1").withColumn("role", (F.col("id") != F.col("pivot")).cast("int"))
    found = small.groupBy("pivot").applyInPandas(lambda rows: _cell(rows, percent), "a long, b long")
    if sized.filter("blocks > 1").isEmpty():
        return found
    large = drawn.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    star = large.select("id", "pivot", "shingles", (F.col("id") != F.col("pivot")).cast("int").alias("role"), F.explode(cells).alias("cell"))
    star = materialize(star.groupBy("pivot", "cell").applyInPandas(lambda rows: _star(rows, percent), "id long, pivot long, linked boolean"))
    apart = star.filter("NOT linked").select("id", "pivot")
    counts = sized.join(apart, ["id", "pivot"]).groupBy("pivot").agg(blocks_of().alias("own"), F.max("blocks").alias("blocks"))
    counts = counts.select("pivot", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))  # no hot key
    rows = large.filter("id <> pivot").join(counts, ["pivot", "block"]).join(apart.withColumn("asks", F.lit(True)), ["id", "pivot"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    held = rows.select("pivot", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("block").alias("j"), "id", "shingles", F.lit(False).alias("asks"))
    asking = rows.filter("asks").select("pivot", F.pmod(F.xxhash64("id", F.lit(1)), F.col("own")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "id", "shingles", "asks")
    met = held.unionByName(asking).groupBy("pivot", "i", "j").applyInPandas(lambda rows: _meet(rows, percent), "a long, b long")
    linked = star.filter("linked").select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b"))
    return found.unionByName(linked).unionByName(met)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id and text; other columns are left out).

    Documents with 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles are linked;
    component_id is the smallest doc_id reachable, and that one is kept. Equal sets are one class
    from the start, so copies are never paired. Null, empty and blank texts have no shingles and are
    linked with nothing. Rows with a null doc_id are linked with nothing, have a null component_id
    and are kept. Rows with one doc_id stand for one document; links of any of its texts are its own.
    """
    rows = sketched(docs, size)
    set_ = ["n_shingles", "m1", "m2"]
    named = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A set that very many documents share is no hot key: its rows meet the class by (set, salt).
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    partial = materialize(salted.groupBy(*set_, "salt").agg(F.min("doc_id").alias("least")))
    classes = partial.groupBy(*set_).agg(F.min("least").alias("rep"))
    chosen = named.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *set_], "left_semi")
    joined = components(links(docs, chosen.select("doc_id", "n_shingles", "bands"), size, percent))
    classes = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(*set_, F.coalesce("component", "rep").alias("component_id"))
    back = partial.select(*set_, "salt").join(classes, set_)
    met = salted.join(back, [*set_, "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
