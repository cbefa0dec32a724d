"""Best-fit packing by bin completion over the histogram of lengths; a piece's place follows from its rank."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from cohortlab.llm import arrow
from cohortlab.llm.bpe import byte_letters, check_vocabulary
from cohortlab.session import materialize

# How the vocabulary's file normalizes and parts a text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Words, and lower-case words without marks, whose ids a worker remembers; beyond it all are forgotten.
MAX_WORDS, MAX_CORES = 250_000, 300_000
#: Bytes of text that are encoded at once; a longer text is encoded alone.
RUN = 1 << 21
#: Marks that are a token of their own after a letter.
MARKS = frozenset(".,;:!?")
IS_MARK = np.isin(np.arange(256), [ord(m) for m in MARKS])
LETTERS = {b: c for c, b in byte_letters().items()}
#: Rows of one (length, salt) group on average at most.
GROUP_ROWS = 1_000
#: Nodes of the search; the best packing found so far stands when they are used up.
MAX_NODES = 20_000
#: Steps that all nodes together look for fillings; they end the whole search like the nodes do, and no node for itself.
MAX_STEPS = 2_000_000
#: Nodes whose tables are kept; others build theirs again when the search comes back to them.
MAX_TABLES = 64

PIECE = "piece int, start long, length long, ids_crc32 long"


class Words:
    """Ids of texts, word by word: white space parts words, and the tokenizer never looks over it.

    The ids of all words seen lie one after the other in one array; a batch looks up its distinct words and gathers the rest.
    """

    kept: dict[str, Words] = {}

    def __init__(self, path: str) -> None:
        check_vocabulary(path, "normalizer", NORMALIZER)
        check_vocabulary(path, "pre_tokenizer", PRE_TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cores: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.empty(0, "<u4")
        self.starts = self.sizes = np.empty(0, np.int64)

    @classmethod
    def at(cls, path: str) -> Words:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _core(self, word: str) -> str | None:
        """The lower-case letters that one run of the merges turns into ids; None for a word that is not letters alone."""
        if word.isascii():
            return word.lower() if word.isalpha() or word in MARKS else None
        lower = word.lower()
        return lower if lower.isalpha() and "\u03a3" not in word and is_normalized("NFC", word) else None

    def _learn(self, words: list[str]) -> None:
        """Take in words that are new."""
        if len(self.cores) > MAX_CORES:
            self.cores.clear()
        run, cores, got, others = self.tokenizer.model.tokenize, self.cores, [], []
        for word in words:
            core = self._core(word)
            if core is None:
                others.append(len(got))
                got.append(b"")
                continue
            ids = cores.get(core)
            if ids is None:
                letters = core if core.isascii() else core.encode().decode("latin-1").translate(LETTERS)
                ids = cores[core] = pack_ids([t.id for t in run(letters)])
            got.append(ids)
        for at, e in zip(others, self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False), strict=True):
            got[at] = pack_ids(e.ids)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.slots.update(zip(words, range(len(self.slots), len(self.slots) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), "<u4")])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def encode(self, data: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts that start at ``rows`` in the bytes, each with ``end`` after it, and where each text starts in them."""
        start, stop, row = parted(data, rows)
        slices = pa.Array.from_buffers(pa.large_string(), 2 * len(start), [None, pa.py_buffer(np.append(np.stack([start, stop], 1).ravel(), len(data))), pa.py_buffer(data)])
        coded = pc.dictionary_encode(slices.take(pa.array(np.arange(0, 2 * len(start), 2))))
        distinct = coded.dictionary.to_pylist()
        if len(self.slots) > MAX_WORDS:
            self._forget()
        new = [w for w in distinct if w not in self.slots]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[slot]
        before = np.concatenate([[0], np.cumsum(sizes)])
        texts = np.arange(len(rows))
        first = before[np.searchsorted(row, texts)] + texts  # each text before adds its end
        out = np.full(first[-1], end, "<u4")
        shift = np.repeat(self.starts[slot] - before[:-1], sizes)
        at = np.arange(before[-1])
        out[at + np.repeat(row, sizes)] = self.ids[at + shift]
        return out, first


def parted(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word in the bytes; a mark that ends a word after an ASCII letter or digit is a word of its own."""
    start, stop, before = arrow.words(data, rows)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(before))
    split = np.flatnonzero((stop - start > 1) & IS_MARK[data[stop - 1]] & ~arrow.NOT_ALNUM[data[stop - 2]] & (data[stop - 2] < 128)) if len(start) else start
    at = split + np.arange(1, len(split) + 1)  # where the marks come among the words
    out = [np.insert(start, split + 1, stop[split] - 1), np.insert(stop, split + 1, stop[split]), np.insert(row, split + 1, row[split])]
    out[1][at - 1] -= 1
    return out[0], out[1], out[2]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its ids, then ``end``; a null or empty text is that one id. Rows with equal or null
    doc_id are documents of their own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(ids: pa.Array, data: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        tokens, first = Words.at(path).encode(data, rows, end)
        held = np.diff(first)
        parts = -(-held // capacity)
        of = np.repeat(np.arange(len(held)), parts)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * capacity
        length = np.minimum(held[of] - start, capacity)
        whole, at = memoryview(tokens).cast("B"), (first[of] + start) * 4
        crc = [zlib.crc32(whole[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
        return pa.record_batch([ids.take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                               names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, rows in arrow.chunks(batch.column("text"), RUN):
                yield cut(batch.column("doc_id").slice(row, stop - row), data, rows)
        Words.kept.clear()  # a worker that goes on to other work holds no words
        pa.default_memory_pool().release_unused()

    arrow.prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECE}")


Bins = list[tuple[tuple[int, ...], int]]
"""Fillings (lengths, largest first) and how many sequences have each."""


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without: large pieces apart, the rest by volume, for the best split."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in sorted({n for n in counts if 2 * n <= capacity}):
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        shared = [(n, c) for n, c in counts.items() if capacity < 2 * n <= 2 * (capacity - k)]
        room = sum((capacity - n) * c for n, c in shared)
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        best = max(best, alone + sum(c for _, c in shared) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing, whole classes of equal pieces and equal sequences at once."""
    open_: dict[int, Counter] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in open_ if r >= n), default=capacity)
            held = open_.get(room)
            fill, bins = next(iter(held.items())) if held else ((), left)
            each = min(room // n, left)
            used = min(bins, left // each)
            left -= used * each
            if held:
                held[fill] -= used
                if not held[fill]:
                    del held[fill]
                if not held:
                    del open_[room]
            open_.setdefault(room - each * n, Counter())[fill + (n,) * each] += used
    return [(fill, c) for held in open_.values() for fill, c in held.items()]


class Used(Exception):
    """The search has used up its steps."""


def reached(sums: int, n: int, c: int) -> int:
    """Sums (as bits) with up to ``c`` more pieces of length ``n``."""
    k = 1
    while c > 0:
        sums |= sums << min(k, c) * n
        c, k = c - k, 2 * k
    return sums


def fillings(counts: dict[int, int], top: int, capacity: int, spare: Callable[[], int], step: Callable[[], None], tables: dict) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of the room beside a piece ``top``, those of least waste first, each found when it is asked for.

    A filling that leaves room for another piece is dominated, and so is one in which a larger unused
    piece, at most a part's sum plus the room left, could take the place of this part; a single
    piece that fits exactly dominates all others. ``counts`` may change between two fillings, but must be as
    it was when the next is asked for. ``tables`` holds what the latest callers need; theirs are built again if dropped.
    """
    room, key = capacity - top, object()
    number = lambda n: counts.get(n, 0) - (n == top)
    if number(room) > 0:
        yield (room,)
        return

    def lengths() -> list[tuple[int, int]]:
        return [(n, number(n)) for n in sorted(counts, reverse=True) if n <= room and number(n) > 0]

    def possible() -> list[int]:
        """Waste, from 1, that some filling leaves: all pieces not above it are used, the others sum to what is left."""
        has = lengths()
        sums, mask = [1], (2 << room) - 1
        for n, c in has:
            sums.append(reached(sums[-1], n, min(c, room // n)) & mask)
        out, above, forced = [], len(has), 0
        for w in range(1, room + 1):
            while above and has[above - 1][0] <= w:
                above -= 1
                forced += has[above][0] * has[above][1]
            if room - w < forced:
                break
            if sums[above] >> (room - w - forced) & 1:
                out.append(w)
        return out

    def table() -> tuple[list[tuple[int, int]], list[int]]:
        """Lengths above the waste, and the sums that those from each on reach."""
        if key not in tables:
            has, mask = [x for x in lengths() if x[0] > w], (2 << room) - 1
            sums = [1] * (len(has) + 1)
            for i in range(len(has) - 1, -1, -1):
                n, c = has[i]
                sums[i] = reached(sums[i + 1], n, min(c, room // n)) & mask
            tables[key] = has, sums
            if len(tables) > MAX_TABLES:
                del tables[next(iter(tables))]
        return tables[key]

    def pick(i: int, left: int) -> tuple[int, int, int, list[int]] | None:
        has, sums = table()
        while i < len(has) and sums[i] >> left & 1:
            n, c = has[i]
            times = [k for k in range(min(c, left // n), 0, -1) if sums[i + 1] >> (left - k * n) & 1]
            if times:
                return i, n, c, times
            i += 1
        return None

    def spread(unused: int) -> int:
        """Sums that are at most ``w`` below an unused length."""
        k = 0
        while k < w:
            more = min(k + 1, w - k)
            unused, k = unused | unused >> more, k + more
        return unused

    def grow(parts: int, n: int, k: int, unused: int, near: int) -> int | None:
        """Sums of parts with ``k`` pieces ``n``, which is not above the pieces so far; None if a part can be replaced."""
        if w and unused >> (n + 1) & ((1 << w) - 1):
            return None
        for _ in range(k):
            more = parts << n
            if more & near:
                return None
            parts |= more | 1 << n
        return parts

    def extend(i: int, left: int, chosen: tuple[int, ...], parts: int, unused: int, near: int) -> Iterator[tuple[int, ...]]:
        step()
        if not left:
            for n, c in forced:
                parts = grow(parts, n, c, unused, near)
                if parts is None:
                    return
            yield chosen + tuple(n for n, c in forced for _ in range(c))
            return
        while found := pick(i, left):
            i, n, c, times = found
            for k in times:
                step()
                grown = grow(parts, n, k, unused, near)
                if grown is not None:
                    rest = unused & ~(1 << n) if k == c else unused
                    yield from extend(i + 1, left - k * n, chosen + (n,) * k, grown, rest, spread(rest) if k == c else near)
                    if w > spare():
                        return
            i += 1

    def passes() -> Iterator[int]:
        yield 0
        yield from possible() if spare() > 0 else ()

    for w in passes():  # noqa: B007
        if w > spare():
            return
        tables.pop(key, None)
        forced = [x for x in lengths() if x[0] <= w]
        unused = sum(1 << n for n, _ in lengths() if n > w)
        yield from extend(0, room - w - sum(n * c for n, c in forced), (), 0, unused, spread(unused))


def search(counts: dict[int, int], capacity: int) -> tuple[Bins, int, bool]:
    """As few sequences as the search finds for pieces of these lengths, a lower bound, and whether none can be fewer.

    Best fit is the first incumbent. While it is above the bound, bin completion goes depth first:
    the largest piece left takes each undominated filling in turn, as often as pieces for it last and then once,
    and a branch ends when its waste leaves no room for a better packing; best fit of what is
    left makes new incumbents on the way. One copy of the counts is changed and changed back.
    The search ends by proof, at the bound or with nothing left to try, or when its nodes or steps are used up.
    """
    left = {n: c for n, c in counts.items() if c}
    bound, total = lower_bound(left, capacity), sum(n * c for n, c in left.items())
    best = best_fit(left, capacity)
    size = lambda bins: sum(c for _, c in bins)
    n_best, waste, path, nodes, steps, tables = size(best), 0, [], 0, 0, {}

    def step() -> None:
        nonlocal steps
        steps += 1
        if steps > MAX_STEPS:
            raise Used

    def branches() -> Iterator[tuple[tuple[int, ...], int]]:
        top, before = max(left), waste
        for f in fillings(left, top, capacity, lambda: (n_best - 1) * capacity - total - before, step, tables):
            fill = (top, *f)
            times = min(left[n] // c for n, c in Counter(fill).items())
            yield fill, times
            if times > 1:
                yield fill, 1

    def take(bin_: tuple[tuple[int, ...], int], sign: int) -> None:
        for n in bin_[0]:
            left[n] = left.get(n, 0) + sign * bin_[1]
            if not left[n]:
                del left[n]

    frames = [branches()] if left and n_best > bound else []
    try:
        while frames and n_best > bound and nodes < MAX_NODES:
            done = next(frames[-1], None)
            if done is None:
                frames.pop()
                if path:
                    take(path[-1], 1)
                    waste -= path[-1][1] * (capacity - sum(path[-1][0]))
                    path.pop()
                continue
            nodes += 1
            take(done, -1)
            path.append(done)
            waste += done[1] * (capacity - sum(done[0]))
            if len(left) < 40 or nodes % 16 == 0:
                tried = path + best_fit(left, capacity)
                if size(tried) < n_best:
                    best, n_best = list(tried), size(tried)
            hopeful = left and waste <= (n_best - 1) * capacity - total
            frames.append(branches() if hopeful else iter(()))
    except Used:
        return best, bound, n_best == bound
    return best, bound, n_best == bound or not frames


def pack(counts: dict[int, int], capacity: int) -> tuple[Bins, int]:
    """The packing that ``search`` finds, and the lower bound."""
    return search(counts, capacity)[:2]


def slots(bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks by length: where a run starts (length in the upper, rank in the lower 40 bits), its first sequence, its offset."""
    keys, first, offset, used, sequence = [], [], [], Counter(), 0
    for fill, times in bins:
        at = 0
        for n in fill:
            keys.append(n << 40 | used[n])
            first.append(sequence)
            offset.append(at)
            used[n] += times
            at += n
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, first, offset))


def placed(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """``rows`` (with ``length``, 1 to ``capacity``, and no column sequence_id or offset) with their sequence and place.

    The driver sees the histogram (at most ``capacity`` counts) and the fillings, whose number
    depends on the capacity, not on the rows. A row's rank among rows of its length comes
    from salted groups, so a length that a third of all rows have is no hot group.
    """
    spark = rows.sparkSession
    arrow.prepare(spark)
    rows = materialize(rows)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bins, _ = pack(counts, capacity)
    runs = spark.sparkContext.broadcast(slots(bins))
    salts = F.array(*[F.lit(counts.get(n, 0) // GROUP_ROWS + 1) for n in range(1, capacity + 1)])  # by length
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.element_at(salts, F.col("length").cast("int")).cast("bigint")))
    totals = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    bases = totals.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[c for c in rows.columns if c != "length"])))
    ranked = ranked.join(bases, ["length", "_salt"]).select(*rows.columns, (F.col("_base") + F.col("_row") - 1).alias("_rank"))

    names = rows.columns

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, first, offset = runs.value
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        at = np.searchsorted(keys, length << 40 | rank, "right") - 1
        sequence = first[at] + rank - (keys[at] & ((1 << 40) - 1))
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    return arrow.map_batches(ranked, place, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents (doc_id and text; other columns are left out) with sequence_id and offset."""
    return placed(pieces(docs, path, capacity), capacity)
