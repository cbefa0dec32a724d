"""Operators on documents against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortlab.llm import arrow, bpe, components, line_dedup, minhash, packing, quality, toxicity
from cohortlab.llm.catalog import QUERIES
from tests.llm.brute import check_packing, line_brute, plain_features

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, kept string, shard string, n_lines string, score string"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(40_000))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "same text here, five words"), (5, "same text here, five words"), (None, "no id"), (None, None), (6, "Ünï 中文 😀\x00 a\r\nb")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z", "s") for i, t in ROWS], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def F_text(column):
    from pyspark.sql import functions as F
    return F.concat(F.lit("text "), column).alias("text")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


# Line dedup.

def test_line_dedup_matches_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice(["Übel", "one", "TWO", "three", "vier"]) for _ in range(r.randint(1, 9))) for _ in range(25)]
    rows = [(i, None if i % 31 == 0 else "\n".join(r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.2 and x.isascii() else x) + r.choice(["", " \r"])
                                                      for x in r.choices(pool, k=r.randint(0, 8)))) for i in range(200)]
    got = rows_of(line_dedup.dedup(docs(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept")
    assert sorted(got) == line_brute(rows)


def test_line_dedup_is_reversible(spark):
    line = "a line of more than twenty characters"
    base = docs(spark, [(i, f"{line}\nown line number {i} is long") for i in range(4)])
    more = docs(spark, [(9, line)])
    state = line_dedup.insert(None, base)
    grown = line_dedup.insert(state, more)
    assert rows_of(line_dedup.dropped(grown), "doc_id", "line") == [(i, 0) for i in range(4)]
    back = line_dedup.delete(grown, more)
    assert rows_of(line_dedup.dropped(back), "doc_id", "line") == rows_of(line_dedup.dropped(state), "doc_id", "line") == [(i, 0) for i in range(3)]
    fewer = line_dedup.delete(back, docs(spark, [(0, ""), (1, "")]))
    assert rows_of(line_dedup.dropped(fewer), "doc_id", "line") == []


def shard_rows(state):
    return {r["shard"]: r.asDict() for r in state.shards.collect()}


def sound_shards(state):
    """Exact tables equal a count over the postings, and filters hold what repeats."""
    want = {(r["k1"], r["k2"]): (r["delta"], r["keeper"]) for r in line_dedup.references(state.postings).collect()}
    got, marks = {}, 0
    for row in shard_rows(state).values():
        held = line_dedup.Shard(row)
        often = held.n_docs >= state.min_docs
        assert held.filter.contains((held.k1 ^ held.k2)[often]).all()
        marks += np.count_nonzero(held.filter.table) - often.sum()
        got |= {(a, b): (n, None if u else k) for a, b, n, k, u in zip(held.k1.tolist(), held.k2.tolist(), held.n_docs.tolist(), held.keeper.tolist(), held.unkept.tolist())}
    assert got == want and marks == 0


def test_only_shards_of_changed_lines_change(spark, monkeypatch):
    r = random.Random(6)
    pool = [f"a line that is long enough, number {i}" for i in range(300)]
    rows = [(None if i % 50 == 49 else i, "\n".join(r.choices(pool, k=6))) for i in range(300)]
    monkeypatch.setattr(line_dedup, "SHARD_ROWS", 20)
    first = line_dedup.insert(None, docs(spark, rows[:200]))
    assert first.n_shards > 50
    state = line_dedup.insert(first, docs(spark, rows[200:]))
    sound_shards(state)
    # one document goes: its lines' shards have a new version, all others are as they were
    one = rows[205][0]
    lost = {x["shard"] for x in state.postings.filter(f"doc_id = {one}").select(line_dedup._shard(state.n_shards).alias("shard")).collect()}
    fewer = line_dedup.delete(state, docs(spark, [(one, "")]))
    before, after = shard_rows(state), shard_rows(fewer)
    assert 0 < len(lost) <= 6 and {s for s in after if after[s]["version"] != before[s]["version"]} == lost
    assert all(after[s] == before[s] for s in after if s not in lost)
    sound_shards(fewer)
    # those without a doc_id go too, then everything is as if it had never been there
    less = line_dedup.delete(fewer, docs(spark, [(None, "")]))
    sound_shards(less)
    built = line_dedup.insert(None, docs(spark, [x for x in rows if x[0] not in (one, None)]))
    assert rows_of(line_dedup.dropped(less), "doc_id", "line") == rows_of(line_dedup.dropped(built), "doc_id", "line") != []


def test_cuckoo_filter_pushes_keys_on():
    keys = np.unique(np.random.default_rng(4).integers(-2**63, 2**63 - 1, 8192))
    held = line_dedup.CuckooFilter(7800)
    held.insert(keys[:7800])  # nearly full: some keys have to move
    assert held.contains(keys[:7800]).all() and np.count_nonzero(held.table) == 7800
    with pytest.raises(OverflowError):
        line_dedup.CuckooFilter(1).insert(keys[:100])


def test_line_dedup_splits_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_ROWS", 7)
    rows = [(i, f"this line stands in every document\nline {i // 2} is held by two of them") for i in range(60)]
    assert sorted(rows_of(line_dedup.dedup(docs(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept")) == line_brute(rows)


def test_line_dedup_edge_cases(spark, odd, none):
    got = line_dedup.dedup(odd)
    assert got.count() == len(ROWS) and {r["n_lines"] for r in got.filter("text IS NULL OR text = ''").collect()} == {1}
    assert line_dedup.dedup(none).count() == 0
    ids = docs(spark, [(None, "a line that is held by three rows"), (None, "a line that is held by three rows"), (2, "a line that is held by three rows")])
    assert rows_of(line_dedup.dedup(ids), "doc_id", "n_dropped") == [(2, 0), (None, 1), (None, 1)]


def test_cuckoo_filter_inserts_and_deletes():
    keys = np.unique(np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000))
    held = line_dedup.CuckooFilter.of(keys)
    assert held.contains(keys).all()
    other = np.setdiff1d(np.random.default_rng(2).integers(-2**63, 2**63 - 1, 20000), keys)
    assert held.contains(other).mean() < 0.001
    held.delete(keys[:2500])
    assert held.contains(keys[2500:]).all() and held.contains(keys[:2500]).mean() < 0.01


# Quality rules.

def test_quality_short_circuits_and_keeps_clean_text(spark, odd, none):
    clean = " ".join(f"Plain{i} words" for i in range(60)) + "."
    rows = [(1, clean), (2, clean.upper()), (3, " ".join(f"letters{chr(97 + i % 26)}{chr(97 + i // 26)}#" for i in range(80))), (4, "short text"), (5, "one two three four " * 30), (6, None)]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, rows)).collect()}
    assert got[1]["kept"] and [got[i]["rejected_by"] for i in (2, 3, 4, 5, 6)] == ["capitals", "symbols", "base", "base", "base"]
    assert got[5]["n_repeat_words"] == 120 and got[6]["n_words"] == 0
    assert quality.judge(odd).count() == len(ROWS) and quality.judge(none).count() == 0


def test_quality_order_follows_rejection_per_cost(spark):
    from pyspark.sql import functions as F
    sample = spark.range(200).select(F.concat(F.lit("w "), "id").alias("text"), (F.col("id") < 150).alias("much"), (F.col("id") < 2).alias("little"))
    order = quality.ordered(sample, [quality.Rule("little", F.col("little")), quality.Rule("much", F.col("much")), quality.Rule("never", F.lit(False))])
    assert order[-1].name == "never"


def test_quality_order_counts_cost_and_what_is_left(spark):
    from pyspark.sql import functions as F
    sample = spark.range(2000).select(F.repeat(F.lit("some Words! "), 40).alias("text"), (F.col("id") % 2 == 0).alias("even"), (F.col("id") % 4 < 3).alias("most"))
    heavy = F.lit(0)
    for i in range(25):
        heavy = heavy + F.length(F.regexp_replace("text", f"(a|b|o)+{i}?[a-z]*", ""))
    dear = quality.Rule("a_dear", F.col("even") & (heavy > -1))
    cheap = quality.Rule("cheap", F.col("even"))
    assert [r.name for r in quality.ordered(sample, [dear, cheap])] == ["cheap", "a_dear"]
    # "same" rejects more than "rest" alone, but nothing that "most" leaves
    same, rest = quality.Rule("same", F.col("most") & F.col("even")), quality.Rule("rest", ~F.col("most"))
    order = [r.name for r in quality.ordered(sample, [same, rest, quality.Rule("most", F.col("most"))])]
    assert order.index("rest") < order.index("same")


def test_quality_sample_is_drawn_from_the_whole_table(spark):
    docs_ = spark.range(20_000).select("id", F_text("id"))
    got = [r["id"] for r in quality.sampled(docs_).collect()]
    assert 800 < len(got) < 1200 and min(got) < 500 and max(got) > 19_500
    assert quality.sampled(docs_.limit(10)).count() == 10


# Packing.

def brute_bins(items, capacity):
    best, items = len(items), sorted(items, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_pack_is_optimal_on_small_inputs():
    r = random.Random(5)
    for _ in range(120):
        capacity = r.choice([10, 20, 50])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        bins, bound = packing.pack(dict(Counter(items)), capacity)
        assert Counter(n for fill, c in bins for n in fill * c) == Counter(items)
        assert all(sum(fill) <= capacity for fill, _ in bins)
        assert bound <= sum(c for _, c in bins) == brute_bins(items, capacity)


def test_pack_loses_no_filling_of_a_node(monkeypatch):
    monkeypatch.setattr(packing, "MAX_TABLES", 1)
    for fewest, capacity, counts in ((10, 100, {9: 4, 15: 5, 21: 6, 26: 4, 27: 3, 35: 7, 36: 1, 49: 6}), (16, 1000, {126: 6, 151: 4, 152: 6, 316: 7, 321: 5, 372: 6, 374: 4, 380: 3, 441: 9})):
        bins, bound, proved = packing.search(counts, capacity)
        assert Counter(n for fill, c in bins for n in fill * c) == Counter(counts) and all(sum(fill) <= capacity for fill, _ in bins)
        assert sum(c for _, c in bins) == fewest and proved
    monkeypatch.setattr(packing, "MAX_STEPS", 10)
    bins, bound, proved = packing.search(counts, capacity)
    assert Counter(n for fill, c in bins for n in fill * c) == Counter(counts) and not proved


def undominated(has, room):
    """Fillings that leave no room for a piece, and no part of which a free piece can replace."""
    for times in product(*(range(c + 1) for c in has.values())):
        fill = sorted((n for n, k in zip(has, times, strict=True) for _ in range(k)), reverse=True)
        free, waste = [n for n, k in zip(has, times, strict=True) if k < has[n]], room - sum(fill)
        parts = [[n for i, n in enumerate(fill) if m >> i & 1] for m in range(1 << len(fill))]
        if waste >= 0 and not any(sum(p) <= n <= sum(p) + waste and p != [n] for p in parts for n in free):
            yield tuple(fill)


def test_fillings_are_the_undominated_ones():
    deal = lambda counts, top, capacity: list(packing.fillings(counts, top, capacity, lambda: capacity, lambda: None, {}))
    assert deal({10: 1, 5: 1, 3: 1, 1: 1}, 10, 16) == [(5, 1)]
    r = random.Random(2)
    for _ in range(200):
        capacity = r.randint(8, 40)
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, capacity + 1), r.randint(2, 6))}
        top = max(counts)
        has = {n: k for n, c in counts.items() if n <= capacity - top and (k := c - (n == top))}
        got = deal(counts, top, capacity)
        assert sorted(got) == sorted(undominated(has, capacity - top)) and got == sorted(got, key=lambda f: -sum(f))


def test_packing_query_against_the_library(spark):
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, tokens = set(), 0
    for i, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        tokens += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at:at + 2048]
            want.add((i, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows) <= -(-tokens // 2048) + 2


def test_words_have_the_ids_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), packing.Words(path), random.Random(4)
    bits = ["a", "b", "X", "Z", ".", ",", ";", ":", "!", "?", "'", "'s", "\t", "\x0b", "\u00a0", "é", "É", "Σ", "ς", "İ", "ß", "ẞ", "ñ", "中", "1", "9", "<|endoftext|>", "e\u0301", "”", "…", "😀", "ﬁ", "가", "\u212b"] + [" "] * 8
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["", "a.", "é.", "1.", "..", "a..", "it's.", "x<|endoftext|>.", "ΑΣ. ΑΣ"]
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    for row, stop, data, starts in arrow.chunks(pa.array(texts), 1 << 12):
        out, first = own.encode(data, starts, 0)
        assert [out[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want[row:stop]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="unexpected"):
        packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="unexpected"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_edge_cases(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path).collect()
    check_packing(rows)
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS) and sum(r["length"] == 1 for r in rows if r["start"] == 0) >= 4
    assert packing.pack_documents(none, path).count() == 0


# BPE.

def test_bpe_round_trip_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, codec = Tokenizer.from_file(path), bpe.Codec(path)
    r = random.Random(2)
    letters = list("aabcdeéñß  \n\t\r'stdml.,!?<|>_0129\x1c\x85\xa0​中文字😀İſ\x00")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "x\n <|endoftext|>  y", "<|endoftext|>", "", " ", "a  ", "zzzz" * 400, "ab " * 9, LONG[:20000]]
    ids = codec.encode(texts)
    for t, got, want in zip(texts, ids, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, t
        assert codec.decode(np.frombuffer(got, "<u4")).decode() == tokenizer.decode(want.ids, skip_special_tokens=False)
    assert codec.decode(np.array([codec.v.ids[b"\xc3"]])).decode() == "�"


def test_traversal_equals_merging_by_definition():
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    words = sorted({"".join(r.choice("theinrsaong dlu") for _ in range(r.randint(1, 14))).encode() for _ in range(1500)})
    assert list(bpe.traverse(v, words)) == [v.merged(w) for w in words]


def test_bpe_query_and_edge_cases(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in QUERIES["op5_bpe_codec"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert [r["decoded"] for r in bpe.encode_texts(odd, path).collect()] == [t or "" for _, t in ROWS]
    assert bpe.encode_texts(none, path).count() == 0


# Toxicity.

def test_toxicity_learns_words_and_inflected_forms(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 9))) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[r.randrange(40)] = r.choice(["Zwokpa", "zwokle,", "zwokti"]) + r.choice("abc")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    d, y = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(d, toxicity.learn(d, y)).join(y, "doc_id").filter(toxicity.held_out()).collect()
    assert np.mean([(x["score"] >= 0.3) == x["toxic"] for x in out]) > 0.98


def test_toxicity_sample_keeps_the_share_of_toxic_labels(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(8))) for i in range(1200)]
    d, y = docs(spark, rows), spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    cut = np.mean([x["score"] for x in toxicity.score(d, toxicity.learn(d, y, class_rows=60)).collect()])
    whole = np.mean([x["score"] for x in toxicity.score(d, toxicity.learn(d, y)).collect()])
    assert abs(cut - whole) < 0.05 and cut < 0.2
    both = dict(toxicity.learn(d, y, class_rows=60))
    known = y.filter(~toxicity.held_out()).groupBy("toxic").count().collect()
    lost = {x["toxic"]: np.log(x["count"] / min(60, x["count"])) for x in known}
    assert lost[0] - lost[1] > 1 and both[1 << toxicity.BITS] < -1


def test_toxicity_never_sees_held_out_labels(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    y = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = y.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.learn(d, y) == toxicity.learn(d, flipped)


def test_toxicity_features_stay_inside_their_row():
    one = [x.tolist() for x in toxicity.rows_of(pa.array(["alpha beta", None, "gamma", ""]))]
    alone = [next(iter(toxicity.rows_of(pa.array([t])))).tolist() for t in ("alpha beta", "", "gamma", "")]
    assert one == alone and one[1] == []


def plain_ftrl(rows, seed=3):
    """Step by step with dictionaries: McMahan's per-coordinate update."""
    z, n, bias = defaultdict(float), defaultdict(float), 1 << toxicity.BITS

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    draw = np.random.Generator(np.random.PCG64(seed))
    for _ in range(toxicity.EPOCHS):
        for k in draw.permutation(len(rows)):
            features, label = rows[k]
            at = [*features, bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                rate = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - rate * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if abs(z[i]) > toxicity.L1}


def test_toxicity_learns_and_scores_like_plain_python(spark):
    r = random.Random(9)
    words = ["nice", "day", "häßlich", "awful", "people", "stupid", "so", "green", "Tree's", "walking"]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 14)))) for i in range(160)] + [(200, None), (201, "")]
    labels = [(i, int("stupid" in (t or "") or "awful" in (t or ""))) for i, t in texts]
    table = docs(spark, texts)
    weights = dict(toxicity.learn(table, spark.createDataFrame(labels, "doc_id long, toxic long")))
    known = [(i, t, y) for (i, t), (_, y) in zip(texts, labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = plain_ftrl([(sorted(plain_features(t)), y) for _, t, y in sorted(known)])
    assert set(weights) == set(want) and all(weights[i] == pytest.approx(want[i], rel=1e-9) for i in want) and len(want) > 5
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(table, list(weights.items())).collect()}
    for i, t in texts:
        total = sum(want.get(f, 0.0) for f in plain_features(t)) + want.get(1 << toxicity.BITS, 0.0)
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)


def test_toxicity_edge_cases(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(odd, empty) == [] and {r["score"] for r in toxicity.score(odd, []).collect()} == {0.0}
    weights = [(1 << toxicity.BITS, -2.0)]
    assert toxicity.score(odd, weights).filter("score > 0 AND score < 1").count() == len(ROWS)
    assert toxicity.score(none, weights).count() == 0
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (4, 1, 1), (5, 0, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    toxicity.learn(odd, labels)


# Near duplicates.

def near_brute(rows, size, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())))
    label = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return sorted((i, len(s), label[i], label[i] == i) for i, s in sets)


def near_rows(seed, n):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(300)}" for _ in range(r.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        rows.append((1000 - i, " ".join(w) if i % 17 else r.choice([None, "", " \n", "W1", "w1"])))
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, size, monkeypatch):
    rows = near_rows(size, 90)
    if size == 5:
        monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)  # every neighbourhood is cut
    got = minhash.near_duplicates(docs(spark, rows), size=size)
    assert sorted(rows_of(got, "doc_id", "n_shingles", "component_id", "kept")) == near_brute(rows, size)


def test_sketch_coordinates_all_fill_and_estimate():
    of = np.repeat([0, 1], [1, 300])
    hashes = np.random.default_rng(1).integers(0, 2**63, 301, dtype=np.uint64)
    out = minhash.sketches(of, hashes, 3, 252)
    assert (out[:2] != np.uint64(2**64 - 1)).all() and (out[2] == np.uint64(2**64 - 1)).all()
    a, b = hashes[1:], np.r_[hashes[61:], np.random.default_rng(2).integers(0, 2**63, 60, dtype=np.uint64)]
    both = minhash.sketches(np.repeat([0, 1], 300), np.r_[a, b], 2, 252)
    assert abs((both[0] == both[1]).mean() - 240 / 360) < 0.1


def test_near_duplicates_edge_cases(spark, odd, none):
    got = rows_of(minhash.near_duplicates(odd, 4), "doc_id", "n_shingles", "component_id", "kept")
    assert len(got) == len(ROWS) and [g for g in got if g[0] is None] == [(None, 0, None, True), (None, 1, None, True)]
    assert got.count((5, 2, 5, True)) == 2
    assert minhash.near_duplicates(none, 4).count() == 0


def test_neighbourhoods_of_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    r = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):  # a chain: each text differs a little from the one before, the ends share little
        base[r.randrange(40)] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += [(200 + i, rows[60][1]) for i in range(30)]
    r.shuffle(rows)
    got = rows_of(minhash.near_duplicates(docs(spark, rows), 4, 80), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got) == sorted(near_brute(rows, 4))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 6), (6, 5), (5, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, *range(300, 340)]}, 5: 5, 6: 5}
