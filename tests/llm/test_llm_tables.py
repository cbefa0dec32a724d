"""Operators on pages, vectors, conversations and shards, and the pipeline's stages, against brute force."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlab.llm import chat, sharding, topk, toxicity, url_filter
from cohortlab.llm.catalog import PATTERNS, QUERIES, SITES
from tests.llm.brute import check_packing, line_brute, plain_features

SF = "/root/testdata/sf0.001"


# URL filters.

def test_url_rules_meet_few_and_decide_like_brute_force(spark):
    rules = [url_filter.site(*s) for s in SITES] + PATTERNS
    r = random.Random(1)
    hosts = ["example.org", "a.EXAMPLE.org", "notexample.org", "org", "x.com", "com", "ads.x.net", "y.net:80", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a", "/de/", "/login/", "/a.exe"]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=://b/es/", "#/de/")] + ["no scheme/es/", "", None, "http://a\nb.org/x"]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {x["page_id"]: x for x in url_filter.judge(pages, rules).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own = "block" if host.startswith("ads.") or path.startswith("/login/") or path.endswith(".exe") else "allow"
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == (max(fit)[1:] if fit else (None, own)), u
    assert max(x["n_tried"] for x in got.values()) < len(rules)


def test_url_index_uses_the_rarest_token_and_no_rule_is_lost(spark):
    rules = [url_filter.site("shop.example.org", "/a/", "block"), url_filter.pattern("q+", "block")]
    by, always = url_filter.index(rules, {"shop": 2, "example": 90, "org": 99, "a": 5})
    assert by == {"shop": [0]} and always == [1]
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, rules).count() == 0


# Sharding.

def test_hypergeometric_draws_are_exact_in_distribution():
    draw = np.random.Generator(np.random.PCG64(1))
    got = Counter(sharding.hypergeometric(draw, 5, 12, 4) for _ in range(20000))
    from math import comb
    for k in range(5):
        assert abs(got[k] / 20000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.015
    big = [sharding.hypergeometric(draw, 3 * 10**10, 10**11, 10**9) for _ in range(50)]
    assert abs(np.mean(big) - 3 * 10**8) < 5 * (10**9 * 0.21 / 50) ** 0.5


def test_matrix_rows_and_columns_add_up():
    counts, sizes = np.cumsum([0, 5, 0, 17, 3, 9, 6]), [14, 13, 13]
    rows = [sharding.matrix_row(counts, p, sizes, 3) for p in range(6)]
    assert [sum(own) for own, _ in rows] == [5, 0, 17, 3, 9, 6]
    assert np.sum([own for own, _ in rows], axis=0).tolist() == sizes
    for p in range(6):
        assert rows[p][1] == np.sum([own for own, _ in rows[:p]] or [[0, 0, 0]], axis=0).tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutations_are_permutations(size):
    assert sorted(sharding.permute(np.arange(size), size, 5).tolist()) == list(range(size))


def test_shards_are_exact_gapless_and_uniform(spark):
    rows = spark.range(0, 4003, 1, 7).select(F.col("id").alias("doc_id"), F.lit("old").alias("shard"))
    got = sharding.shuffle(rows, 8).collect()
    by = defaultdict(list)
    for x in got:
        by[x["shard"]].append((x["slot"], x["doc_id"]))
    assert sorted({len(v) for v in by.values()}) == [500, 501] and sorted(x["doc_id"] for x in got) == list(range(4003))
    for v in by.values():
        assert [s for s, _ in sorted(v)] == list(range(len(v)))
        assert abs(np.corrcoef(*zip(*v, strict=True))[0, 1]) < 0.15
        assert abs(np.mean([d for _, d in v]) - 2001) < 200
    assert sharding.exchange(sharding.shuffle(rows, 8), 8, 2).count() == 4003


def test_sharding_edge_cases(spark):
    rows = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x")], "doc_id long, text string")
    assert sorted(x["shard"] for x in sharding.shuffle(rows, 40).collect()) == sorted({x["shard"] for x in sharding.shuffle(rows, 40).collect()})
    assert sharding.shuffle(rows.limit(0), 40).count() == 0
    query = QUERIES["op8_sharding"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    import zlib
    assert {(x["doc_id"], x["size"], x["text_crc32"]) for x in query} == {(d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs}


# Top-k.

def test_impact_index_equals_brute_force():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, d, k = int(r.integers(1, 40)), int(r.integers(0, 6)), int(r.integers(1, 6))
        matrix, query, own = r.integers(-5, 6, (n, d)) * int(r.integers(1, 400)), r.integers(-5, 6, d), r.random(n) < 0.2
        rows, scores, _ = topk.ImpactIndex(matrix).search(query, k, own, np.arange(n))
        exact = matrix @ query
        want = np.flatnonzero(~own)
        want = want[np.lexsort((want, -exact[want]))][:k]
        assert rows.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()


def test_impact_index_stops_early_when_one_dimension_decides():
    matrix = np.random.default_rng(1).integers(0, 4, (4000, 32))
    matrix[:40, 0] = 100_000
    rows, _, read = topk.ImpactIndex(matrix).search(np.r_[1000, np.ones(31, np.int64)], 10, np.zeros(4000, bool), np.arange(4000))
    assert set(rows) <= set(range(40)) and read < matrix.size / 10


def test_topk_over_blocks_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) / 7 for _ in range(5)]) for i in range(80)] + [(90, None), (91, [1.0, None]), (92, [float("nan")]), (93, [float("inf")]), (94, []), (95, [0.5])]
    vectors = topk.quantised(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string"))
    got = topk.search(vectors.filter("vec_id % 10 = 0"), vectors, 4).collect()
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in range(0, 80, 10):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)[:4]
        assert [(x["rank"], x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert topk.search(vectors.limit(0), vectors).count() == topk.search(vectors, vectors.limit(0)).count() == 0


# Chat.

def test_chat_round_trip_and_mask(spark, monkeypatch):
    from cohortlab.llm import arrow
    parts = ["### Assistant: ", "</turn>", "\\", "\n", "<", "/turn>", "#", "text", "é😀", ""]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\n<role>#\\"]), r.choice([None, "".join(r.choices(parts, k=6))])) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (3, 0, "user", "again"), (3, 0, "user", "again"), (50, None, "assistant", "### x" * 4000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, part string")
    spark.conf.set(arrow._RECORDS, "2")  # conversations are cut into parts
    try:
        got = {x["conv_id"]: x for x in chat.digests(chat.format_turns(df)).collect()}
        assert chat.format_turns(df).filter("part > 0").count() > 0
    finally:
        spark.conf.set(arrow._RECORDS, str(arrow.BATCH_ROWS))
    by = defaultdict(list)
    low = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    for c, t, role, text in sorted(rows, key=lambda x: [low(v) for v in x]):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = {x["conv_id"]: x["formatted"] for x in chat.format_turns(df.filter("conv_id < 40")).collect()}
    for c, formatted in whole.items():
        assert [(a.decode(), b.decode()) for a, b in chat.turns_of(bytes(formatted))] == by[c] and got[c]["formatted_chars"] == len(bytes(formatted).decode())
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_query_has_the_extra_conversation(spark):
    got = {x["conv_id"]: x for x in QUERIES["op10_chat_format"](spark, SF).collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[-7]["n_turns"], got[-7]["loss_chars"], got[-7]["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(got) == 1 + spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()


# Pipeline.

def quality_brute(text):
    """Whether the rules keep a text, word by word."""
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    often = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})
    chars = sum(map(len, ws))
    if len(ws) < 50 or 100 * repeated > 50 * len(ws):
        return False
    return not (sum(c in "#*$%&|<>" for c in text) * 10 > len(ws) or (len(lines) - len(set(lines))) * 2 > len(lines) or not 2 * len(ws) <= chars <= 15 * len(ws)
                or sum(unicodedata.category(c) == "Lu" for c in text) * 10 > chars * 3 or text.count("!") * 10 > len(ws) * 3
                or sum(unicodedata.category(c)[0] == "L" for c in text) * 2 < chars)


def near_groups(rows, size, percent=80):
    """Smallest id of each document's group, from every pair of sets."""
    sets, root = [], {i: i for i, _ in rows}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        before = dict(rows)
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
            texts = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "toxicity":
            weights = dict(toxicity.learn(docs, labels))
            chance = {i: 1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in plain_features(t)) - weights.get(1 << toxicity.BITS, 0.0))) for i, t in rows}
            sure = {i for i, p in chance.items() if abs(p - 0.3) > 1e-5}
            assert {i for i in texts if i in sure} == {i for i in sure if chance[i] < 0.3} and texts == {i: before[i] for i in texts}
        elif name == "quality_rules":
            assert texts == {i: t for i, t in rows if quality_brute(t)} and 0 < len(texts) < len(rows)
        elif name == "line_dedup":
            assert texts == {i: kept for i, _, _, kept in line_brute(rows)}
        elif name == "near_dedup":
            group = near_groups(rows, 5)
            assert texts == {i: t for i, t in rows if group[i] == i}
        else:
            pieces = after.collect()
            check_packing(pieces)
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            library.no_truncation()
            library.no_padding()
            total = Counter()
            for p in pieces:
                total[p["doc_id"]] += p["length"]
            assert total == {i: 1 + len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
            count = len(pieces)
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == count


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x " * 5000, None, "s", 9), (2, "x " * 5000, None, "s", 9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).collect()
        if name == "quality_rules":
            assert got == []  # none of them passes
        elif name == "packing":
            assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == {1: 1, None: 1, 2: 2}
        elif name == "near_dedup":
            assert Counter(r["doc_id"] for r in got) == {1: 1, None: 1, 2: 2}  # rows of one doc_id are one document
        else:
            assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter((r[0], r[1] or "") for r in rows)
        assert stage(spark, docs.limit(0), SF).collect() == []
