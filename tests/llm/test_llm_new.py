"""Language identification, fill-in-the-middle and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import arrow, fim, langid, merkle
from cohortlab.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
LONG = " ".join(f"wörd{i % 977} and{i}" for i in range(40_000))
TEXTS = [None, "", " \n\t", "a", LONG, "same text here", "same text here", "no <P> here", "<M>", "< P><", "Ünï 中文 😀\x00 a\r\nb", "<", "<S", "P>", "x<P", "é" * 50]
DOC = "doc_id long, text string, lang string, source string, n_chars long, form string, score double, hash string, block long, h1 long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "f", 9.0, "h", 3, 4) for i, t, lang, s, n in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    ids = [*range(len(TEXTS) - 2), None, None]
    return table(spark, [(i, t, None if i == 3 else "xx", None if i in (4, 5) else "s", None) for i, t in zip(ids, TEXTS)] + [(5, "same text here", "xx", "s", 14)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# Fill-in-the-middle.

def fim_brute(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_fill_in_middle_matches_plain_slices_and_restores(spark, odd, monkeypatch, chunk):
    r = random.Random(3)
    bits = ["<P", ">", "<", "é", "中", "😀", "a", "b\n", " ", "S>", "M"]
    rows = [(1000 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 30))), None, None, None) for i in range(600)]
    docs = odd.unionByName(table(spark, rows))
    if chunk < 1000:  # in this process, with chunks of a few rows
        texts = [t for _, t, *_ in rows]
        h = np.array([[int(sha(f"1:{i}")[8 * k:8 * k + 8], 16) for k in range(4)] for i, *_ in rows])
        for row, stop, data, starts in arrow.chunks(pa.array(texts), chunk):
            out, at, got = fim.rearrange(data, starts, h[row:stop])
            for k in range(stop - row):
                assert out[at[k]:at[k + 1]].tobytes().decode() == fim_brute(rows[row + k][0], texts[row + k])[4]
            back, where = fim.put_back(out, at, got["plain"], got["spm"])
            assert [back[where[k]:where[k + 1]].tobytes().decode() for k in range(stop - row)] == texts[row:stop]
        return
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((str(x["doc_id"]), x["n"], x["form"], str(x["prefix_chars"]), str(x["middle_chars"]), x["output"], x["restored"]) for x in fim.restore(made).collect())
    want = []
    for x in docs.select("doc_id", "text").collect():
        n, form, a, m, out = fim_brute(x["doc_id"], x["text"])
        want.append((str(x["doc_id"]), n, form, str(a), str(m), out, x["text"] or ""))
    assert got == sorted(want)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark, none):
    assert fim.restore(fim.transform(none)).count() == 0
    broken = spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")
    with pytest.raises(Exception, match="exactly three marks"):
        fim.restore(broken).collect()
    swapped = spark.createDataFrame([("spm", "<P>a<S>b<M>c")], "form string, output string")
    with pytest.raises(Exception, match="order of the form"):
        fim.restore(swapped).collect()


# Merkle manifest.

def merkle_brute(rows, run=16):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        """Root, and for each leaf the (left, right) hashes beside it, level by level."""
        paths, of, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
        while len(nodes) > 1:
            for leaf, i in enumerate(of):
                k = i // run * run
                paths[leaf].append(("".join(nodes[k:i]), "".join(nodes[i + 1:k + run])))
            nodes = [sha("".join(nodes[i:i + run])) for i in range(0, len(nodes), run)]
            of = [i // run for i in of]
        return nodes[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], sha("".join(map(field, r)))))
    subs, out = {}, []
    for s, leaves in by.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[s] = (leaves, *tree([h for _, h in leaves]))
    order = sorted(subs, key=lambda s: (s is not None, (s or "").encode()))
    root, over = tree([subs[s][1] for s in order])
    for s, up in zip(order, over):
        leaves, sub, paths = subs[s]
        out += [(i, h, sub, root, tuple(p + up)) for (i, h), p in zip(leaves, paths)]
    return out


def merkle_rows(n, seed=5):
    r = random.Random(seed)
    sources = [None, "", "a", "B", "é", "hot", "hot", "hot", "hot"] + [f"s{i}" for i in range(20)]
    rows = [(r.choice([None, *range(n)]), r.choice(sources), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "Ab", "éß😀"])) for _ in range(n)]
    return rows + rows[:20] + [(7, "one", "en", 1, LONG)]


@pytest.mark.parametrize("digits", [3, 1])
def test_manifest_equals_trees_built_in_full(spark, monkeypatch, digits):
    # with one digit a block, paths go through several passes
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 4 * digits)
    rows = merkle_rows(700)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"rank": F.lit(1), "nodes": F.lit(2), "root": F.lit("x")})
    got = merkle.manifest(docs, {"other": F.upper("source")}).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    as_tuple = lambda x: (x["doc_id"], x["leaf"], x["subroot"], x["root"], tuple((p["left"], p["right"]) for p in x["path"]))
    assert sorted(map(as_tuple, got), key=str) == sorted(merkle_brute(rows), key=str)
    assert all(x["back"] == x["root"] for x in got)
    wrong = merkle.manifest(docs).withColumn("back", merkle.folded(F.sha2(F.concat("leaf", F.lit("!")), 256), F.col("path")))
    assert wrong.filter("back = root").count() == 0


def test_manifest_edges(spark, none, odd):
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(table(spark, [(1, "t", "en", "s", 1)])).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
    assert merkle.manifest(odd).count() == odd.count()
    leaves = {r["doc_id"]: r["leaf"] for r in merkle.manifest(odd).collect()}
    assert leaves[0] != leaves[1]  # a null text is not an empty one


def test_manifest_query_finds_what_was_tampered_with(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_merkle_manifest"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None and any("A" <= c <= "Z" for c in r["text"])
        assert got[r["doc_id"]]["verified"] == (not touched)


# Language identification.

WORDS = {"en": "the of and that with this from have which their would there about other into than its only some could".split(),
         "de": "der und nicht werden einer auch nach durch über können zwischen während müssen größer schön straße zwölf für".split(),
         "el": "και του της στην από που είναι για αυτό δεν μια στο θα όπως μετά πολύ".split()}


def texts(lang, n, seed=0, size=30):
    r = random.Random(f"{lang}{seed}")
    return [" ".join(r.choice(WORDS[lang]) + r.choice(["", ",", "."]) for _ in range(r.randint(3, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows, i = [], 0
    for lang in WORDS:
        for t in texts(lang, 200):
            rows.append((i, t, lang, "s", None))
            i += 1
    return table(spark, rows + [(None, "the the", "en", "s", None), (9001, None, "en", "s", None), (9002, "1 2", "en", "s", None), (9003, "the", None, "s", None)])


def kneser_ney(counts, order):
    """Interpolated probability of the last character of a gram, by the definition."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    rates = {}
    for k, grams in levels.items():
        once, twice = (sum(c == n for c in grams.values()) for n in (1, 2))
        rates[k] = once / (once + 2 * twice) if once and twice else 0.5
    contexts = {k: defaultdict(list) for k in levels}
    for k, grams in levels.items():
        for g, c in grams.items():
            contexts[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / langid.ALPHABET
        k, seen = len(g), contexts[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        own = max(levels[k].get(g, 0) - rates[k], 0)
        return (own + rates[k] * len(seen) * p(g[1:])) / sum(seen)

    return p


def test_models_are_kneser_ney_by_the_definition(spark, corpus):
    order = 3
    found = langid.learn(corpus, order=order, share=0.0)
    assert [m.lang for m in found.models] == sorted(WORDS)
    known = corpus.filter(~langid.held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & (F.pmod(F.xxhash64("doc_id"), F.lit(langid.CALIBRATE)) != 0)).collect()
    for at, lang in enumerate(sorted(WORDS)):
        counts = Counter()
        for r in known:
            if r["lang"] == lang:
                for w in langid.words_of(pa.array([r["text"]]))[2].to_pylist():
                    n = sum(x == w for x in "".join(c if c.isalpha() else " " for c in r["text"].lower()).split())
                    padded = " " * (order - 1) + w + " "
                    for i in range(len(w) + 1):
                        counts[padded[i:i + order]] += n
        p = kneser_ney(counts, order)
        words = ["the", "über", "unseen", "και", "zq", "o", "中文"]
        scores, chars = langid.word_scores(found.models, pa.array(words), order)
        for w, s in zip(words, scores[:, at]):
            padded = " " * (order - 1) + w + " "
            assert s == pytest.approx(sum(math.log(p(padded[i:i + order])) for i in range(len(w) + 1)), rel=1e-4), (lang, w)
        assert chars.tolist() == [len(w) + 1 for w in words]
        context = " " * (order - 1)
        alphabet = {g[-1] for g in counts}
        assert sum(p(context + c) for c in alphabet) == pytest.approx(1, abs=0.01)


def test_rare_grams_leave_their_share_to_lower_orders(spark, corpus):
    full, small = langid.learn(corpus, share=0.0), langid.learn(corpus, share=0.01)
    assert sum(len(m.grams[-1][0]) for m in small.models) < sum(len(m.grams[-1][0]) for m in full.models)
    for a, b in zip(full.models, small.models):
        assert all(len(g[0]) <= 100 for g in b.grams)
        assert all((np.diff(h.astype(np.float64)) >= 0).all() for h, _ in a.grams)
    held = corpus.filter(langid.held_out() & F.col("lang").isNotNull() & F.col("text").rlike("[a-zα-ω]"))
    got = langid.identify(held, small)
    assert got.filter("lang_pred = lang").count() >= 0.97 * held.count()


def test_languages_of_held_out_texts(spark, corpus):
    found = langid.learn(corpus)
    got = langid.identify(corpus, found)
    assert set(corpus.columns) - {"score"} <= set(got.columns) and got.schema["score"].dataType.simpleString() == "double"
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == corpus.count()
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    clear = [r for i, r in rows.items() if i is not None and i < 9000 and len(r["text"]) > 40]
    assert all(r["lang_pred"] == r["lang"] for r in clear) and sum(r["rejected"] for r in clear) < 0.1 * len(clear)
    for i in (9001, 9002):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["cross_entropy"], rows[i]["rejected"]) == ("und", 0.0, None, True)
    strange = langid.identify(table(spark, [(1, "zqx wvk jjq " * 20, None, None, None), (2, "中文字 " * 30, None, None, None)]), found).collect()
    assert all(r["rejected"] for r in strange)


def test_held_out_documents_teach_nothing(spark, corpus):
    changed = corpus.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    a, b = (langid.learn(c) for c in (corpus, changed))
    assert [m.lang for m in a.models] == [m.lang for m in b.models] and a.slope == b.slope and a.usual == b.usual
    for x, y in zip(a.models, b.models):
        assert all(np.array_equal(p, q) for g, h in zip(x.grams, y.grams) for p, q in zip(g, h))


def test_language_edges(spark, odd, none):
    nothing = langid.learn(none)
    assert nothing.models == [] and langid.identify(none, nothing).count() == 0
    got = langid.identify(odd, nothing).collect()
    assert {r["lang_pred"] for r in got} == {"und"} and {r["rejected"] for r in got} == {True}
    one = langid.learn(odd)
    got = langid.identify(odd, one).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got} <= {"xx", "und"}


def test_chance_of_being_right_is_fitted():
    a, b = langid.fitted([(0.5, 60, 40), (2.0, 88, 12), (4.0, 98, 2)])
    p = lambda z: 1 / (1 + math.exp(-(a + b * z)))
    assert p(0.5) == pytest.approx(0.62, abs=0.05) and p(2.0) == pytest.approx(0.88, abs=0.04) and p(4.0) > 0.95
    assert langid.fitted([])[1] >= 0 and all(math.isfinite(x) for x in langid.fitted([(3.0, 50, 0)]))


def test_language_query_on_held_out_documents(spark):
    got = QUERIES["op11_language_id"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.join(lang, "doc_id").filter("held_out")
    assert got.count() == lang.count() and held.filter("lang_pred = lang").count() >= 0.97 * held.count()
