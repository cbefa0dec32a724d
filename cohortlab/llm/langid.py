"""Language identification: interpolated Kneser-Ney models of characters, one for each language, in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm import arrow
from cohortlab.session import materialize

#: Characters of a gram.
ORDER = 5
#: A gram with less than this share of its language's counts of its order is left to the lower orders, so that
#: a model holds at most ORDER / KEEP_SHARE grams, whatever the size of the corpus.
KEEP_SHARE = 1e-5
#: One training document in so many is not counted, but tells how sure a prediction is.
CALIBRATE = 8
#: Share of rightly predicted calibration documents of a language whose cross-entropy is thought usual.
USUAL = 0.999
#: Predictions with a lower chance of being right are rejected.
SURE = 0.5
#: Characters that an unseen one is one of.
ALPHABET = 1 << 17
#: Steps of the calibration's histogram, and their number.
STEP, STEPS = 0.25, 400

MARK = " "
OTHER = r"[^\pL]+"


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of letters in lower case: their row, their number among the distinct ones, and these; a null text has none."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), OTHER, MARK)
    lists = pc.split_pattern(spaced, MARK)
    row, word = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.not_equal(word, "")
    coded = pc.dictionary_encode(word.filter(full))
    return row.filter(full).to_numpy().astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows, added up within each batch before they are shuffled."""

    def count(langs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        row, word, distinct = words_of(texts)
        lang = pc.dictionary_encode(langs)
        both, n = np.unique(lang.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64) * max(1, len(distinct)) + word, return_counts=True)
        of, at = np.divmod(both, max(1, len(distinct)))
        return pa.record_batch({"lang": lang.dictionary.take(pa.array(of)), "word": distinct.take(pa.array(at)).cast(pa.string()), "n": pa.array(n, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, _, _ in arrow.chunks(batch.column("text")):
                yield count(*(batch.column(c).slice(row, stop - row) for c in ("lang", "text")))

    arrow.prepare(docs.sparkSession)
    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def discounted(words: DataFrame, order: int, share: float) -> DataFrame:
    """Rows of the models of all languages: (lang, k, gram, alpha) of kept grams, and (lang, k, context, spare).

    Words stand between marks, ``order`` - 1 before and one after. The highest order counts occurrences, a lower one the characters
    that its gram follows. ``alpha`` is the discounted share of a gram among those of its context (k - 1 characters), ``spare`` what is
    left to the lower order; what a gram that is not kept would have had is left to it, too.
    """
    padded = F.concat(F.lit(MARK * (order - 1)), F.col("word"), F.lit(MARK))
    grams = words.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))).alias("gram"))
    level = materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    out = []
    for k in range(order, 0, -1):
        once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        rates = level.groupBy("lang").agg(F.sum("c").alias("total"), F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("discount"))
        rows = level.join(F.broadcast(rates), "lang").select(  # a row for each language
            "lang", "gram", F.substring("gram", 1, k - 1).alias("context"), "c", (F.col("c") - F.col("discount")).alias("left"), (F.col("c") >= F.lit(share) * F.col("total")).alias("kept"))
        sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("kept"), F.col("left"))).alias("used")).filter("used is not null")
        out.append(rows.filter("kept").join(sums, ["lang", "context"]).select("lang", F.lit(k).alias("k"), "gram", (F.col("left") / F.col("all")).alias("alpha"), F.lit(True).alias("is_gram")))
        out.append(sums.select("lang", F.lit(k).alias("k"), F.col("context").alias("gram"), (1 - F.col("used") / F.col("all")).alias("alpha"), F.lit(False).alias("is_gram")))
        if k > 1:
            level = materialize(level.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


SEED, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _chain(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]) if columns else 1, SEED)
    for c in columns:
        h = arrow.mix((h ^ c) * TURN)
    return h


def hashes(columns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 .. number of columns: hashes of the last k code points, and of the k - 1 before the last."""
    return [(_chain(columns[-k:]), np.broadcast_to(_chain(columns[-k:-1]), len(columns[0]))) for k in range(1, len(columns) + 1)]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """One language: for each order the sorted hashes of its grams with their interpolated log probabilities, and of its contexts with what they leave."""

    lang: str
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_probabilities(self, hashed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of the last character of each gram, given those before it."""
        out = np.zeros(len(hashed[0][0]))
        todo = np.arange(len(out))
        for k in range(len(hashed) - 1, -1, -1):
            gram, context = hashed[k]
            at, hit = _found(self.grams[k][0], gram[todo])
            out[todo[hit]] += self.grams[k][1][at[hit]]
            todo = todo[~hit]
            at, hit = _found(self.contexts[k][0], context[todo])
            out[todo[hit]] += self.contexts[k][1][at[hit]]
        out[todo] -= np.log(ALPHABET)
        return out

    def add_order(self, grams: pa.Array, alpha: np.ndarray, contexts: pa.Array, spare: np.ndarray) -> None:
        """The next order; its probabilities are interpolated with those of the orders below."""
        k = len(self.grams) + 1
        gap = np.log(np.maximum(spare, 1e-12))
        own = _chain(_columns(contexts, k - 1)) if k > 1 else _chain([])[: len(contexts)]
        order = np.argsort(own)
        self.contexts.append((own[order], gap[order].astype(np.float32)))
        columns = _columns(grams, k)
        hashed = hashes(columns)
        at, _ = _found(self.contexts[-1][0], hashed[-1][1])
        lower = self.log_probabilities(hashed[:-1]) if k > 1 else np.full(len(grams), -np.log(ALPHABET))
        p = np.log(alpha + np.exp(self.contexts[-1][1][at] + lower)) if len(grams) else np.empty(0)
        order = np.argsort(hashed[-1][0]) if len(grams) else np.empty(0, np.int64)
        self.grams.append((hashed[-1][0][order], p[order].astype(np.float32)))


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)


def _columns(grams: pa.Array, k: int) -> list[np.ndarray]:
    """The code points of grams of ``k`` characters, character by character."""
    return list(_code_points(grams.to_pylist()).reshape(-1, k).T)


def word_scores(models: list[Model], words: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word (with the mark after it) in each language, and its number of characters."""
    texts = words.to_pylist()
    pad = MARK * (order - 1)
    points = _code_points([pad + w + MARK for w in texts])
    chars = np.array([len(w) + 1 for w in texts], np.int64)
    ends = np.cumsum(chars + order - 1)
    inner = np.ones(len(points), bool)
    for i in range(order - 1):
        inner[ends - chars - 1 - i] = False
    at = np.flatnonzero(inner)
    _, first, which = np.unique(_chain([points[at - i] for i in range(order - 1, -1, -1)]), return_index=True, return_inverse=True)
    hashed = hashes([points[at[first] - i] for i in range(order - 1, -1, -1)])  # each distinct gram is looked up once
    starts = np.concatenate([[0], np.cumsum(chars)[:-1]])
    return np.stack([np.add.reduceat(m.log_probabilities(hashed)[which], starts) for m in models], 1), chars


@dataclass
class Identifier:
    """The models of all languages, how a margin becomes a chance of being right, and the cross-entropy that is still usual."""

    models: list[Model]
    order: int
    slope: tuple[float, float] = (0.0, 1.0)
    usual: dict[str, tuple[float, float]] = field(default_factory=dict)

    def measure(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: number of the best language (-1: no letter), its cross-entropy per character, the margin to the second, characters."""
        parts = [self._measure(texts.slice(row, stop - row)) for row, stop, _, _ in arrow.chunks(texts)]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else self._measure(texts)

    def _measure(self, texts: pa.Array) -> dict[str, np.ndarray]:
        row, word, distinct = words_of(texts)
        best, ce, margin, chars = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if len(distinct) and self.models:
            scores, size = word_scores(self.models, distinct, self.order)
            chars = np.bincount(row, size[word], len(texts)).astype(np.int64)
            bits = np.stack([np.bincount(row, -scores[word, i], len(texts)) for i in range(len(self.models))], 1) / np.maximum(chars, 1)[:, None]
            ranked = np.sort(bits, 1)
            best = np.where(chars > 0, np.argmin(bits, 1), -1)
            ce, margin = ranked[:, 0], ranked[:, min(1, ranked.shape[1] - 1)] - ranked[:, 0]
        return {"best": best, "ce": ce, "margin": margin, "chars": chars}


MEASURES = "best int, ce double, margin double, chars long"


def surety(margin: Column | np.ndarray, chars: Column | np.ndarray):
    """The margin in units that do not depend on the length: it varies by the root of the number of characters."""
    return margin * chars ** 0.5


def measured(docs: DataFrame, found: Identifier) -> DataFrame:
    """``docs`` with a struct column ``m_found`` of ``MEASURES``."""
    spark = docs.sparkSession
    arrow.prepare(spark)
    held = spark.sparkContext.broadcast(found)

    @F.arrow_udf(MEASURES)
    def run(texts: pa.Array) -> pa.Array:
        got = held.value.measure(texts)
        kinds = {"best": pa.int32(), "ce": pa.float64(), "margin": pa.float64(), "chars": pa.int64()}
        return pa.StructArray.from_arrays([pa.array(got[c], t) for c, t in kinds.items()], names=list(kinds))

    return docs.withColumn("m_found", run("text"))


def fitted(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope (not negative) of the chance of being right over (surety, right, wrong), by Newton's steps.

    Half a right and half a wrong prediction at no surety and a weak pull keep it finite when none is wrong.
    """
    z, right, wrong = (np.array(x, float) for x in zip(*counts, (0.0, 0.5, 0.5), strict=True))
    beta, x = np.array([0.0, 1.0]), np.stack([np.ones(len(z)), z], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        n = right + wrong
        slope = x.T @ (right - n * p) - 1e-3 * (beta - [0.0, 1.0])
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 1e-3 * np.eye(2), slope)
        beta = beta + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def learn(docs: DataFrame, order: int = ORDER, share: float = KEEP_SHARE) -> Identifier:
    """Models of all languages among documents that have a doc_id, a lang and a text and are not held out.

    Needs doc_id, text and lang. All of them are counted but those of the calibration, one in ``CALIBRATE`` by a hash of doc_id; a
    language that only these have is not learned. The driver holds the kept grams alone: at most ``order / share`` for a language. Equal rows
    count as often as they are there. Without any row nothing is learned.
    """
    known = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
    rows = discounted(materialize(word_counts(known.filter(~aside))), order, share).toArrow()
    models = []
    for lang in sorted(pc.unique(rows.column("lang")).to_pylist()):
        model = Model(lang)
        own = rows.filter(pc.equal(rows.column("lang"), lang))
        for k in range(1, order + 1):
            level = own.filter(pc.equal(own.column("k"), k))
            grams, contexts = level.filter(level.column("is_gram")), level.filter(pc.invert(level.column("is_gram")))
            cells = lambda t: (t.column("gram").combine_chunks(), t.column("alpha").to_numpy())
            model.add_order(*cells(grams), *cells(contexts))
        models.append(model)
    found = Identifier(models, order)
    if models:
        calibrate(found, known.filter(aside))
    return found


def calibrate(found: Identifier, docs: DataFrame) -> None:
    """How sure predictions are, from documents with a known language: one row for each step of the margin, one for each language."""
    names = F.array(*[F.lit(m.lang) for m in found.models])
    seen = measured(docs, found).filter("m_found.best >= 0").select("lang", "m_found.*")
    seen = materialize(seen.withColumn("right", F.get(names, F.col("best")).eqNullSafe(F.col("lang"))))
    step = F.least(F.floor(surety(F.col("margin"), F.col("chars")) / STEP), F.lit(STEPS)).cast("int").alias("step")
    bins = seen.groupBy(step).agg(F.count_if("right").alias("right"), F.count_if(~F.col("right")).alias("wrong")).collect()
    found.slope = fitted([((b["step"] + 0.5) * STEP, b["right"], b["wrong"]) for b in bins])
    means = seen.filter("right").groupBy("best").agg(F.avg("ce").alias("mean"))
    off = seen.filter("right").join(F.broadcast(means), "best").groupBy("best").agg(  # a row for each language
        F.max("mean").alias("mean"), F.percentile_approx((F.col("ce") - F.col("mean")) * F.sqrt("chars"), USUAL, 10_000).alias("most"))
    found.usual = {found.models[r["best"]].lang: (r["mean"], r["most"]) for r in off.collect()}


def identify(docs: DataFrame, found: Identifier) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected.

    Needs a column text; columns of these names are replaced. lang_pred is the language of the least cross-entropy per character; equal ones
    go to the first by name. score is the calibrated chance that it is right. rejected: the chance is below ``SURE``, or the
    cross-entropy is unusual for texts of that language. A null text, and one without a letter, is ``und``, with score 0, no
    cross-entropy, and rejected; so is every text if no language was learned.
    """
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    m, none = (lambda c: F.col(f"m_found.{c}")), F.col("m_found.best") < 0
    names = F.array(*[F.lit(x.lang) for x in found.models]).cast("array<string>")
    limits = [found.usual.get(x.lang, (0.0, float("inf"))) for x in found.models]
    pick = lambda i: F.get(F.array(*[F.lit(float(x[i])) for x in limits]).cast("array<double>"), m("best"))
    score = 1 / (1 + F.exp(-(F.lit(found.slope[0]) + F.lit(found.slope[1]) * surety(m("margin"), m("chars")))))
    strange = (m("ce") - pick(0)) * F.sqrt(m("chars")) > pick(1)
    out = measured(docs, found).withColumns({"lang_pred": F.when(none, "und").otherwise(F.get(names, m("best"))), "score": F.when(none, 0.0).otherwise(score),
                                             "cross_entropy": F.when(~none, m("ce"))})
    return out.withColumn("rejected", none | (F.col("score") < SURE) | strange).drop("m_found")
