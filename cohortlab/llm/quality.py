"""Quality rules as a short-circuit cascade, ordered by what a sample says of cost and rejection."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Rows on which cost and rejection are estimated. Only the order depends on them, never a verdict.
SAMPLE_ROWS = 1000
#: Runs of a rule on the sample.
RUNS = 3


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that goes; it reads ``text`` and the columns of ``measured``."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    """The production rules; every bound is a plain number here."""
    n, text = F.col("n_words"), F.coalesce("text", F.lit(""))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("repeated_lines", F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("capitals", without(r"\p{Lu}+") * 10 > F.col("word_chars") * 3),
        Rule("exclamations", without("!+") * 10 > n * 3),
        Rule("few_letters", without(r"\p{L}+") * 2 < F.col("word_chars")),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    ``n_repeat_words`` counts words inside any 3-word window that occurs twice or more in the text.
    Windows are told apart by 64-bit hashes: sorted with their places only where a hash
    occurs twice, so a text costs n log n at most. Null and empty texts have zeros.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), 0))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD))))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.slice("_words", F.lit(1), F.size("_words") - 2), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))),
    }).drop("_words", "_lines")
    out = out.withColumn("_twice", F.size("_windows") > F.size(F.array_distinct("_windows")))
    out = out.withColumn("_sorted", F.when(F.col("_twice"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    near = lambda i: F.get("_sorted", i)["h"]
    out = out.withColumn("_places", F.when(F.col("_twice"), F.sort_array(F.filter(F.transform(
        "_sorted", lambda x, i: F.when((x["h"] == near(i + 1)) | ((i > 0) & (x["h"] == near(F.greatest(i - 1, F.lit(0))))), x["i"])), lambda p: p.isNotNull())))).drop("_sorted")
    reach = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
                        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")), lambda acc: acc["n"])
    return out.withColumn("n_repeat_words", F.when(F.col("_twice"), reach).otherwise(0).cast("long")).drop("_places", "_twice")


def sampled(docs: DataFrame) -> DataFrame:
    """About ``SAMPLE_ROWS`` rows drawn from the whole table, every row with the same chance; a smaller table whole."""
    rows = docs.count()
    return docs if rows <= SAMPLE_ROWS else docs.sample(SAMPLE_ROWS / rows, seed=7)


def ordered(sample: DataFrame, candidates: list[Rule]) -> list[Rule]:
    """The rules by rejection per second on a measured sample, each among the texts that the rules before it have left.

    A rule's time is the least of ``RUNS`` runs, less that of an idle one. Which texts it rejects together with which other rules comes from one
    count of all combinations, so the order is found without a run for each step.
    """
    held = materialize(sample)

    def seconds(cell: Column) -> float:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            held.agg(cell).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    idle = seconds(F.count("text"))
    cost = {r.name: max(seconds(F.count_if(r.rejects)) - idle, 1e-3) for r in candidates}
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(candidates)]
    alive = [(tuple(x[f"r{i}"] for i in range(len(candidates))), x["count"]) for x in held.select(*flags).groupBy(*[f"r{i}" for i in range(len(candidates))]).count().collect()]
    out, left = [], list(range(len(candidates)))
    while left:
        gain = lambda i: sum(n for hit, n in alive if hit[i]) / cost[candidates[i].name]  # noqa: E731, B023
        best = min(left, key=lambda i: (-gain(i), cost[candidates[i].name], candidates[i].name))
        out.append(candidates[best])
        left.remove(best)
        alive = [(hit, n) for hit, n in alive if not hit[best]]
    return out


def cascade(docs: DataFrame, order: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null. Later rules are not evaluated for that row."""
    out = F.lit(None).cast("string")
    for r in reversed(order):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def judge(docs: DataFrame, candidates: list[Rule] | None = None) -> DataFrame:
    """``docs`` (text and any other columns) with the measures, ``base_failed``, ``rejected_by`` and ``kept``.

    Columns of these names are replaced. Texts that fail the base test skip the cascade. A null text is an empty one and fails it; equal rows are
    judged alike; no rows give no rows.
    """
    candidates = rules() if candidates is None else candidates
    own = docs.drop("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
    tried = materialize(measured(sampled(own.select("text"))))  # a condition moved below the measures would hold all their expressions
    order = ordered(tried.filter(~base_failed()), candidates)
    out = measured(own).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(out, order)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def survivors(judged: DataFrame) -> DataFrame:
    """The kept rows. The optimizer moves no condition below a random column; moved below the measures,
    the condition would hold all their expressions many times over and evaluate them as often."""
    return judged.withColumn("_fence", F.rand()).filter(F.when(F.col("_fence") >= 0, F.col("kept"))).drop("_fence")
