"""Parsers for clinical markers. Those that can fail give a value and an error flag."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortlab.functions.context import Value
from cohortlab.functions.numeric import text_number
from cohortlab.functions.text import contains_any

# Words that mean "not known" (whole-text match).
UNKNOWN_MARKER = ("", "unknown", "unspecified", "not specified", "not assessed", "not tested",
                  "pending", "n/a", "na", "none", "missing")
UNKNOWN_IMAGING = ("", "unknown", "unspecified", "not specified", "not assessed", "n/a", "na",
                   "none", "missing")
# Status tokens, negative ones are tested first.
NEGATIVE = ("negative", "wild type", "wild-type", "wildtype", "proficient", "no mutation",
            "not detected", "hrd-", "-")
POSITIVE = ("positive", "pathogenic", "mutated", "mutation", "variant detected", "deficient",
            "hrd+", "+")
# Imaging quality words, low ones are tested first.
LOW_QC = ("low", "poor", "fail", "failed", "motion", "artifact", "manual review", "uncertain")
HIGH_QC = ("high", "good", "excellent", "pass", "passed")


def unknown(v: Value, words=UNKNOWN_MARKER, hyphens: bool = False) -> Column:
    """Absent, null or a word for unknown."""
    return v.missing | F.coalesce(v.folded(hyphens).isin(*words), F.lit(False))


def percent_number(v: Value) -> Column:
    """Number, numeric text or ``n%``, of any size."""
    return F.when(v.kind.isin("NUMBER", "TEXT"), text_number(F.replace(v.text, F.lit("%"), F.lit(""))))


def percent(v: Value, parsed: Column | None = None) -> tuple[Column, Column]:
    """Number, numeric text or ``n%`` in 0..100; ``parsed`` is the column that holds its ``percent_number``, if there is one."""
    parsed = percent_number(v) if parsed is None else parsed
    ok = F.coalesce(parsed.between(0.0, 100.0), F.lit(False))
    return F.when(ok, parsed), ~ok & ~unknown(v)


def grade(v: Value) -> tuple[Column, Column]:
    """Grade 1..3 from an integer, an integral number, a roman numeral or text."""
    t = v.folded()
    parsed = (F.when(v.kind == "NUMBER", F.when(v.number.isin(1.0, 2.0, 3.0), v.number.cast("int")))
              .when(v.kind == "TEXT",
                    F.when(t == "i", 1).when(t == "ii", 2).when(t == "iii", 3)
                    .otherwise(F.nullif(F.regexp_extract(t, r"\b([123])\b", 1), F.lit("")).cast("int"))))
    return parsed, parsed.isNull() & ~unknown(v)


def status(v: Value, word_boundary: bool = False) -> Column:
    """positive, negative, unknown; NULL when absent or null.

    A bare hyphen counts as negative, so ``BRCA1-positive`` reads as negative. With
    ``word_boundary`` the bare ``-`` and ``+`` must end the text instead.
    """
    t = v.folded()
    if word_boundary:
        negative = contains_any(t, NEGATIVE[:-1]) | F.endswith(t, F.lit("-"))
        positive = contains_any(t, POSITIVE[:-1]) | F.endswith(t, F.lit("+"))
    else:
        negative, positive = contains_any(t, NEGATIVE), contains_any(t, POSITIVE)
    return (F.when(v.missing, F.lit(None).cast("string"))
            .when(v.kind == "BOOLEAN", F.when(v.text == "true", "positive").otherwise("negative"))
            .when(t.isin(*UNKNOWN_MARKER), "unknown").when(negative, "negative")
            .when(positive, "positive").otherwise("unknown"))


def unit_number(v: Value) -> Column:
    """A number within 0..1, else NULL."""
    return F.when(v.number.between(0.0, 1.0), v.number)


def qc_level(v: Value) -> Column:
    """high, medium, low from a 0..1 number or from words; NULL when neither tells."""
    n, t = unit_number(v), v.folded(hyphens=True)
    return (F.when(n >= 0.80, "high").when(n < 0.50, "low").when(n.isNotNull(), "medium")
            .when(contains_any(t, LOW_QC), "low").when(contains_any(t, HIGH_QC), "high"))


def optional_number(v: Value, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """Number or numeric text, NULL when unknown; an error for anything else."""
    ok = v.number.isNotNull()
    if low is not None:
        ok = ok & (v.number >= low)
    if high is not None:
        ok = ok & (v.number <= high)
    ok = F.coalesce(ok, F.lit(False))
    return F.when(ok, v.number), ~ok & ~unknown(v, UNKNOWN_IMAGING, hyphens=True)
