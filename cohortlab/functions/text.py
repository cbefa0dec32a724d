"""Text normalisation and token matching."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def normalize_text(col: Column, hyphens: bool = False) -> Column:
    """Lower case, ``_`` (and ``-`` when ``hyphens``) to blanks, blanks collapsed."""
    spaced = F.translate(F.lower(col), "_-" if hyphens else "_", "  " if hyphens else " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def joined_text(cols: list[Column], hyphens: bool = False) -> Column:
    """Non-null texts joined by a blank, then normalised."""
    return normalize_text(F.concat_ws(" ", *cols), hyphens)


def contains_any(col: Column, tokens) -> Column:
    """True when any token occurs anywhere in the text (no word boundaries).

    One pattern, so that the text expression appears once in the plan.
    """
    return F.rlike(col, F.lit("|".join(re.escape(t) for t in tokens)))


def matched_tokens(col: Column, tokens) -> Column:
    """The tokens that occur in the text, in list order.

    Written out per token rather than as a lambda, so that the text expression is
    evaluated once per row.
    """
    return F.array_compact(F.array(*[F.when(F.contains(col, F.lit(t)), F.lit(t)) for t in tokens]))
