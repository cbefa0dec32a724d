"""URL filters: rules indexed by their rarest literal token, so that a URL meets few rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm import arrow

TOKEN = "[a-z0-9]+"
#: Rules at most, so that the index on every worker stays below about 100 MB.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``name`` is what results show, ``regex`` runs on ``host`` + "/" + ``path`` (a host has no slash), ``tokens`` are
    whole tokens of every URL it fits, ``rank`` decides between fitting rules (the larger wins)."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    pattern: bool = False


def site(host: str, path: str, verdict: str) -> Rule:
    """Fits the host, all its subdomains, and paths that start with ``path``."""
    tokens = re.findall(TOKEN, host.lower())
    # The last token of a path prefix may go on in the URL, so it is no whole token.
    tokens += [m[0] for m in re.finditer(TOKEN, path.lower()) if m.end() < len(path)]
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host.lower())}/{re.escape(path)}", tuple(tokens), len(host + path))


def pattern(regex: str, verdict: str, *tokens: str) -> Rule:
    """A free pattern; it never shows as a rule, and any site rule goes before it."""
    return Rule(regex, verdict, regex, tokens, -1, True)


def host() -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty without ``://``."""
    found = F.regexp_extract("url", r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path() -> Column:
    return F.coalesce(F.regexp_extract("url", r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens() -> Column:
    """Distinct tokens of host and path (A-Z in the path as in the URL and folded)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit(TOKEN), 0))


def frequencies(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    known = F.array(*[F.lit(t) for t in wanted]) if len(wanted) < 1000 else F.from_json(F.lit("[" + ",".join(f'"{t}"' for t in wanted) + "]"), "array<string>")
    counts = urls.select(F.explode(F.array_intersect(tokens(), known)).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and those that have none and always run."""
    by, always = {}, []
    for i, r in enumerate(rules):
        if r.tokens:
            by.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return by, always


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``pages`` with host, path, ``rule`` and ``verdict`` (and ``n_tried``: regular expressions run).

    Needs a column ``url``; columns host, path, rule, verdict and n_tried are replaced. The longest
    fitting site rule decides and shows in ``rule``; without one, ``rule`` is null and a fitting
    pattern decides (block before allow), else ``default``. Null urls and urls without ``://``
    have an empty host and path.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    arrow.prepare(pages.sparkSession)
    parted = pages.withColumn("host", host()).withColumn("path", path())
    by, always = index(rules, frequencies(parted, rules))
    held = pages.sparkSession.sparkContext.broadcast((rules, by, always))
    memo: dict[int, re.Pattern] = {}

    def fits(rule: int, what: str) -> bool:
        if rule not in memo:
            memo[rule] = re.compile(held.value[0][rule].regex)
        return memo[rule].search(what) is not None

    def verdict(hosts, paths):
        out = []
        rules, by, always = held.value
        for h, p in zip(hosts, paths, strict=True):
            what = f"{h}/{p}"
            tried = [i for t in set(re.findall(TOKEN, what.lower())) for i in by.get(t, ())] + always
            fit = [rules[i] for i in tried if fits(i, what)]
            sites = [r for r in fit if not r.pattern]
            if sites:
                best = max(sites, key=lambda r: (r.rank, r.name))
                out.append((best.name, best.verdict, len(tried)))
            else:
                own = {r.verdict for r in fit}
                out.append((None, "block" if "block" in own else "allow" if "allow" in own else default, len(tried)))
        return out

    @F.arrow_udf("struct<rule string, verdict string, n_tried int>")
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        rows = verdict(hosts.to_pylist(), paths.to_pylist())
        rule, said, tried = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(said, pa.string()), pa.array(tried, pa.int32())], ["rule", "verdict", "n_tried"])

    return parted.withColumn("_judged", judged("host", "path")).withColumns({c: F.col(f"_judged.{c}") for c in ("rule", "verdict", "n_tried")}).drop("_judged")
