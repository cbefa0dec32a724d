"""Plain versions that several tests compare with."""

from collections import defaultdict

import numpy as np

from cohortlab.llm import arrow, toxicity


def line_brute(rows, min_docs=3, min_chars=20):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def check_packing(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def plain_features(text):
    """The features of a text, one by one: words, beginnings of words, pairs, pairs over a word."""
    whole = np.frombuffer((text or "").encode(), np.uint8)
    spans, start = [], None
    for i, b in enumerate([*whole.tolist(), 32]):
        inside = b >= 128 or chr(b).isalnum()
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            spans.append((start, i))
            start = None

    def hashed(a, b):
        part = whole[a:b]
        return int(arrow.FIRST.slices(arrow.FIRST.sums(part), np.array([0]), np.array([b - a]))[0])

    mix = lambda x: int(arrow.mix(np.array([x % 2**64], np.uint64))[0])
    odd, word, stem, pair, skip = (int(x) for x in (toxicity.ODD, toxicity.WORD, toxicity.STEM, toxicity.PAIR, toxicity.SKIP))
    words, out = [hashed(a, b) for a, b in spans], set()
    for i, (a, b) in enumerate(spans):
        out.add(words[i] * odd + word)
        out |= {hashed(a, a + n) * odd + stem for n in toxicity.STEMS if b - a >= n}
        for gap, kind in ((1, pair), (2, skip)):
            if i + gap < len(words):
                out.add((words[i] ^ mix(words[i + gap] + kind)) * odd)
    return {mix(x) >> (64 - toxicity.BITS) for x in out}
