"""Byte-pair encoding and decoding by traversal of a trie of distinct words."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cohortlab.llm import arrow

# Fixed value: how the vocabulary's pre-tokenizer parts a text.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
ODD_SPACE = regex.compile(r" \s| $|\s$")

#: Marks that are a word of their own after a letter.
MARKS = frozenset(".,;:!?")
#: Words, and pieces of one or more words, that a worker remembers between batches; beyond it all are forgotten.
MAX_WORDS, MAX_PIECES = 800_000, 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            out[chr(more)] = b
            more += 1
    return out


def check_vocabulary(path: str, part: str, wanted) -> None:
    """The code here stands for one way of parting texts; a file that parts them otherwise is refused."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)[part]
    if found != wanted:
        raise ValueError(f"{path}: unexpected {part} {found}")


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers file of the byte-level kind."""

    def __init__(self, path: str) -> None:
        check_vocabulary(path, "normalizer", None)
        check_vocabulary(path, "pre_tokenizer", PRE_TOKENIZER)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.ids = {raw(t): i for t, i in held["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(merges):
            left, right = self.ids[raw(a)], self.ids[raw(b)]
            whole = self.ids[raw(a) + raw(b)]
            self.rank[left, right] = (r, whole)
            self.parts.setdefault(whole, (r, left, right))
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        text = [b""] * size
        for t, i in self.ids.items():
            text[i] = t
        for t, i in self.special.items():
            text[i] = t.encode()
        self.length = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.packed = [int(i).to_bytes(4, "little") for i in range(size)]
        self.reach: dict[bytes, int] = {}  # longest token that ends in these three bytes
        for t in self.ids:
            if len(t) > 2:
                self.reach[t[-3:]] = max(self.reach.get(t[-3:], 2), len(t))
        self.known_fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """Encoding by the definition: merge the pair of lowest rank, the leftmost first, until none is left."""
        out = [self.ids[bytes([b])] for b in word]
        while len(out) > 1:
            rank, at = min((self.rank.get(pair, (len(self.rank),))[0], i) for i, pair in enumerate(zip(out, out[1:], strict=False)))
            if rank == len(self.rank):
                break
            out[at : at + 2] = [self.rank[out[at], out[at + 1]][1]]
        return out

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        known = self._whole.get(token)
        if known is None:
            at = self.start[token]
            known = self._whole[token] = self.merged(self.bytes[at : at + self.length[token]].tobytes()) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together.

        They do unless a merge across their border is due before the merges that make up the
        tokens beside it; taking the tokens apart from the outside in shows the first such merge.
        """
        key = (left, right)
        known = self.known_fits.get(key)
        if known is None:
            known = self.known_fits[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        limit = len(self.rank)
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined[0] < limit:
                return False
            a, b = self.parts.get(left, (-1,)), self.parts.get(right, (-1,))
            # The later of the two merges is undone first: at that time the other token was whole.
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True


def traverse(v: Vocabulary, words: list[bytes]) -> Iterator[list[int]]:
    """Encodings of sorted distinct words: the trie that they span, walked depth first.

    The path from the root holds, for each prefix, the last token of its encoding and where that
    token starts. The encoding of a prefix ends in the one token that fits after the encoding
    of what is before it, so a node follows from the nodes above it; the next word goes on
    from the prefix that it shares with the one before.
    """
    last, back, before = [-1], [0], b""
    token_at, known, reach = v.ids.get, v.known_fits, v.reach.get
    for word in words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del last[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            for start in range(max(0, end - reach(word[max(0, end - 3) : end], 2)), end):
                token = token_at(word[start:end])
                if token is not None:
                    if start:
                        fits = known.get((last[start], token))
                        if fits is None:
                            fits = v.fits(last[start], token)
                    else:
                        fits = v.whole(token)
                    if fits:
                        last.append(token)
                        back.append(start)
                        break
            else:
                raise ValueError("no token fits")
        before, at, out = word, len(word), []
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        yield out


class Codec:
    """Encoding and decoding of whole texts with one vocabulary; a worker keeps one per file."""

    kept: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.v.special, key=len, reverse=True))) if self.v.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _words_of(self, piece: str) -> list[str]:
        blank = " " + piece
        if piece.isalpha():
            return [blank]
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            return [blank[:-1], piece[-1]]
        return PARTS.findall(blank)

    def _learn(self, words: set[str]) -> None:
        """Ids of the words that are new, all in one traversal."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        raw = sorted(w.encode() for w in words if w not in self.words)
        packed = self.v.packed
        self.words.update(zip([w.decode() for w in raw], (b"".join([packed[t] for t in ids]) for ids in traverse(self.v, raw)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers."""
        # No word reaches over a blank before a visible character, so most texts fall into pieces that can be told by themselves.
        whole, cut = {}, {}
        for i, t in enumerate(texts):
            if self.special is not None and (found := list(self.special.finditer(t))):
                ends = [0, *(m.end() for m in found)]
                whole[i] = [(PARTS.findall(t[a : m.start()]), m[0]) for a, m in zip(ends, found, strict=False)] + [(PARTS.findall(t[ends[-1] :]), "")]
            elif ODD_SPACE.search(t):
                whole[i] = [(PARTS.findall(t), "")]
            else:
                first, *rest = t.split(" ")
                whole[i], cut[i] = [(PARTS.findall(first), "")], rest
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        new = set().union(*cut.values()) - self.pieces.keys()
        parted = {p: self._words_of(p) for p in new}
        self._learn({w for parts in parted.values() for w in parts} | {w for parts in whole.values() for ws, _ in parts for w in ws})
        known, special, packed = self.words, self.v.special, self.v.packed
        self.pieces.update((p, b"".join([known[w] for w in ws])) for p, ws in parted.items())
        ids_of = self.pieces.__getitem__
        return [b"".join([*(b"".join([*map(known.__getitem__, ws), packed[special[s]] if s else b""]) for ws, s in whole[i]), *map(ids_of, cut.get(i, ()))])
                for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8 (bytes that are none become the replacement character)."""
        length = self.v.length[ids]
        total = int(length.sum())
        at = np.arange(total) + np.repeat(self.v.start[ids] - np.cumsum(length) + length, length)
        return self.v.bytes[at].tobytes().decode("utf-8", "replace").encode()


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` (token ids as bytes, 4 each) and ``decoded`` of every text; a null text is empty.

    ``docs`` needs doc_id and text; other columns are left out. Every row is encoded by itself, so
    repeated rows repeat and no rows give none. ``path`` names the vocabulary on every worker.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.at(path)
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        ids = codec.encode(texts)
        decoded = [codec.decode(np.frombuffer(i, "<u4")).decode() for i in ids]
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return arrow.map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
