"""Byte-level BPE with a backtracking encoder, and decoding through an offset table.

Longest token matches come from an Aho-Corasick automaton over the vocabulary.  A match is accepted
if it is compatible with the token before it, that is, if merging the two tokens' bytes by rank
gives back just these two; otherwise the next shorter token is tried, and when none is left the
previous token is taken back.  A bit per position keeps dead ends from being tried twice, so the
work is linear.  Pairwise compatible tokens are exactly the result of merging by rank.

Null text is empty: no tokens.  Texts of any length are cut only where the vocabulary's own
pattern cuts them.  Repeated rows and null ids keep one result each.

An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from sigloom.llm.common import by_batch, texts
from sigloom.llm.tokens import Cache

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's file.

    Bytes that print in Latin-1 stand for themselves, the others for the letters from 256 on.
    """
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in printing else next(others)): b for b in range(256)}


class Vocabulary:
    """Token bytes by id, an id being the token's merge rank, and tables derived from them."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix(token) for token in tokens]
        #: Left and right part a token was merged from; a single byte is its own part.
        self.left = list(range(len(tokens)))
        self.right = list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for i, token in enumerate(tokens):
            if len(token) > 1:
                parts = self._parts(token, i)
                self.left[i], self.right[i] = parts
                self.merged[parts] = i
        self.compatible = Cache(self._compatible, 2_000_000)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizer file whose ids are in the order of the merges."""
        with open(path, encoding="utf-8") as file:
            ids = json.load(file)["model"]["vocab"]
        letters, tokens = _byte_letters(), [b""] * len(ids)
        for token, i in ids.items():
            tokens[i] = bytes(letters[c] for c in token)
        return cls(tokens)

    def _longest_prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.rank.get(token[:n])) is not None:
                return i
        return -1

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        """The last two symbols when the token's bytes are merged by ranks below its own."""
        symbols = [self.rank[bytes([b])] for b in token]
        while len(symbols) > 2:
            pairs = [
                self.rank.get(self.tokens[a] + self.tokens[b], rank)
                for a, b in zip(symbols, symbols[1:])
            ]
            best = min(pairs)
            if best >= rank:
                raise ValueError(f"token {rank} cannot be merged from lower ranks")
            k = pairs.index(best)
            symbols[k : k + 2] = [best]
        return symbols[0], symbols[1]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether two neighbouring tokens stay apart.

        Undo merges in reverse order on both sides of the seam: at every step the two symbols
        touching it must not form a token that would have been merged before the younger of the
        two merges that removed them.
        """
        a, b = pair
        before = len(self.tokens)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                return False
            part_a, part_b = self.right[a], self.left[b]
            if a > b and part_a != a or part_b == b:
                if part_a == a:
                    return True
                # On equal rank the left merge comes first, so the seam sees it as the younger.
                before, a = a, part_a
            else:
                before, b = b + 1, part_b

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # later matches of one start are longer
        tokens, shorter, compatible = self.tokens, self.shorter, self.compatible
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + len(tokens[token])
            if open_at[end] and (not out or compatible[out[-1], token]):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(tokens[token])
        return out


class Tokenizer:
    """Splits text by the vocabulary's pattern and encodes each piece once."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary.load(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = Cache(lambda piece: self._joined(self.vocabulary.encode_piece(piece.encode())))
        self.first = Cache(self._unit)
        self.after_space = Cache(lambda unit: self._unit(unit, " "))
        blob = [*self.vocabulary.tokens, SPECIAL.encode()]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in blob])])

    @staticmethod
    def _joined(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _unit(self, unit: str, space: str = "") -> bytes:
        """Ids of text without white space inside; a space before it belongs to its first piece."""
        if not unit or _ANY_SPACE.search(unit):
            raise _Spacing
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(space + unit)))

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text; the special token's own text becomes its id."""
        parts = text.split(SPECIAL)
        special = self._joined([SPECIAL_ID])
        return np.frombuffer(special.join(map(self._ordinary, parts)), "<u4")

    def _ordinary(self, text: str) -> bytes:
        # Single spaces and single line ends, the usual case: pieces never reach across them.
        if not text:
            return b""
        try:
            lines = []
            for line in text.split("\n"):
                units = line.split(" ")
                lines.append(
                    self.first[units[0]]
                    + b"".join(map(self.after_space.__getitem__, units[1:]))
                )
            return self.pieces["\n"].join(lines)
        except _Spacing:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: each token's stretch of the blob, found through the offset table."""
        out = []
        for k in range(0, len(ids), 1 << 20):
            some = ids[k : k + (1 << 20)].astype(np.int64)
            starts = self.offsets[some]
            lengths = self.offsets[some + 1] - starts
            shift = starts - (np.cumsum(lengths) - lengths)
            out.append(self.blob[np.arange(lengths.sum()) + np.repeat(shift, lengths)].tobytes())
        return b"".join(out)


class _Spacing(Exception):
    """White space that joins pieces in another way; the whole text goes through the pattern."""


_ANY_SPACE = re.compile(r"\s|[\x1c-\x1f\x85]")


@functools.lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _digests(batch, path: str) -> dict[str, list]:
    own = tokenizer(path)
    counts, ids_sha, decoded_sha = [], [], []
    for text in texts(batch):
        ids = own.encode(text)
        counts.append(len(ids))
        ids_sha.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
        decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
    return {
        "doc_id": batch.column("doc_id"),
        "n_tokens": counts,
        "ids_sha256": ids_sha,
        "decoded_sha256": decoded_sha,
    }


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded text."""
    return by_batch(
        docs.select("doc_id", "text"),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        _digests,
        path or default_vocabulary(),
    )


def _encoded(batch, path: str) -> dict[str, list]:
    own = tokenizer(path)
    return {"doc_id": batch.column("doc_id"), "ids": [own.encode(t).tolist() for t in texts(batch)]}


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids of each text."""
    return by_batch(
        docs.select("doc_id", "text"), "doc_id long, ids array<int>", _encoded,
        path or default_vocabulary(),
    )


def _decoded(batch, path: str) -> dict[str, list]:
    own = tokenizer(path)
    return {
        "doc_id": batch.column("doc_id"),
        "text": [
            own.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace")
            for ids in batch.column("ids").to_pylist()
        ],
    }


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of each list of token ids; ids outside the vocabulary are an error."""
    return by_batch(
        ids.select("doc_id", "ids"), "doc_id long, text string", _decoded,
        path or default_vocabulary(),
    )
