"""Byte-level BPE by prefix dynamic programming, and decoding.

For each byte prefix of a piece exactly one token can be the last of its encoding: the one that forms a
valid pair with the last token of the prefix before it. Storing that token for each prefix encodes in time
linear in the piece, lets bytes be appended exactly, and lets an edit be re-encoded near where it is.

Null texts count as empty (no ids). Texts and pieces of any length are encoded whole; repeated rows give
repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import DataFrame

from .common import Memo, map_rows, whole_text

NONE = 1 << 30


class Vocabulary:
    """Ranks, how each token splits into the two it is merged from, and which pairs may stand side by side."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.longest = max(map(len, self.ranks))
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs = Memo(self._pair)
        for token in self.tokens:  # by rank: a token's parts come before it
            if len(token) > 1:
                self._split(token)
        self.pairs.clear()
        self.machine = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.machine.add_word(token.decode("latin-1"), (rank, len(token)))
        self.machine.make_automaton()

    def _split(self, token: bytes) -> None:
        rank = self.ranks[token]
        for at in range(1, len(token)):
            a, b = self.ranks.get(token[:at], NONE), self.ranks.get(token[at:], NONE)
            if a < rank and b < rank and self._pair((a, b)):
                self.left[rank], self.right[rank] = a, b
                self.merged[a, b] = rank
                return

    def _pair(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both tokens ends in just these two: undo the later of the two
        merges step by step; at no step may the tokens at the seam merge before what holds them apart."""
        a, b = pair
        before = NONE
        while True:
            if self.merged.get((a, b), NONE) < before:
                return False
            if a > b and self.right[a] != a:
                a, before = self.right[a], a
            elif self.left[b] != b:
                b, before = self.left[b], b + 1
            elif self.right[a] != a:
                a, before = self.right[a], a
            else:
                return True


class Prefixes:
    """The encoding of a byte string that may grow or change: ``last[i]`` is the last token of the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the prefixes so far keep their tokens."""
        at = len(self.data)
        self.data += more
        self._encode(at, len(self.data))

    def _encode(self, at: int, upto: int) -> None:
        """The last tokens of the prefixes of ``at + 1`` to ``upto`` bytes; no token begins further back than the longest."""
        back = max(0, at - self.v.longest)
        v, last, pairs = self.v, self.last, self.v.pairs
        last += [-1] * (upto - at)
        for end, (rank, size) in v.machine.iter(self.data[back:upto].decode("latin-1")):
            end += back + 1
            if end > at and last[end] < 0 and size <= end and (size == end or pairs[last[end - size], rank]):
                last[end] = rank

    def replace(self, start: int, end: int, new: bytes) -> int:
        """``data[start:end]`` becomes ``new``. Prefixes before ``start`` keep their tokens, and behind the edit only as
        many are encoded again as it takes until as many bytes as the longest token has, one after another, have the
        tokens they had: all later ones depend on these alone. Returns how many prefixes were encoded."""
        was, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = was[: start + 1]
        seam, n, run = start + len(new), len(self.data), 0  # run: how many of the last prefixes have the token they had
        at = start
        while at < n and run < self.v.longest:
            upto = min(n, max(seam, at) + self.v.longest)
            self._encode(at, upto)
            for i in range(max(seam, at) + 1, upto + 1):
                run = run + 1 if self.last[i] == was[i - shift] else 0
            at = upto
        self.last += was[at - shift + 1 :]
        return at - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.v.tokens[out[-1]])
        return out[::-1]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_piece(v: Vocabulary, piece: bytes) -> list[int]:
    whole = v.ranks.get(piece)
    return [whole] if whole is not None else Prefixes(v, piece).ids()


class Encoder:
    """Splits texts by a pattern and encodes each match; common ones are encoded once."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.v, self.find = vocabulary(path), regex.compile(pattern).findall
        self.pieces = Memo(self._piece, 128 << 20)

    def _piece(self, piece: str) -> bytes:
        ids = encode_piece(self.v, piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        packed = self.packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for a worker process, shared by its tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the general form, ids as a list."""

    def make():
        enc = encoder(path, pattern)
        return lambda b: {"doc_id": b["doc_id"], "ids": [enc.encode(t) for t in b["text"]]}

    return map_rows(docs, ["doc_id", whole_text().alias("text")], "doc_id long, ids array<int>", make)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the count and digest of its ids and the digest of what they decode to."""

    def make():
        enc = encoder(path, pattern)

        def step(b):
            n, ids_sha, text_sha = [], [], []
            for text in b["text"]:
                packed = enc.packed(text)
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(memoryview(packed).cast("I"))).hexdigest())
            return {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return step

    return map_rows(docs, ["doc_id", whole_text().alias("text")], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
