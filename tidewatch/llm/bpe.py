"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can come last in its
encoding. The table of these last tokens is filled from left to right, with the
tokens that end at a byte found by one automaton; reading it backwards gives the
ids. Appending bytes only adds entries, and after an edit everything before it
is still right."""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewatch.llm.common import by_slices

#: The public pattern, and what it means on texts of ASCII characters only (checked in the tests). Other patterns are used as passed.
PUBLIC_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: White space in the sense of the public tokenizers: Python also counts the four ASCII separators.
SEPARATORS = regex.compile("[\x1c-\x1f]")


class Recent(dict):
    """A cache of bounded size in two generations: once the young one is full
    it becomes the old one, and what is asked for again moves back."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Ranks, and for each token the nodes on the two edges of its merge tree."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self.shift = max(ranks.values()).bit_length()
        self.pairs = Recent(self._fits, 400_000)
        #: Only tokens that their own bytes encode to can occur.
        self.valid = {b: r for b, r in ranks.items() if self.alone(r)}
        self.most = max(map(len, self.valid))
        #: Finds all valid tokens that end at a byte, the longest first; bytes stand as characters 0 to 255.
        self.ends = ahocorasick.Automaton()
        for b, r in self.valid.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), r))
        self.ends.make_automaton()
        self.numerals = {r: str(r) for r in self.bytes}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and
        for tokens that merging their own bytes does not give."""
        if token not in self._parts:
            units = [self.ranks.get(self.bytes[token][i:i + 1]) for i in range(len(self.bytes[token]))]
            while len(units) > 2:
                best = min(((self.ranks.get(self.bytes[a] + self.bytes[b], token), i) for i, (a, b) in enumerate(zip(units, units[1:]))))
                if best[0] >= token:
                    break
                units[best[1]:best[1] + 2] = [best[0]]
            self._parts[token] = tuple(units) if len(units) == 2 else None
        return self._parts[token]

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        return len(self.bytes[token]) == 1 or self.parts(token) is not None

    def edge(self, token: int, side: int) -> tuple:
        """(bytes, rank at which the node disappears into its parent) from the
        token itself inwards, along its left (0) or right (1) edge."""
        memo = self._right if side else self._left
        if token not in memo:
            out, parent, at = [], 1 << 62, token
            while True:
                out.append((self.bytes[at], parent))
                pair = self.parts(at)
                if pair is None:
                    break
                parent, at = at, pair[side]
            memo[token] = tuple(out)
        return memo[token]

    def _fits(self, pair: int) -> bool:
        """Whether the two tokens stay as they are side by side: no merge over
        their border comes before both of the nodes it needs are used up. Equal
        ranks go from left to right."""
        get = self.ranks.get
        first, second = divmod(pair, 1 << self.shift)
        for left, left_gone in self.edge(first, 1):
            for right, right_gone in self.edge(second, 0):
                merge = get(left + right)
                if merge is not None and merge < left_gone and merge <= right_gone:
                    return False
        return True


class PrefixTable:
    """Last token of every prefix of a growing piece of bytes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b"", known: PrefixTable | None = None):
        """``known``: a table of a prefix of ``data`` to go on from."""
        self.vocab, self.data, self.last = (vocab, known.data, known.last[:]) if known else (vocab, b"", [-1])
        self.append(data[len(self.data):])

    def append(self, more: bytes) -> None:
        v = self.vocab
        begin, self.data = len(self.data), self.data + more
        last, pairs, shift = self.last, v.pairs, v.shift
        base = max(0, begin - v.most + 1)  # no token that ends in the new bytes starts before
        need = begin - base  # the byte whose prefix is to be filled next
        for end, (length, token) in v.ends.iter(self.data[base:].decode("latin-1")):
            if end == need and (length > end + base or pairs[last[end + base + 1 - length] << shift | token]):
                last.append(token)
                need += 1
        if len(last) != len(self.data) + 1:
            raise ValueError("the vocabulary lacks a byte")

    def edit(self, at: int, removed: int, new: bytes) -> None:
        """Replace ``removed`` bytes at ``at``; the table before stays."""
        tail = new + self.data[at + removed:]
        self.data, self.last = self.data[:at], self.last[:at + 1]
        self.append(tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocab.bytes[self.last[at]])
        return out[::-1]


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.vocab = Vocabulary.load(path)
        self.full = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.plain = re.compile(ASCII_PATTERN) if pattern == PUBLIC_PATTERN else None
        self.pieces = Recent(self._piece, 150_000)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocab.valid.get(data)
        if whole is not None:
            return (whole,)
        return tuple(PrefixTable(self.vocab, data).ids())

    def split(self, text: str) -> list[str]:
        return (self.plain if self.plain and text.isascii() and not SEPARATORS.search(text) else self.full).findall(text)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for piece in self.split(text or ""):
            out += pieces[piece]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.bytes.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """``docs`` plus an array of token ids. ``path`` is a vocabulary installed
    on every executor. Null and empty texts give no tokens. Each row stands by
    itself: no shuffle, and memory for one slice of rows."""
    names = [c for c in docs.columns if c != column]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        ids = pa.array([enc.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ids], names=[*names, column])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(by_slices(run), f"{ddl}, `{column}` array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``tokens`` plus the bytes that ``ids`` stand for; null ids give no bytes."""
    names = [c for c in tokens.columns if c != column]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        data = pa.array([enc.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), data], names=[*names, column])

    return tokens.mapInArrow(by_slices(run), f"{ddl}, `{column}` binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the bytes they decode
    to. Encoding and decoding happen in one pass, so the ids never leave the
    Python worker."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        n, ids_hash, text_hash = [], [], []
        for text in batch.column("text").to_pylist():
            ids = enc.encode(text)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(" ".join(map(enc.vocab.numerals.__getitem__, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(by_slices(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def verified(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` plus ids, n_tokens and intact (the ids decode to the text's
    bytes). One pass and one encoder per worker."""
    added = ("ids", "n_tokens", "intact")
    names = [c for c in docs.columns if c not in added]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in added)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        texts = batch.column("text").to_pylist()
        ids = [enc.encode(t) for t in texts]
        intact = [enc.decode(i) == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(intact, pa.bool_())], names=[*names, *added])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(by_slices(run, 64), f"{ddl}, ids array<int>, n_tokens long, intact boolean")
