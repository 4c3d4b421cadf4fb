"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

The bytes of a text become Latin-1 characters, so that pyahocorasick finds in
one pass the longest vocabulary entry that starts at each byte. Encoding goes
from longest match to longest match and backtracks wherever two neighbours
could not stand side by side after the merges; whether they can is worked out
once per pair, by the merges themselves, and remembered. The outcome equals
the merges' exactly, in time linear in the text's length.
"""

from __future__ import annotations

import base64

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import append_columns, claim

#: Entries that a worker's tables of words and of pairs may hold; a full table starts afresh.
WORDS, PAIRS = 300_000, 1_000_000
#: White space next to a space. Elsewhere each space starts a match, so the text can be cut there.
ODD = regex.compile(r" \s|[^\S ] ")


class ByteBPE:
    """One vocabulary of ranks. Every byte must have a rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.length = {i: len(b) for b, i in self.ranks.items()}
        self.raw = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.split = regex.compile(pattern).findall
        self.matches = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.matches.add_word(b.decode("latin1"), (len(b) - 1, i))
        self.matches.make_automaton()
        self.prefix: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merged(self, text: bytes) -> list[int]:
        """The merges carried out one by one; for single entries and pairs of them only."""
        rank, none = self.ranks.get, 1 << 62
        parts = [text[i : i + 1] for i in range(len(text))]
        joined = [rank(text[i : i + 2], none) for i in range(len(text) - 1)]
        while joined and (best := min(joined)) < none:
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def fits(self, last: int, token: int) -> bool:
        """Whether the merges leave `token` whole after `last` (-1: at the start)."""
        key = (last, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            head = self.bytes_of[last] if last >= 0 else b""
            known = self.pairs[key] = self.merged(head + self.bytes_of[token]) == ([last] if last >= 0 else []) + [token]
        return known

    def shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of `token`, or -1."""
        if (known := self.prefix.get(token)) is None:
            b = self.bytes_of[token]
            known = self.prefix[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return known

    def encode_part(self, part: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(part)) is not None:
            return [whole]
        n = len(part)
        longest = [-1] * n
        for end, (less, token) in self.matches.iter(part.decode("latin1")):
            longest[end - less] = token
        length, pairs = self.length, self.pairs
        usable, out, at, ahead, last = bytearray(b"\1") * (n + 1), [], 0, longest[0], -1
        while at < n:
            token = ahead
            while True:
                end = at + length[token]
                if usable[end] and ((ok := pairs.get((last, token))) or ok is None and self.fits(last, token)):
                    out.append(token)
                    at, last = end, token
                    if end < n:
                        ahead = longest[end]
                    break
                if (token := self.shorter(token)) < 0:
                    usable[at] = 0
                    ahead = out.pop()
                    at -= length[ahead]
                    last = out[-1] if out else -1
                    break
        return out

    def _part(self, part: str) -> bytes:
        if (known := self.parts.get(part)) is None:
            if len(self.parts) >= WORDS:
                self.parts.clear()
            known = b"".join(map(self.raw.__getitem__, self.encode_part(part.encode())))
            if len(part) <= 64:
                self.parts[part] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if ODD.search(text):
            return b"".join(map(self._part, self.split(text)))
        first, *rest = text.split(" ")
        out, words = [*map(self._part, self.split(first))], self.words
        for word in rest:
            if (known := words.get(word)) is None:
                if len(words) >= WORDS:
                    words.clear()
                known = self._part(" " + word) if word.isalpha() else b"".join(map(self._part, self.split(" " + word)))
                if len(word) <= 64:
                    words[word] = known
            out.append(known)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """The vocabulary, built once per worker process."""
    claim("byte_bpe", _LOADED.clear)
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", decode: bool = False) -> DataFrame:
    """docs with `ids` (binary, little-endian unsigned 32-bit), and with decode `decoded` (binary: the bytes that the ids stand for).

    A null or empty text has no ids. Rows are independent: equal rows get equal
    ids, an empty table stays empty, and a column of docs named `ids` or
    `decoded` is replaced. Texts are never cut, however long.
    """

    def make(chunks):
        bpe = load(ranks_path, pattern)
        for (texts,) in chunks:
            ids = [bpe.encode(t or "") for t in texts]
            yield [ids, [bpe.decode(x) for x in ids]] if decode else [ids]

    fields = [("ids", T.BinaryType()), *[("decoded", T.BinaryType())] * decode]
    return append_columns(docs, [text], make, fields, rows=256)


def decode_documents(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """rows with `decoded` (binary) from `ids`; null ids decode to no bytes."""

    def make(chunks):
        bpe = load(ranks_path, pattern)
        for (ids,) in chunks:
            yield [[bpe.decode(x or b"") for x in ids]]

    return append_columns(rows, ["ids"], make, [("decoded", T.BinaryType())], rows=256)
