"""Packing of token sequences: bounded-space online best fit.

Each partition keeps at most `open_windows` windows of `size` tokens open. A
document's whole windows are cut off first; its rest goes to the open window
that it fills best. Where none has room, the fullest is emitted and a new one
opened. The windows that stay open at a partition's end are merged in rounds
of `fan_in` partitions: nearly full ones are emitted, the others are laid end
to end and cut at the window's size, and what is left of the last round is cut
into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, claim

#: Bytes (as reckoned) that a worker's table of words may hold; a full table starts afresh. Longer words are not held.
HELD, LONGEST = 96 << 20, 64
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordBPE:
    """A tokenizers file, encoded by distinct words where its normaliser and splitter are those known here, else by the library alone.

    Texts are cut at spaces and line ends, which no token of such a vocabulary
    spans. Words are normalised and split here and merged by the library's
    model; those with unusual characters go through the library whole.
    """

    #: Characters that every version of Unicode takes for the same kind, also in lower case.
    KNOWN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
    #: What a file must say for words to be normalised and split here.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
    SPLITTER = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    #: The characters that stand for bytes: printable ones for themselves, the others counted on from 256.
    BYTES = dict(zip([b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)], range(256, 512)))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.by_word = (told["normalizer"], told["pre_tokenizer"], told["model"]["type"]) == (self.NORMALIZER, self.SPLITTER, "BPE") and not told["truncation"]
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.full.encode_special_tokens = True
        self.merge = self.full.model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.full.get_vocab().values()) + 1)]
        self.marks = {c: self.part(c) for c in ".,;:!?"}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def part(self, part: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.merge(part if part.isascii() else part.encode().decode("latin1").translate(self.BYTES))])

    def word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self.part(word.lower())
            if word[-1:] in self.marks and (head := word[:-1]).isalpha():
                return self.part(head.lower()) + self.marks[word[-1]]
        if not self.KNOWN(word):
            return self.whole(word)
        word = unicodedata.normalize("NFC", word)
        word = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        return b"".join(map(self.part, self.PARTS(word)))

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [self.whole(t) for t in texts]
        out = []
        for text in texts:
            known = self.words
            if self.held > HELD:
                known.clear()
                self.held = 0
            split = text.replace("\n", " ").split(" ")
            ids = list(map(known.get, split))
            if None in ids:
                for at, w in enumerate(split):
                    if ids[at] is None:
                        if (raw := known.get(w)) is None:
                            raw = self.word(w)
                            if len(w) <= LONGEST:
                                known[w] = raw
                                self.held += 190 + len(w) + len(raw)
                        ids[at] = raw
            out.append(b"".join(ids))
        return out


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    claim("packing", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def add(self, piece: tuple) -> list[list[tuple]]:
        """Place a piece of at most `size` tokens; the windows emitted."""
        need, out = len(piece[2]) // 4, []
        at = bisect_left(self.room, (need, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                out.append(self.held.pop(self.room.pop(0)[1]))
            room, window = self.size, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append(piece)
        if room == need:
            out.append(self.held.pop(window))
        else:
            insort(self.room, (room - need, window))
        return out


def cut(pieces: list[tuple], lengths: list[int]) -> list[list[tuple]]:
    """Pieces laid end to end and cut into windows of these lengths, which sum up to all tokens."""
    out, left = [], list(reversed(pieces))
    for want in lengths:
        window: list[tuple] = []
        while want:
            doc, start, ids, total = left.pop()
            take = min(want, len(ids) // 4)
            window.append((doc, start, ids[: take * 4], total))
            if take * 4 < len(ids):
                left.append((doc, start + take, ids[take * 4 :], total))
            want -= take
        out.append(window)
    return out


def merged(windows: list[list[tuple]], size: int, near: float, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows emitted, and the pieces (fewer tokens than `size`) that are left; none are in the last round."""
    fill = [sum(len(p[2]) // 4 for p in w) for w in windows]
    out = [w for w, n in zip(windows, fill) if n >= near * size]
    rest = [p for w, n in zip(windows, fill) if n < near * size for p in w]
    total = sum(n for n in fill if n < near * size)
    whole, tail = [size] * (total // size), total % size
    if last:
        return out + cut(rest, whole + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]), []
    *full, left = cut(rest, whole + [tail])
    return out + full, left


def _rows(windows: list[tuple[int, list[tuple]]]) -> list[list]:
    cols: list[list] = [[] for _ in range(7)]
    for number, window in windows:
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            for col, x in zip(cols, (doc, start, n, ids, total, number, offset)):
                col.append(x)
            offset += n
    return cols


def _batch(cols: list[list], **more) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    arrays = [pa.array(c, t) for c, t in zip(cols, types)]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.array([x] * len(cols[0]), t) for x, t in more.values()]], names=[*names, *more])


def _merge(size: int, near: float, level: int, last: bool):
    """One round's merge of a group's open windows; a group has at most fan_in * open_windows of them."""

    def merge(key, rows):
        group = key[0].as_py()
        rows = rows.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        windows: dict[tuple, list[tuple]] = {}
        for r in zip(*(rows.column(c).to_pylist() for c in ("part", "sequence_id", "doc_id", "start", "ids", "doc_tokens"))):
            windows.setdefault(r[:2], []).append(r[2:])
        full, left = merged(list(windows.values()), size, near, last)
        base = level << 58 | group << 32
        batches = [_batch(_rows([(base + k, w) for k, w in enumerate(full)]), part=(group, pa.int32()), left=(False, pa.bool_()))]
        if left:
            batches.append(_batch(_rows([(0, left)]), part=(group, pa.int32()), left=(True, pa.bool_())))
        return pa.Table.from_batches(batches)

    return merge


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 2048, open_windows: int = 64, fan_in: int = 64, near: float = 0.99, text: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (none for a null or empty one),
    then end_id. Every id lies in exactly one piece; a sequence's pieces have
    gapless offsets from 0. docs needs an integer doc_id (nulls and repeated
    ones are kept: every row is packed) and `text`; other columns are left out,
    so that their names can't clash.
    An empty table gives no rows. Sequences shorter than `size` are to be
    padded, unless their length is a power of two.

    The rows are written once to the shared folder, as two readers follow: the
    sequences done and the windows left open, of which there are at most
    open_windows a partition.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        bpe, part = load(tokenizer_path), TaskContext.get().partitionId()
        windows, number, done, held = Windows(size, open_windows), part << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(k).slice(at, 256).to_pylist() for k in (0, 1))
                for doc, raw in zip(ids, bpe.encode([t or "" for t in texts])):
                    raw += end
                    total, begin = len(raw) // 4, 0
                    while begin < total:
                        piece = (doc, begin, raw[begin * 4 : (begin + size) * 4], total)
                        for window in [[piece]] if total - begin >= size else windows.add(piece):
                            done.append((number, window))
                            number += 1
                            held += size
                        begin += size
                if held > 1 << 20:
                    yield _batch(_rows(done), part=(part, pa.int32()), left=(False, pa.bool_()))
                    done, held = [], 0
        yield _batch(_rows(done), part=(part, pa.int32()), left=(False, pa.bool_()))
        yield _batch(_rows(list(windows.held.items())), part=(part, pa.int32()), left=(True, pa.bool_()))

    first = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{PIECE}, part int, left boolean"), "windows")
    names = first.columns[:7]
    out = first.where("not left").select(names)
    parts = (first.agg(F.max("part")).first()[0] or 0) + 1
    rest, level = first.where("left").select(*names, "part"), 1
    while True:
        groups = -(-parts // fan_in)
        last = groups == 1

        step = rest.withColumn("grp", F.floor(F.col("part") / fan_in).cast("int")).groupBy("grp").applyInArrow(_merge(size, near, level, last), f"{PIECE}, part int, left boolean")
        if last:
            return out.unionByName(step.select(names))
        step = scratch.keep(step, f"level{level}")
        out = out.unionByName(step.where("not left").select(names))
        rest, parts, level = step.where("left").select(*names, "part"), groups, level + 1
