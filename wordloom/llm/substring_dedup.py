"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences and clauses, at the marks of European and East
Asian writing; where one has more than LONG words, it is cut after words that
are chosen by their content, so that texts without marks fall into the same
parts wherever they share a passage. From each part begins a span: the shortest
run of at least `run` of them with at least `words` words. In writing without
blanks every character is a word. The 128-bit hashes of all spans meet globally;
of equal spans the first (smallest doc_id, then place) stays, and every part
that another one covers is removed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, append_columns, claim, unused

MARKS = ".!?,;:\u3002\uff01\uff1f\u3001\uff0c\uff1b\uff1a"
UNIT_PATTERN = f"[^{MARKS}\n]*(?:[{MARKS}\n]+\\s*|$)"
#: Chinese, Japanese, Thai, Lao, Burmese and Khmer.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff65\U00020000-\U0003ffff"
WORD_PATTERN = f"(?:[{SPACELESS}]|[^\\s{SPACELESS}]+)"
UNIT, WORD, TOKEN = (re.compile(p).findall for p in (UNIT_PATTERN, WORD_PATTERN, f"\\s*{WORD_PATTERN}\\s*"))
ANY_SPACELESS = re.compile(f"[{SPACELESS}]").search
#: Parts of more words than this are cut after each word whose first character's code is divisible by CUT.
LONG, CUT = 24, 5
RUN, WORDS = 2, 25
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LAST = (1 << 63) - 1


def words_in(text: str) -> list[str]:
    return text.split() if text.isascii() or not ANY_SPACELESS(text) else WORD(text)


def units(text: str) -> list[str]:
    """Sentences, clauses and parts of long ones with what follows them; joined, they are the text."""
    out = []
    # Words with blanks between them take two characters each at least.
    dense = not text.isascii() and ANY_SPACELESS(text) is not None
    short = LONG if dense else 2 * LONG
    for unit in UNIT(text):
        if len(unit) <= short or (not dense and len(unit.split()) <= LONG) or len(tokens := TOKEN(unit)) <= LONG:
            if unit:
                out.append(unit)
            continue
        part = ""
        for token in tokens:
            part += token
            if ord(token.lstrip()[0]) % CUT == 0:
                out.append(part)
                part = ""
        if part:
            out.append(part)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _room(n: int) -> None:
    if not _POWERS or n > len(_POWERS[0][0]):
        _POWERS[:] = [(_powers(b, 2 * n + 1024), _powers(pow(b, -1, 1 << 64), 2 * n + 1024)) for b in BASES]


def spans(parts: list[str], run: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start: the two halves of the span's hash, and the part after it (0: there is no span, as too little follows)."""
    n = len(parts)
    _room(n)
    split = [words_in(p) for p in parts]
    digests = b"".join([xxhash.xxh128_digest(" ".join(s).rstrip(MARKS)) for s in split])
    plain = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    count = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, n))])
    stop = np.maximum(np.searchsorted(count, count[:-1] + words), np.arange(n) + run)
    stop[stop > n] = 0
    halves = []
    for lane, (up, down) in enumerate(_POWERS):
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plain[:, lane] * up[:n], dtype=np.uint64)])
            mixed = (sums[stop] - sums[:-1]) * down[:n]
            halves.append(((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return halves[0], halves[1], stop


def _tag(text: Column) -> Column:
    """31 bits of the text's hash: tells apart rows of one doc_id."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 31))


def occurrences(docs: DataFrame, run: int, words: int, places: bool) -> DataFrame:
    """A row per span of docs(doc_id, text): its hash (h, g), and with places the document (a null id sorts last) and the place in it: the text's tag and the part."""

    def make(batches):
        claim("substring_dedup", _POWERS.clear)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, tag, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                h, g, stop = spans(units(text), run, words)
                at = np.flatnonzero(stop)
                for col, x in zip(out, (h[at], g[at], np.full(len(at), doc), (tag << 32) + at)):
                    col.append(x)
            if out[0]:
                names = ["h", "g", "doc", "place"][: 4 if places else 2]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x, _ in zip(out, names)], names=names)

    slim = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), _tag(F.col("text")).alias("tag"), "text")
    return slim.mapInArrow(make, "h long, g long" + ", doc long, place long" * places)


def removals(docs: DataFrame, scratch: Scratch, run: int, words: int) -> DataFrame:
    """doc, tag and the starts (an array) of its spans that are not the first of their kind.

    Spans are made twice rather than written: for counting only hashes travel,
    counted partly before the shuffle, so that a passage that a third of all
    documents share is no load. Only repeated hashes then meet their places, and
    the few that remain are written; adaptive execution splits a hot one's rows.
    """
    repeated = occurrences(docs, run, words, False).groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
    hits = scratch.keep(occurrences(docs, run, words, True).join(repeated, ["h", "g"]), "hits")
    first = hits.groupBy("h", "g").agg(F.min(F.struct("doc", "place")).alias("first"))
    later = hits.join(first, ["h", "g"]).where(F.struct("doc", "place") != F.col("first"))
    return later.groupBy("doc", F.shiftright("place", 32).alias("tag")).agg(F.collect_set((F.col("place") % (1 << 32)).cast("int")).alias("starts"))


def dedup(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with the text shortened, n_sentences, n_removed and removed (start:end in the old text, comma-joined).

    n_sentences and n_removed count parts. Null and empty texts stay as they
    are, and so do texts of fewer than `run` parts or `words` words, which hold
    no span. Rows of equal doc_id and text are one document and are all treated
    alike; a passage repeated inside a text loses its later occurrences. Columns
    of those names are replaced, all others stay, an empty table stays empty,
    and texts are never cut.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    docs = docs.drop("n_sentences", "n_removed", "removed")
    doc, tag, starts = (unused(docs.columns, x) for x in ("doc", "tag", "starts"))
    gone = removals(docs.select("doc_id", "text"), scratch, run, words)
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), tag: F.coalesce(_tag(F.col("text")), F.lit(-1))})
    joined = keyed.join(gone.withColumnsRenamed({"doc": doc, "tag": tag, "starts": starts}), [doc, tag], "left").drop(doc, tag)

    def make(chunks):
        claim("substring_dedup", _POWERS.clear)
        for texts, begins in chunks:
            out: list[list] = [[], [], [], []]
            for text, begun in zip(texts, begins):
                parts = units(text or "")
                kept, count, cut = text, 0, ""
                if begun:
                    begun = np.array(begun)
                    covered = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(covered, begun, 1)
                    np.add.at(covered, spans(parts, run, words)[2][begun], -1)
                    drop = np.cumsum(covered)[:-1] > 0
                    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], drop, [0]])))
                    kept = "".join([p for p, d in zip(parts, drop) if not d])
                    count, cut = int(drop.sum()), ",".join(f"{offsets[a]}:{offsets[b]}" for a, b in zip(edge[::2], edge[1::2]))
                for col, x in zip(out, (kept, len(parts), count, cut)):
                    col.append(x)
            yield out

    fields = [("text", T.StringType()), ("n_sentences", T.LongType()), ("n_removed", T.LongType()), ("removed", T.StringType())]
    done = append_columns(joined, ["text", starts], make, fields, rows=256).drop(starts)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], "n_sentences", "n_removed", "removed")
