"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own text; a text's
language is the one whose dictionary lets it shrink most. Case, digits,
punctuation and mark-up are taken out first, as they say little about the
language. A narrow margin between the best two is a rejection.
"""

from __future__ import annotations

import math

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import zdict
from .shared import append_columns

LETTERS = regex.compile(r"\P{L}+")
UNKNOWN = "und"


def normal(text: str | None) -> bytes:
    return LETTERS.sub(" ", (text or "").lower()).strip().encode()


def learn(docs: DataFrame, dict_bytes: int = 1 << 20, rows: int = 400) -> dict[str, bytes]:
    """A dictionary for every language of docs(doc_id, text, lang).

    A bounded sample is learnt from: of each language about `rows` rows, drawn
    by a hash of id and text (so that null ids and repeated texts are drawn like
    any other; equal rows count once), whole, in the order of the hash, as far
    as dict_bytes takes them. A text that is longer than what is left of these
    is passed over, not cut. Null languages and texts are left out.
    """
    docs = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])[F.col("lang")]
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    drawn = docs.where((F.pmod(h, F.lit(1 << 30)) < share * (1 << 30)) & (F.octet_length("text") <= dict_bytes))
    picked = drawn.select("lang", "text", h.alias("h")).distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(picked, key=lambda r: (r["h"], r["text"])):
        have, more = out.get(r["lang"], b""), normal(r["text"])
        if more and len(have) + len(more) < dict_bytes:
            out[r["lang"]] = have + b" " + more
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 6, margin: float = 0.01, text: str = "text") -> DataFrame:
    """docs with lang_best, score (0 to 1) and rejected.

    lang_best is `und`, with score 0 and rejected, for a null text, one without
    a letter, or where nothing was learnt. Otherwise it is the language with the
    smallest size, ties to the name that sorts first, as do all texts on which
    the dictionaries have no bearing; rejected says that the second best is within `margin` of it. Rows are independent, columns of
    those names are replaced, and texts are encoded whole.
    """

    def make(chunks):
        sizer = zdict.sizer(dictionaries, level, min_match=3)
        for (texts,) in chunks:
            best, scores, rejected = [], [], []
            for data in map(normal, texts):
                if not data or not dictionaries:
                    best.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                ranked = sorted((n, lang) for lang, n in sizer.sizes(data).items())
                scale = 4 + 0.02 * ranked[0][0]
                best.append(ranked[0][1])
                scores.append(1 / sum(math.exp((ranked[0][0] - n) / scale) for n, _ in ranked))
                rejected.append(len(ranked) > 1 and ranked[1][0] - ranked[0][0] < margin * ranked[1][0])
            yield [best, scores, rejected]

    return append_columns(docs, [text], make, [("lang_best", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], rows=256)
