"""Quality rules with adaptive thresholds.

Every document is measured once. The measures of the documents that pass the
base rules go into quantile sketches per language and source: counts by bucket
(exact below 1024, above that with ten significant bits), which merge by adding
and so do not depend on the order of rows. A group's fence lies beyond its upper
quantile by a multiple of the distance between two of its quantiles; no measure
has a cutoff of its own. Fences of small groups are drawn towards their
language's, and these towards that of all rows, by a weighted mean without a
switch. The fences are joined back to the documents, and what lies beyond one is
rejected.
"""

from __future__ import annotations

import re
from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, append_columns, claim, unused

WORD = re.compile("[^\x20\x09-\x0d]+").findall
#: White space for str.split() that is part of a word here.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search
SYMBOLS = "#*$%&|<>"
MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
#: Measures: SQL of an integer that is 0 or more; the lower and the upper quantile in per cent; how many times their distance beyond the upper one the fence lies.
METRICS = {
    "marks": ("1000 * greatest(word_chars - n_letters, 0) div greatest(word_chars, 1)", 25, 75, 9),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 50, 99, 1),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 50, 99, 1),
    "upper": ("1000 * n_upper div greatest(word_chars, 1)", 25, 75, 12),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 25, 75, 7),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
#: A group's fence weighs its rows, the level above it so many.
PRIOR_ROWS = 100
SALTS = 16
UPPER = re.compile("[A-Z]").findall
LETTERS = regex.compile(r"\p{L}+").findall


def words_of(text: str) -> list[str]:
    return WORD(text) if OTHER_SPACE(text) else text.split()


def repeated(words: list[str]) -> int:
    """Words that lie in a window of five found twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, until = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 5 - max(at, until)
            until = at + 5
    return covered


def measure_text(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    lines = text.split("\n")
    worded = [x for x in lines if words_of(x)] if len(lines) > 1 else lines[: bool(words)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)), repeated(words), len(worded), len(UPPER(text)), sum(map(len, LETTERS(text)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts in MEASURED (columns of these names are replaced) of each whole text; a null text has no words."""

    def make(chunks):
        claim("quality_rules", lambda: None)
        for (texts,) in chunks:
            yield list(zip(*map(measure_text, texts)))

    return append_columns(docs, [text], make, [(n, T.LongType()) for n in MEASURED], rows=256)


def sketch(measured: DataFrame) -> DataFrame:
    """Per lang, source and metric: n rows by bucket, of those that pass the base rules. Sketches of parts merge by adding n."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(sql).cast("long").alias("v")) for m, (sql, *_) in METRICS.items()])).alias("m")
    rows = measured.where(f"NOT ({BASE_FAILED})").select("lang", "source", values).select("lang", "source", "m.*")
    bucket = F.expr("CASE WHEN v < 1024 THEN v ELSE shiftleft(v >> (length(bin(v)) - 10), length(bin(v)) - 10) END")
    return rows.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _by_metric(at: int) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN {x[at]}" for m, x in METRICS.items()) + " END"


def fences(sketches: DataFrame) -> DataFrame:
    """lang, source and one fence per metric."""
    levels = {0: ["lang", "source"], 1: ["lang"], 2: []}
    found = {}
    for level, keys in levels.items():
        merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        over = ", ".join([*keys, "metric"])
        ranked = merged.selectExpr(*keys, "metric", "bucket", f"sum(n) OVER (PARTITION BY {over} ORDER BY bucket) AS upto", f"sum(n) OVER (PARTITION BY {over}) AS total")
        at = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *[F.min(F.when(F.expr(f"100 * upto >= {_by_metric(q)} * total"), F.col("bucket"))).alias(name) for q, name in ((1, "low"), (2, "high"))])
        found[level] = at.select(*keys, "metric", F.col("total").cast("double").alias(f"n{level}"), F.expr(f"CAST(high + {_by_metric(3)} * (high - low) AS DOUBLE)").alias(f"own{level}"))
    out = found[0].alias("a").join(found[1].alias("b"), F.expr("a.lang <=> b.lang AND a.metric = b.metric")).join(found[2].alias("c"), F.expr("a.metric = c.metric"))
    drawn = F.expr(f"(n0 * own0 + {PRIOR_ROWS} * ((n1 * own1 + {PRIOR_ROWS} * own2) / (n1 + {PRIOR_ROWS}))) / (n0 + {PRIOR_ROWS})")
    long = out.select("a.lang", "a.source", "a.metric", drawn.alias("fence"))
    return long.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"fence_{m}") for m in METRICS])


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """docs(text, lang, source, ...) with MEASURED, base_failed and kept.

    carry names the columns that are kept (all by default). base_failed: fewer
    than 10 words, or more than a fifth of them in repeated windows; kept is
    false for these and for outliers of their group. Null languages and sources
    form groups of their own, rows are independent beyond the sketches, repeated
    rows count each, and an empty table stays empty. Columns of docs may bear
    any name; those of the new columns are replaced.

    The measured rows are written once to the shared folder, since the sketches
    and the join both read them. The fences (a row per language and source) are
    joined salted, so that a hot source is spread; Spark broadcasts them where
    their written size allows.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in {*MEASURED, "base_failed", "kept"}]
    text, lang, source, salt = (unused(docs.columns, x) for x in ("text", "lang", "source", "salt"))
    cols = [F.col(f"`{c}`") for c in carry]
    slim = docs.select(*cols, F.col("text").alias(text), F.col("lang").alias(lang), F.col("source").alias(source))
    rows = measure(slim, text)
    rows = scratch.keep(rows.drop(text), "measured")
    limits = scratch.keep(fences(sketch(rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *MEASURED))), "fences")
    salted = limits.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).alias("f")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*MEASURED), F.lit(SALTS)).cast("int")).alias("r")
    joined = rows.join(salted, F.expr(f"r.`{lang}` <=> f.lang AND r.`{source}` <=> f.source AND r.`{salt}` = f.salt"), "left")
    outlier = F.lit(False)
    for m, (sql, *_) in METRICS.items():
        outlier = outlier | (F.expr(sql) > F.col(f"f.fence_{m}"))
    base = F.expr(BASE_FAILED)
    return joined.select(*[F.col(f"r.`{c}`") for c in carry], *MEASURED, base.alias("base_failed"), (~base & ~F.coalesce(outlier, F.lit(False))).alias("kept"))
