"""Secret scans: patterns, and Markov models of random strings against ordinary identifiers.

All of it is DataFrame expressions. The patterns find assigned, access-key and
hexadecimal secrets. Beyond them, runs of token characters are scored by two
first-order character models, one learnt from random strings and one from
identifiers: a run whose log-likelihood ratio per transition is above the
threshold is a secret too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, unused

KINDS = ["assign", "access", "hex", "markov"]
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE}+)"""
#: Runs too short fail wherever they begin, so that these find what dropping them later would leave.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
RUN = "A-Za-z0-9+/_=-"
#: Whole runs of 16 and more token characters, however long. Where letters or digits are missing, three marks in a row, as in ruled lines, end a run.
#: The lookaheads start at a run's beginning only and nothing is given back, so that a text takes linear time and no stack.
CANDIDATE = "(?=[" + RUN + "]{16})(?:(?<![" + RUN + "])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[" + RUN + "]{16,}+|(?:[A-Za-z0-9]|[+/_=-](?![+/_=-]{2})){16,}+)"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches' (start, end, value) in characters, from the lengths of matches and of what lies between; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # Spark makes an array anew for each mention under a condition, so each is named once.
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), *([F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")] if group else []))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        hit = F.struct(begin.alias("start"), end.alias("end"), x["value" if group else "hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(hit))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda a: a["out"]))


def _spans(found: Column, kind: int, keep=None) -> Column:
    found = F.coalesce(found, F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"))
    found = F.filter(found, keep) if keep else found
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def identifiers(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """Labelled samples (sample, label) from about `rows` distinct texts, drawn by a hash of the text, whole texts each.

    Copies of a drawn text count once, so that a text repeated by a third of all
    rows can't swell the sample. Null texts count as empty. Label 0: their words, and identifiers made of two or three neighbouring ones
    with underscores, hyphens, capitals and small numbers. Label 1: the values
    that the patterns find, and digests written in base 64, 36 and 16.
    """
    n = docs.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < min(1.0, rows / max(n, 1)) * (1 << 30)).distinct()
    # Written, as both labels and both of train()'s passes read it: docs are read for it once.
    drawn = Scratch(docs.sparkSession, "identifiers").keep(drawn, "drawn")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))
    trio = drawn.select(words.alias("w")).select(F.explode(F.expr("transform(sequence(0, size(w) div 3), i -> struct(get(w, 3 * i) as a, get(w, 3 * i + 1) as b, get(w, 3 * i + 2) as c, i))")).alias("x")).select("x.*").where("c is not null")
    made = trio.select(
        F.explode(
            F.array(
                F.concat_ws("_", F.lower("a"), F.lower("b"), F.lower("c")),
                F.concat_ws("-", F.lower("a"), F.lower("b"), F.expr("i % 100")),
                F.concat(F.lower("a"), F.initcap("b"), F.initcap("c"), F.expr("i % 10")),
                F.concat_ws("/", F.lower("a"), F.lower("b"), F.concat(F.lit("v"), F.expr("i % 10"))),
                F.concat_ws("_", F.upper("a"), F.upper("b"), F.expr("2000 + i % 30")),
                F.concat("a", "b", "c"),
            )
        ).alias("sample")
    )
    values = drawn.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("sample")).where("length(sample) >= 8")
    digest = F.sha2(F.col("id").cast("string"), 256)
    made_up = docs.sparkSession.range(rows).select(
        F.explode(
            F.array(
                F.base64(F.unhex(digest)),
                F.translate(F.base64(F.unhex(digest)), "+/=", "-_"),
                F.concat(*[F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 36) for k in range(4)]),
                F.lower(F.concat(*[F.conv(F.substring(digest, 3 + 12 * k, 12), 16, 36) for k in range(4)])),
                F.substring(digest, 1, 31),
            )
        ).alias("sample")
    )
    return made.withColumn("label", F.lit(0)).union(values.union(made_up).withColumn("label", F.lit(1)))


def _transitions(samples: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.length("sample") - 1)).alias("i")
    return samples.where("length(sample) >= 2").select("sample", "label", at).select("label", F.expr("ascii(substr(sample, i, 1))").alias("a"), F.expr("ascii(substr(sample, i + 1, 1))").alias("b"))


def train(samples: DataFrame, smoothing: float = 0.5, floor: float = 2.0, slack: float = 0.1) -> dict:
    """The models' log-likelihood ratios by pair of characters (128 x 128, whatever the samples' size), and the threshold.

    The threshold lies `slack` above the mean ratio that 999 of 1000 ordinary
    samples stay below, and at `floor` at least. Samples of other characters
    than ASCII are left out.
    """
    samples = samples.where("sample rlike '^[\\\\x21-\\\\x7e]+$'")
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in _transitions(samples).groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}
    alphabet = [c for c in range(33, 127)]
    totals = {(label, a): sum(counts.get((label, a, b), 0) for b in alphabet) for label in (0, 1) for a in alphabet}
    ratio = [0.0] * (128 * 128)
    for a in alphabet:
        for b in alphabet:
            p = [(counts.get((label, a, b), 0) + smoothing) / (totals[label, a] + smoothing * len(alphabet)) for label in (0, 1)]
            ratio[a * 128 + b] = math.log(p[1] / p[0])
    model = {"ratio": ratio, "threshold": floor}
    ordinary = samples.where("label = 0 and length(sample) >= 16").select(score(F.col("sample"), model).alias("s"))
    high = ordinary.agg(F.percentile_approx("s", 0.999, 10000)).first()[0]
    if high is not None:
        model["threshold"] = max(floor, high + slack)
    return model


def score(token: Column, model: dict) -> Column:
    """The mean log-likelihood ratio per transition of an ASCII token of two or more characters: above 0, rather random."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model["ratio"])), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.struct(code.alias("last"), (acc["sum"] + F.when(acc["last"] > 0, F.get(table, acc["last"] * 128 + code)).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda a: a["sum"]) / (F.length(token) - 1)


def find(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (start, kind, end) in order; kind numbers KINDS, positions count characters, end is exclusive.

    base has the patterns' spans: per kind leftmost and not overlapping, assigned
    values of fewer than 8 characters dropped after matching. spans has these
    and the runs that the models take for secrets and no base span touches: a
    run is scored and marked whole, at any length. A null text counts as empty;
    rows are independent, repeated ones too; columns of those names are
    replaced, all others stay; whole texts are searched.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop("base", "spans")
    assign, access, digits, run = (unused(docs.columns, x) for x in ("assign", "access", "hex", "run"))
    hits = docs.withColumns({assign: located(body, ASSIGN, 1), access: F.when(body.contains("AKIA"), located(body, ACCESS)), digits: located(body, HEX), run: located(body, CANDIDATE)})
    base = F.array_sort(F.concat(_spans(F.col(assign), 0, lambda x: F.length(x["value"]) >= 8), _spans(F.col(access), 1), _spans(F.col(digits), 2)))
    based = hits.withColumn("base", base)
    free = lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    runs = _spans(F.col(run), 3, lambda x: free(x) & (score(x["value"], model) > model["threshold"]))
    return based.withColumn("spans", F.array_sort(F.concat(F.col("base"), runs))).drop(assign, access, digits, run)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of `spans` replaced in the text by the mark; overlapping spans give one. A null text stays null."""
    body = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(body, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        over = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(over, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

    whole = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.length(body))))
    return docs.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(body))
