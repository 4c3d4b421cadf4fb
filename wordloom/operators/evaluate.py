"""Retrieval and spelling metrics, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAINS = {"Perfect": 10, "Excellent": 7, "Good": 5, "Fair": 1}
CUTS = (1, 5, 10)


def gain(grade: Column) -> Column:
    out = F.lit(0)
    for name, value in GAINS.items():
        out = F.when(grade == name, value).otherwise(out)
    return out.cast("long")


def relevant(grade: Column) -> Column:
    return grade.isin("Perfect", "Excellent", "Good").cast("long")


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked(query, doc_id, rank) with rel and gain, 0 where not judged."""
    marks = qrels.select("query", "doc_id", relevant(F.col("grade")).alias("rel"), gain(F.col("grade")).alias("gain"))
    zero = F.lit(0).cast("long")
    return ranked.join(marks, ["query", "doc_id"], "left").withColumns({"rel": F.coalesce("rel", zero), "gain": F.coalesce("gain", zero)})


def _totals(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query").agg(F.sum(relevant(F.col("grade"))).alias("total"))


def precision_recall_f(ranked: DataFrame, qrels: DataFrame, cuts=CUTS, alpha: float = 0.5) -> DataFrame:
    """query, k, precision, recall, f."""
    hits = judged(ranked, qrels).groupBy("query").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"h{k}") for k in cuts])
    rows = hits.join(_totals(qrels), "query", "left").select("query", F.coalesce("total", F.lit(0)).alias("total"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("h")) for k in cuts])).alias("x")).select("query", "total", "x.*")
    p, r = F.col("h") / F.col("k"), F.coalesce(F.try_divide("h", "total"), F.lit(0.0))
    f = F.coalesce(F.try_divide(F.lit(1.0), F.try_divide(F.lit(alpha), p) + F.try_divide(F.lit(1 - alpha), r)), F.lit(0.0))
    return rows.select("query", "k", p.alias("precision"), r.alias("recall"), f.alias("f"))


def average_precision(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """query, ap (over the relevant retrieved) and rr; 0 where nothing relevant is."""
    so_far = F.sum("rel").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = judged(ranked, qrels).withColumn("p", so_far / F.col("rank"))
    hit = F.col("rel") == 1
    return rows.groupBy("query").agg(F.coalesce(F.avg(F.when(hit, F.col("p"))), F.lit(0.0)).alias("ap"), F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"))


def ndcg(ranked: DataFrame, qrels: DataFrame, cuts=CUTS, cumulative: bool = False) -> DataFrame:
    """query, k, ndcg with gain / ln(rank + 1); cumulative adds the sums of all smaller cuts, in both parts."""
    ideal = qrels.select("query", gain(F.col("grade")).alias("gain"), F.row_number().over(Window.partitionBy("query").orderBy(gain(F.col("grade")).desc(), "doc_id")).cast("long").alias("rank"))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.ln(F.col("rank") + 1)).otherwise(0.0))
    own = judged(ranked, qrels).groupBy("query").agg(*[at(k).alias(f"d{k}") for k in cuts])
    best = ideal.groupBy("query").agg(*[at(k).alias(f"i{k}") for k in cuts])
    upto = lambda name, k: sum((F.col(f"{name}{c}") for c in cuts if c <= k), F.lit(0.0)) if cumulative else F.col(f"{name}{k}")
    parts = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.coalesce(F.try_divide(upto("d", k), upto("i", k)), F.lit(0.0)).alias("ndcg")) for k in cuts])
    return own.join(best, "query", "left").select("query", F.explode(parts).alias("x")).select("query", "x.*")


def interpolated(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """query, recall_level (tenths, 0 to 10), precision: the best at that recall or beyond."""
    so_far = F.sum("rel").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = judged(ranked, qrels).withColumn("h", so_far).join(_totals(qrels), "query", "left")
    # Whole numbers: recall >= level / 10.
    best = [F.coalesce(F.max(F.when((10 * F.col("h") >= level * F.col("total")) & (F.col("total") > 0), F.col("h") / F.col("rank"))), F.lit(0.0)) for level in range(11)]
    wide = rows.groupBy("query").agg(F.array(*best).alias("p"))
    return wide.select("query", F.posexplode("p").alias("level", "precision")).select("query", F.col("level").cast("long").alias("recall_level"), "precision")


def report(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """One wide row per query with all metrics."""
    wide = lambda df, key, value, keys: df.groupBy("query").pivot(key, list(keys)).agg(F.first(value)).select("query", *[F.col(str(k)).alias(f"{value}_{k}") for k in keys])
    prf = precision_recall_f(ranked, qrels)
    out = wide(prf, "k", "precision", CUTS)
    for df, key, value, keys in ((prf, "k", "recall", CUTS), (prf, "k", "f", CUTS), (ndcg(ranked, qrels), "k", "ndcg", CUTS), (interpolated(ranked, qrels).withColumnRenamed("precision", "interpolated"), "recall_level", "interpolated", range(11))):
        out = out.join(wide(df, key, value, keys), "query")
    return out.join(average_precision(ranked, qrels), "query")


def spelling(tests: DataFrame, found: DataFrame) -> DataFrame:
    """tests(wrong, right), found(wrong, term): n, the share corrected rightly, and the share with no correction."""
    rows = tests.join(found.select("wrong", "term"), "wrong", "left")
    return rows.agg(F.count("*").alias("n"), F.avg((F.coalesce(F.col("term") == F.col("right"), F.lit(False))).cast("double")).alias("correct"), F.avg(F.col("term").isNull().cast("double")).alias("not_found"))
