"""Rankers: a query's terms and an Index to scored documents.

Every ranker scores what match_all finds, from rows filtered to the query's
terms, so the shuffles grow with the hits, not with the corpus. Results are
ordered by score, then link rank, views and id, which is a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index
from .match import in_title, match_all, phrase_counts


def hits(index: Index, terms: list[str]) -> DataFrame:
    """doc_id, term and tf of the query's terms, in the documents that hold all."""
    return index.doc_tf.where(F.col("term").isin(terms)).join(match_all(index.doc_tf, terms), "doc_id", "left_semi")


def whole(index: Index, terms: list[str]) -> DataFrame:
    """The rows of index.counts of the documents that hold every term; of none if there is no term. Told row by row."""
    terms = list(dict.fromkeys(terms))
    held = F.size(F.array_intersect(F.array(*map(F.lit, terms)), F.col("counts.term"))) == len(terms) if terms else F.lit(False)
    return index.counts.where(F.col("doc_id").isNotNull() & held)


def conjunctive(index: Index, terms: list[str], phrases: list[list[str]] = (), solo: list[str] | None = None) -> DataFrame:
    """The sum of tf; with phrases five times their occurrences, all of which must occur, and the tf of the other terms."""
    rows = hits(index, terms)
    if not phrases:
        return rows.groupBy("doc_id").agg(F.sum("tf").cast("double").alias("score"))
    solo = [t for t in terms if t not in {w for p in phrases for w in p}] if solo is None else solo
    out = rows.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("term").isin(solo), F.col("tf"))), F.lit(0)).cast("double").alias("score"))
    for phrase in phrases:
        out = out.join(phrase_counts(index.tokens, phrase), "doc_id").select("doc_id", (F.col("score") + 5 * F.col("occurrences")).alias("score"))
    return out


def conjunctive_docs(index: Index, terms: list[str]) -> DataFrame:
    return match_all(index.doc_tf, terms).withColumn("score", F.lit(1.0))


def weights(terms: list[str]) -> dict[str, int]:
    return {t: terms.count(t) for t in dict.fromkeys(terms)}


def cosine(index: Index, terms: list[str]) -> DataFrame:
    """tf-idf cosine: tf over length times ln(N / df) against query counts times ln(N / df); 0 where a norm is 0."""
    counts = weights(terms)
    spark = index.docs.sparkSession
    # As many rows as the query has terms.
    asked = spark.createDataFrame(list(counts.items()), "term string, qtf int")
    rows = index.weighted(whole(index, terms)).join(F.broadcast(asked), "term", "left")
    wq = F.col("qtf") * F.col("idf")
    summed = rows.groupBy("doc_id").agg(F.sum(F.col("weight") * wq).alias("dot"), F.sum(wq * wq).alias("q2"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return summed.select("doc_id", F.coalesce(F.try_divide("dot", F.col("norm") * F.sqrt("q2")), F.lit(0.0)).alias("score"))


def query_likelihood(index: Index, terms: list[str], smoothing: str = "jm", weight: float = 0.5) -> DataFrame:
    """exp of the sum of ln((1 - weight) tf / length + weight cf / C); with smoothing="none" the second part is 0."""
    total = index.term_stats.agg(F.sum("cf").alias("total_tf"))
    stats = index.term_stats.where(F.col("term").isin(terms)).select("term", "cf")
    met = whole(index, terms).select("doc_id", "doc_len", F.inline(F.filter("counts", lambda c: c["term"].isin(terms))))
    joined = met.join(F.broadcast(stats), "term").join(F.broadcast(total))
    back = F.col("cf") / F.col("total_tf") if smoothing == "jm" else F.lit(0.0)
    return joined.groupBy("doc_id").agg(F.exp(F.sum(F.ln((1 - weight) * F.col("tf") / F.col("doc_len") + weight * back))).alias("score"))


def _boosted(index: Index, scored: DataFrame, terms: list[str], views: Callable[[Column, Column], Column], title: float) -> DataFrame:
    total = index.docs.agg(F.sum("num_views").alias("total_views"))
    rows = scored.join(index.doc_stats, "doc_id").join(F.broadcast(total)).join(in_title(index.tokens, index.doc_stats, terms), "doc_id", "left")
    score = F.col("score") * F.when(F.col("page_rank") > 0, F.col("page_rank")).otherwise(1.0)
    score = score * F.when(F.col("total_views") > 0, views(F.col("num_views"), F.col("total_views"))).otherwise(1.0)
    return rows.select("doc_id", (score * F.when(F.coalesce("in_title", F.lit(False)), title).otherwise(1.0)).alias("score"))


def comprehensive(index: Index, terms: list[str]) -> DataFrame:
    """Cosine times link rank, times 1 + views / (10 total views), times 2 for a title hit."""
    return _boosted(index, cosine(index, terms), terms, lambda v, t: 1 + 0.1 * v / t, 2.0)


def age_divisor(bucket: Column, buckets: int = 14) -> Column:
    """log2(1.95 + 0.05 t): t falls from buckets + 1 before the first bucket to 1; bucket counts from 0, null or negative is before."""
    t = F.greatest(F.lit(1), F.when(bucket.isNull() | (bucket < 0), buckets + 1).otherwise(buckets - bucket))
    return F.log2(1.95 + 0.05 * t)


def news(index: Index, terms: list[str], buckets: DataFrame) -> DataFrame:
    """Cosine over the age divisor; buckets has doc_id and bucket."""
    return cosine(index, terms).join(buckets, "doc_id", "left").select("doc_id", (F.col("score") / age_divisor(F.col("bucket"))).alias("score"))


def news_comprehensive(index: Index, terms: list[str], buckets: DataFrame) -> DataFrame:
    """Query likelihood times link rank and views, times 1.5 for a title hit, over the age divisor."""
    boosted = _boosted(index, query_likelihood(index, terms), terms, lambda v, t: F.when(v > 0, v).otherwise(1.0), 1.5)
    return boosted.join(buckets, "doc_id", "left").select("doc_id", (F.col("score") / age_divisor(F.col("bucket"))).alias("score"))


def phrase(index: Index, terms: list[str], phrases: list[list[str]] = ()) -> DataFrame:
    """Occurrences of the query's neighbouring pairs, and three times those of its phrases, in documents that hold all terms."""
    out = match_all(index.doc_tf, terms).withColumn("score", F.lit(0.0))
    for weight, words in [*((1, list(p)) for p in zip(terms, terms[1:])), *((3, p) for p in phrases)]:
        out = out.join(phrase_counts(index.tokens, words), "doc_id", "left").select("doc_id", (F.col("score") + weight * F.coalesce("occurrences", F.lit(0))).alias("score"))
    return out


RANKERS: dict[str, Callable[..., DataFrame]] = {"conjunctive": conjunctive, "cosine": cosine, "ql": query_likelihood, "comprehensive": comprehensive, "news": news, "phrase": phrase, "news_comprehensive": news_comprehensive}


def ordering(banded: bool = False) -> list[Column]:
    """Best first: score, link rank, views, id. banded: scores within a fifth of each other go by link rank first."""
    score = F.when(F.col("score") > 0, F.floor(F.ln("score") / F.ln(F.lit(1.2)))).otherwise(F.lit(-(1 << 40))) if banded else F.col("score")
    return [score.desc(), F.col("page_rank").desc(), F.col("num_views").desc(), F.col("doc_id").asc()]


def top(index: Index, scored: DataFrame, k: int, banded: bool = False) -> DataFrame:
    """The k best: doc_id, score, page_rank, num_views."""
    return scored.join(index.doc_stats.select("doc_id", "page_rank", "num_views"), "doc_id").orderBy(*ordering(banded)).limit(k)


def batch_cosine(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """queries(query_id, term), each term once: the k best documents by cosine of every query, with rank.

    All queries run in one plan, from one broadcast row of their terms: which
    documents some query matches in full is told row by row, and only those
    documents' norms are made. A window keeps the best of each query.
    """
    n = index.docs.agg(F.count("*").alias("n_docs"))
    asked = queries.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    listed = asked.agg(F.collect_list("terms").alias("asked")).select("asked", F.array_distinct(F.flatten("asked")).alias("any"))
    # Of a document the terms that some query has, and of those queries the ones that miss none.
    held = index.counts.join(F.broadcast(listed)).withColumn("held", F.array_intersect("any", F.col("counts.term")))
    matched = held.where(F.col("doc_id").isNotNull() & F.exists("asked", lambda q: F.size(F.array_except(q, "held")) == 0))
    met = matched.select("doc_id", "doc_len", F.inline(F.filter("counts", lambda c: F.array_contains("held", c["term"]))))
    idf = queries.join(index.term_stats, "term").join(F.broadcast(n)).join(asked.select("query_id", F.size("terms").alias("terms")), "query_id").select("query_id", "term", "terms", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))
    # As many rows as the queries have terms.
    rows = met.join(F.broadcast(idf), "term")
    summed = rows.groupBy("query_id", "doc_id").agg(F.count("*").alias("found"), F.first("terms").alias("terms"), F.sum(F.col("tf") / F.col("doc_len") * F.col("idf") * F.col("idf")).alias("dot"), F.sum(F.col("idf") * F.col("idf")).alias("q2"))
    full = summed.where("found = terms").join(index.norms(matched), "doc_id").select("query_id", "doc_id", F.coalesce(F.try_divide("dot", F.col("norm") * F.sqrt("q2")), F.lit(0.0)).alias("score"))
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return ranked.where(F.col("rank") <= k)
