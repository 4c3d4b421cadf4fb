"""Which documents match a query: all terms, any term, phrases, title, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_all(doc_tf: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of the documents that hold every term; of none if there is no term."""
    terms = list(dict.fromkeys(terms))
    hits = doc_tf.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == len(terms)).select("doc_id")


def match_any(doc_tf: DataFrame, terms: list[str]) -> DataFrame:
    return doc_tf.where(F.col("term").isin(terms)).select("doc_id").distinct()


def next_doc(doc_tf: DataFrame, terms: list[str], after: int) -> DataFrame:
    """The smallest doc_id above `after` that holds every term (null: none)."""
    return match_all(doc_tf, terms).where(F.col("doc_id") > after).agg(F.min("doc_id").alias("doc_id"))


def next_position(tokens: DataFrame, term: str, after: int) -> DataFrame:
    """Per document with the term its first position above `after`, or -1."""
    hit = tokens.where(F.col("term") == term)
    return hit.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("pos") > after, F.col("pos"))), F.lit(-1).cast("long")).alias("next_pos"))


def self_overlaps(phrase: list[str]) -> bool:
    return any(phrase[:n] == phrase[-n:] for n in range(1, len(phrase)))


def phrase_counts(tokens: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id and occurrences of the phrase, counted from the left without overlap.

    Only the phrase's own terms are shuffled, by document. Starts are found by
    looking ahead in position order; a phrase that can overlap itself goes
    through its sorted starts one by one.
    """
    k = len(phrase)
    rows = tokens.where(F.col("term").isin(phrase))
    places = Window.partitionBy("doc_id").orderBy("pos")
    start = F.col("term") == phrase[0]
    for i in range(1, k):
        start = start & (F.lead("term", i).over(places) == phrase[i]) & (F.lead("pos", i).over(places) == F.col("pos") + i)
    starts = rows.select("doc_id", "pos", start.alias("hit")).where("hit")
    if not self_overlaps(phrase):
        return starts.groupBy("doc_id").agg(F.count("*").alias("occurrences"))
    sorted_starts = starts.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("starts"))
    zero = F.struct(F.lit(-1).cast("long").alias("until"), F.lit(0).cast("long").alias("n"))
    greedy = F.aggregate("starts", zero, lambda a, x: F.when(x > a["until"], F.struct((x + (k - 1)).alias("until"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
    return sorted_starts.select("doc_id", greedy.alias("occurrences"))


def in_title(tokens: DataFrame, doc_stats: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and whether every term's first position lies in the title, for documents that hold every term."""
    first = tokens.where(F.col("term").isin(terms)).groupBy("doc_id", "term").agg(F.min("pos").alias("pos"))
    both = first.join(doc_stats.select("doc_id", "title_len"), "doc_id")
    return both.groupBy("doc_id").agg(F.count("*").alias("n"), F.every(F.col("pos") < F.col("title_len")).alias("in_title")).where(F.col("n") == len(set(terms))).select("doc_id", "in_title")
