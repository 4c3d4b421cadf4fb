"""Query expansion by pseudo-relevance feedback, and similarity of expanded queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text
from wordloom.operators.graph import written


def expand(doc_tf: DataFrame, top_docs: DataFrame, query_terms: list[str], num_terms: int) -> DataFrame:
    """term, frequency, prf: the most frequent terms of the top documents without stop words and the query's own; prf sums to 1.

    Ties go to the term that sorts first; no term left gives no row.
    """
    # Written, so that the few documents' size is known, and the corpus is not shuffled to meet them.
    rows = doc_tf.join(written(top_docs.select("doc_id"), "top-docs"), "doc_id", "left_semi").where(~text.is_stop_word(F.col("term")) & ~F.col("term").isin(query_terms))
    best = rows.groupBy("term").agg(F.sum("tf").alias("frequency")).orderBy(F.desc("frequency"), "term").limit(num_terms)
    return best.select("term", "frequency", (F.col("frequency") / F.sum("frequency").over(Window.partitionBy())).alias("prf"))


def expand_batch(doc_tf: DataFrame, top_docs: DataFrame, query_terms: DataFrame, num_terms: int) -> DataFrame:
    """top_docs(query, doc_id), query_terms(query, term): query, term, frequency, prf for all queries in one plan."""
    rows = written(top_docs.select("query", "doc_id"), "top-docs").join(doc_tf, "doc_id").where(~text.is_stop_word(F.col("term"))).join(query_terms, ["query", "term"], "left_anti")
    counts = rows.groupBy("query", "term").agg(F.sum("tf").alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("frequency"), "term"))
    best = counts.withColumn("__r", rank).where(F.col("__r") <= num_terms)
    return best.select("query", "term", "frequency", (F.col("frequency") / F.sum("frequency").over(Window.partitionBy("query"))).alias("prf"))


def bhattacharyya(weights: DataFrame) -> DataFrame:
    """weights(query, term, prf): q1, q2 and their coefficient for all ordered pairs of different queries that share a term, 0 for the others.

    Pairs with a common term meet on it; only the few queries themselves are
    paired with one another.
    """
    other = weights.select("term", F.col("query").alias("q2"), F.col("prf").alias("p2"))
    shared = weights.join(other, "term").where("query <> q2").groupBy(F.col("query").alias("q1"), "q2").agg(F.sum(F.sqrt(F.col("prf") * F.col("p2"))).alias("coefficient"))
    names = weights.select("query").distinct()
    grid = names.select(F.col("query").alias("q1")).join(names.select(F.col("query").alias("q2"))).where("q1 <> q2")
    return grid.join(shared, ["q1", "q2"], "left").select("q1", "q2", F.coalesce("coefficient", F.lit(0.0)).alias("coefficient"))
