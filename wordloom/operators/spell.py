"""Spelling correction: candidates within an edit distance, their scores, and corrected queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import distance, text


def within(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """words(wrong), vocabulary(term): wrong, term, distance for every pair within `most` (1 or 2), counted with free transpositions.

    Both sides are expanded by leaving characters out, which lets an equi-join
    find every such pair; only those pairs go through the distance function.
    Short words, of which nothing may be left, all share the empty key: there the
    words are dealt out and the vocabulary's repeated, so that no task has all.
    """
    keys, deals = distance.deletions(F.col("w"), most), 16
    dealt = lambda x, salt: F.when(x == "", F.concat(F.lit("\x00"), salt.cast("string"))).otherwise(x)
    salts = F.when(F.length("w") <= most, F.transform(F.sequence(F.lit(0), F.lit(deals - 1)), lambda k: F.concat(F.lit("\x00"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    left = words.select(F.col("wrong").alias("w")).distinct().select("w", F.explode(F.transform(keys, lambda x: dealt(x, F.pmod(F.xxhash64("w"), F.lit(deals))))).alias("key")).withColumnRenamed("w", "wrong")
    # Words of no asked length are not expanded. As many rows as there are lengths.
    lengths = words.select(F.explode(F.sequence(F.length("wrong") - most, F.length("wrong") + most)).alias("__n")).distinct()
    known = vocabulary.select(F.col("term").alias("w")).distinct()
    right = known.join(F.broadcast(lengths), F.length("w") == F.col("__n"), "left_semi").select("w", F.explode(F.concat(F.filter(keys, lambda x: x != ""), salts)).alias("key")).withColumnRenamed("w", "term")
    pairs = left.join(right, "key").where(F.abs(F.length("wrong") - F.length("term")) <= most).select("wrong", "term").distinct()
    return pairs.withColumn("distance", distance.dl_distance("wrong", "term")).where(F.col("distance") <= most)


def nearest_tier(candidates: DataFrame) -> DataFrame:
    """Of each word only its nearest candidates: exact, else distance 1, else 2."""
    return candidates.withColumn("__t", F.min("distance").over(Window.partitionBy("wrong"))).where("distance = __t").drop("__t")


def scored(candidates: DataFrame, frequencies: DataFrame, misspellings: DataFrame | None = None) -> DataFrame:
    """candidates with score: (f - 1) / (fmax - 1), f 1 at least (0 where fmax is 1), and 1 more for a known misspelling (wrong, right)."""
    top = frequencies.agg(F.max("cf").alias("fmax"))
    rows = candidates.join(frequencies.select("term", "cf"), "term", "left").join(F.broadcast(top))
    known = F.lit(0)
    if misspellings is not None:
        rows = rows.join(misspellings.select("wrong", F.col("right").alias("term"), F.lit(1).alias("__known")).distinct(), ["wrong", "term"], "left")
        known = F.coalesce("__known", F.lit(0))
    f = F.greatest(F.coalesce("cf", F.lit(1)), F.lit(1))
    return rows.select("wrong", "term", "distance", (F.coalesce(F.try_divide(f - 1, F.col("fmax") - 1), F.lit(0.0)) + known).alias("score"))


def suggestions(rows: DataFrame, n: int) -> DataFrame:
    """The n best of each word: score down, then term."""
    rank = F.row_number().over(Window.partitionBy("wrong").orderBy(F.desc("score"), "term"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def corrected_query(tokens: DataFrame, best: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens(query_id, pos, token), best(wrong, term): corrected text per query and whether it was right.

    Known tokens stay; unknown ones give way to the best candidate, or go where
    there is none, which leaves the query marked as misspelt.
    """
    known = vocabulary.select(F.col("term").alias("token")).distinct().withColumn("known", F.lit(True))
    rows = tokens.join(known, "token", "left").join(best.select(F.col("wrong").alias("token"), F.col("term").alias("fix")), "token", "left")
    word = F.when(F.col("known"), F.col("token")).otherwise(F.col("fix"))
    grouped = rows.groupBy("query_id").agg(F.every(F.coalesce("known", F.lit(False))).alias("is_correct"), F.sort_array(F.collect_list(F.when(word.isNotNull(), F.struct("pos", word.alias("w"))))).alias("ws"))
    return grouped.select("query_id", "is_correct", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("corrected"))


def gram_index(vocabulary: DataFrame, low: int = 1, high: int = 4) -> DataFrame:
    """gram and term, distinct."""
    return vocabulary.select("term").distinct().select(F.explode(F.array_distinct(text.ngrams(F.col("term"), low, high))).alias("gram"), "term")


def gram_sizes(term):
    """The n-gram lengths that a word of this length is looked up by."""
    n = F.length(term)
    return F.when(n > 5, F.array(F.lit(3), F.lit(4))).when(n == 5, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))


def gram_suggestions(words: DataFrame, index: DataFrame, frequencies: DataFrame, threshold: int | None = None, n: int = 10, measure=distance.osa_distance) -> DataFrame:
    """wrong, term, shared, distance, cf, rank: words that share grams, within the threshold in length and in edit distance (restricted, unless measure says else), nearest first, then frequency, then term."""
    limit = F.lit(threshold) if threshold is not None else F.when(F.length("wrong") > 10, 2).otherwise(1)
    grams = words.select("wrong", F.explode(F.array_distinct(text.ngrams(F.col("wrong"), 1, 4))).alias("gram")).where(F.array_contains(gram_sizes(F.col("wrong")), F.length("gram")))
    near = grams.join(index, "gram").where(F.abs(F.length("wrong") - F.length("term")) <= limit)
    pairs = near.groupBy("wrong", "term").agg(F.count("*").alias("shared"))
    # The plain distance is at most twice the one with transpositions, so this is a sound filter inside the JVM.
    pairs = pairs.where((limit >= 3) | (F.levenshtein("wrong", "term") <= 2 * limit))
    found = pairs.withColumn("distance", measure("wrong", "term")).where(F.col("distance") <= limit)
    rows = found.join(frequencies.select("term", "cf"), "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0).cast("long")))
    rank = F.row_number().over(Window.partitionBy("wrong").orderBy("distance", F.desc("cf"), "term"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("wrong", "term", "shared", "distance", "cf", "rank")


def range_search(words: DataFrame, vocabulary: DataFrame, d: int) -> DataFrame:
    """What a metric tree returns for radius d (0 to 2)."""
    return within(words, vocabulary, 2).where(F.col("distance") <= d)
